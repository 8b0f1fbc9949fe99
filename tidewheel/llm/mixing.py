"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import WORD, fresh, salted_rank, scratch

#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3


def targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict:
    """Exact targets by source: shares of all sizes by weight, at most `most` times a source's own size; what is
    above is shared again by weight among the others until none is above. Sources by code point, null last."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, left, open_ = {}, Fraction(sum(sizes.values())), set(order)
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > Fraction(most * sizes[s]) * whole]
        if not over:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def _mark(table: np.ndarray, bits: int, value: int) -> None:
    """table[k] = value where bit k is set; only the stretch from the lowest to the highest such bit is looked at."""
    low = (bits & -bits).bit_length() - 1
    bits >>= low
    some = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8)
    for k in range(0, len(some), 1 << 20):
        table[low + 8 * k + np.flatnonzero(np.unpackbits(some[k : k + (1 << 20)], bitorder="little"))] = value


def fit_budget(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many of the lengths[n] documents of each length n to take so that the lengths sum near budget.

    Of all but the last part of the budget, three times the longest document, the same share of every length is taken,
    rounded down, and what rounding leaves is taken largest lengths first. The last part, bounded by the longest
    document, is fitted by bounded-knapsack dynamic programming over the reachable sums (counts in powers of two): a bit a sum,
    and which step reached it first, which leads back from the best sum. That is at most 4 longest sums of some 3 bytes."""
    lengths = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in lengths.items())
    budget = max(0, min(budget, total))
    if not total or budget == total:
        return dict(lengths) if budget else {}
    longest = max(lengths)
    last = 3 * longest
    take = {n: c * max(0, budget - last) // total for n, c in lengths.items()}
    left = budget - sum(n * k for n, k in take.items())
    for n in sorted(lengths, reverse=True):
        if left > last:
            k = min(lengths[n] - take[n], (left - last) // n + 1, left // n)
            take[n] += k
            left -= k * n
    bound = left + longest
    sums, steps = 1, []  # bit s of sums: s can be reached
    reached_by = np.zeros(bound + 1, np.uint16)  # the step, from 1, that first reached a sum
    for n in sorted(lengths):
        free, part = lengths[n] - take[n], 1
        while free > 0 and n * (k := min(part, free)) <= bound and not sums >> left & 1:
            free, part = free - k, part * 2
            steps.append((n, k))
            if len(steps) == 2**16:
                reached_by = reached_by.astype(np.uint32)
            more = sums << n * k
            if more.bit_length() > bound + 1:
                more &= (1 << (bound + 1)) - 1
            more ^= more & sums
            if more:
                _mark(reached_by, more, len(steps))
                sums |= more
    low = (sums & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = sums >> left
    high = left + (above & -above).bit_length() - 1 if above else None
    at = low if high is None or left - low <= high - left else high
    while at:
        n, k = steps[reached_by[at] - 1]
        take[n] += k
        at -= n * k
    return {n: k for n, k in take.items() if k}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, mark: Column | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies[, mark]) for every row of docs; taken words are copies * size.

    A source's budget takes every document whole as often as it can; of what is left, documents are counted by exact
    length, the counts are fitted (fit_budget), and for each length the first documents by a seeded hash of id are
    taken once more. Null text has size 0; null source is a source of its own, after the others; rows repeated under
    one id are documents of their own. mark: a column of docs that comes along. One row a source reaches the driver. One
    source's counts by length meet in one task: at most as many numbers as its longest document has words, L. The fit there
    keeps two or four bytes and a few bits for each of at most 4 L sums, and stops at the first exact sum: some 100 MB for a
    text of ten million words. An empty table gives an empty result."""
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # no nulls in keys
    more = [] if mark is None else [mark.alias("mark")]
    rows = scratch(docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"), size.alias("size"), *more), "sizes")
    sizes = {r["source"][1:] if r["source"] else None: r["size"] for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    plan = []
    for name, target in targets(sizes, weights, most).items():
        whole = min(most, int(target // sizes[name])) if sizes[name] else 0
        plan.append(("" if name is None else f"={name}", name, sizes[name], float(target), whole, round(target) - whole * sizes[name]))
    small = F.broadcast if len(plan) <= 10_000 else lambda x: x  # a row a source
    plan = small(spark.createDataFrame(plan, "source string, name string, source_size long, target double, whole int, budget long"))
    counts = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))

    def fitted(table: pa.Table) -> pa.Table:
        lengths = dict(zip(table.column("size").to_pylist(), table.column("n").to_pylist()))
        took = fit_budget(lengths, table.column("budget")[0].as_py())
        source = table.column("source")[0].as_py()
        return pa.table({"source": pa.array([source] * len(took), pa.string()), "size": pa.array(took.keys(), pa.int64()), "extra": pa.array(took.values(), pa.int64())})

    budgets = counts.join(plan, "source").select("source", "size", "n", "budget")
    extra = scratch(budgets.groupBy("source").applyInArrow(fitted, "source string, size long, extra long"), "extra")
    ranked = salted_rank(rows, ["source", "size"], [F.col("id")], attach=extra).join(plan, "source")
    copies = F.col("whole") + F.when(F.col("rank") < F.coalesce(F.col("extra"), F.lit(0)), 1).otherwise(0)
    return ranked.select("id", F.col("name").alias("source"), "size", "source_size", "target", copies.cast("int").alias("copies"), *["mark"] * len(more))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document; see mix for nulls, empty texts, ties, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it; documents without words stay once, they cost no budget.

    Rows of one id with different texts or sources are documents of their own. Rows repeated under one id, text and source
    share what the mix gives them evenly, rounded down. Nulls are as in mix; an empty table gives an empty result."""
    ident, key, source, copies = (fresh(docs, c) for c in ("id", "key", "mixed_source", "copies"))
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
    out = mix(docs, id_col, text_col, source_col, mark=mark)
    out = out.groupBy("id", "mark").agg(F.floor(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies"))) / F.count("*")).cast("int").alias("copies")).where("copies > 0")
    out = out.select(F.coalesce("id", F.lit(-(2**63))).alias(ident), F.col("mark").alias(key), F.col("copies").alias(copies))
    rows = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias(ident), mark.alias(key))
    turn = F.explode(F.sequence(F.lit(1), F.col(copies))).alias(source)
    return rows.join(out, [ident, key]).select("*", turn).select(*docs.columns)
