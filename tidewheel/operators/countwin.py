"""Ticks that count records instead of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


#: Cuts that are looked at together: every so manieth first, then those of one block.
STEP = 16


def _below(x: Column, cuts: list) -> Column:
    """How many of the sorted cuts are at or below x."""
    if not cuts:
        return F.lit(0)

    def reached(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c <= x))

    if len(cuts) < STEP:
        return reached(F.lit(cuts))
    blocks = reached(F.lit(cuts[STEP - 1 :: STEP])) * STEP
    return blocks + reached(F.slice(F.lit(cuts), blocks + 1, STEP))


def positions(df: DataFrame, ts: str, tie: str, name: str = "position", parts: int | None = None) -> DataFrame:
    """Adds each row's place (from 0) in the order of ts and tie.

    Rows are cut into `parts` ranges of ts with about as many rows each (default: the shuffle partitions, at most 1000). A
    ts that alone fills ranges is cut into about as many by tie, where that is a number. Rows are ordered within ranges, and
    each range starts at the number of rows before it. The cuts and one count a range (some three for each of `parts` at
    most) reach the driver, so df is read before the result is. Null ts come first."""
    parts = parts or min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    t = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(2**62)))
    found = df.agg(F.percentile_approx(t, shares, 10_000)).first()[0] or []
    hot = sorted({a for a, b in zip(found, found[1:]) if a == b})
    edges = sorted({*found, *hot, *(v + 1 for v in hot)})
    sub = F.when(F.lit(False), 0)
    if hot and isinstance(df.schema[tie].dataType, NumericType):
        for r in df.where(t.isin(*hot)).groupBy(t.alias("v")).agg(F.percentile_approx(tie, shares, 10_000).alias("cuts")).collect():
            every = max(1, parts // (found.count(r["v"]) + 1))
            # A null tie comes first: it is below all cuts.
            sub = sub.when(t == r["v"], _below(F.col(tie), sorted(set((r["cuts"] or [])[every - 1 :: every]))))
    cut = df.withColumn("_b", _below(t, edges)).withColumn("_s", sub.otherwise(0))
    counts = {(r["_b"], r["_s"]): r["n"] for r in cut.groupBy("_b", "_s").agg(F.count("*").alias("n")).collect()}
    # Looked up by number: a join of the ranges with their counts joins df with itself by a lambda of ts, and Spark 4.1 then
    # infers a filter of that lambda for the counts, which have no ts.
    first, before, rows = [], [], 0
    for b in range(len(edges) + 1):
        first.append(len(before))
        for s in range(max((s for at, s in counts if at == b), default=0) + 1):
            before.append(rows)
            rows += counts.get((b, s), 0)
    inside = W.partitionBy("_b", "_s").orderBy(F.asc_nulls_first(ts), tie)
    earlier = F.get(F.lit(before), F.get(F.lit(first), F.col("_b")) + F.col("_s"))
    return cut.withColumn(name, (F.row_number().over(inside) - 1 + earlier).cast("long")).drop("_b", "_s")


def count_ticks(df: DataFrame, ts: str, tie: str, records: int = 100, name: str = "tick") -> DataFrame:
    """Every `records` records, in the order of ts and tie, are one tick."""
    placed = positions(df, ts, tie, "_place")
    return placed.withColumn(name, F.floor(F.col("_place") / records).cast("long")).drop("_place")


def rate_ticks(df: DataFrame, ts: str, tie: str, rates: list[int], name: str = "tick", rounds: bool = False) -> DataFrame:
    """The first rates[0] records are tick 0, the next rates[1] tick 1, and so on; what is left over belongs to the tick after the last.

    rounds: what is left over goes through the rates again, as often as it takes."""
    ends, n = [], 0
    for r in rates:
        n += r
        ends.append(n)
    if rounds and not n:
        raise ValueError("rounds need a rate above 0")
    placed = positions(df, ts, tie, "_place")
    place = F.col("_place") % n if rounds else F.col("_place")
    tick = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= place)).cast("long")
    if rounds:
        tick = tick + F.floor(F.col("_place") / n) * len(rates)
    return placed.withColumn(name, tick.cast("long")).drop("_place")
