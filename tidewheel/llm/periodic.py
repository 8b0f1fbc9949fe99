"""Periodic runs of words by Karp-Miller-Rosenberg naming.

Blocks of 1, 2, 4, ... words get names: equal blocks one name, by sorting pairs of names of half the length. How far two
places agree is then read off level by level, the largest first, so neither hashes nor suffixes are sorted or compared."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import fresh, small_batches

#: A run repeats its period so often at least, and has so many words at least.
LEAST_TURNS, LEAST_WORDS = 4, 6


def name_levels(names: np.ndarray) -> list[np.ndarray]:
    """levels[k][i] names the block of 2^k words from i on; the last level is the highest with two equal blocks, or level 0."""
    levels = [names]
    while len(now := levels[-1]) > (step := 1 << len(levels) - 1):
        left, right = now[: len(now) - step], now[step:]
        found, pair = np.unique(left.astype(np.int64) * (int(now.max()) + 1) + right, return_inverse=True)
        if len(found) == len(pair):
            break  # no two blocks are equal, here and at all higher levels
        levels.append(pair.astype(np.int32))
    return levels


def agree_after(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Over how many words the text from a on and from b on (a < b) are identical."""
    done = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        inside = np.flatnonzero(b + done < len(names))
        same = inside[names[a[inside] + done[inside]] == names[b[inside] + done[inside]]]
        done[same] += 1 << k
    return done


def agree_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Over how many words the text up to before a and up to before b (a < b) are identical."""
    done = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        names, step = levels[k], 1 << k
        inside = np.flatnonzero(a - done >= step)
        same = inside[names[a[inside] - done[inside] - step] == names[b[inside] - done[inside] - step]]
        done[same] += step
    return done


def runs_of(names: np.ndarray, turns: int = LEAST_TURNS, words: int = LEAST_WORDS) -> np.ndarray:
    """(start, length, smallest period) of every maximal run of at least `turns` (3 or more) periods and `words` words, by start and period.

    A run of period q agrees with itself q words on over 3q - q words or more, and so over a whole block from some
    multiple of (turns - 2) q on. Of these grid places only those survive whose blocks of 2^k <= q words have the name of
    those q words on; they are extended to both sides. All periods from 2^k to 2^(k+1) - 1 go together: at most
    n / 2 + 2^k places, whatever the text."""
    if turns < 3:
        raise ValueError("turns is 3 at least")
    n, out = len(names), []
    levels = name_levels(names)
    for k, level in enumerate(levels):
        periods = np.arange(1 << k, min(2 << k, n // turns + 1), dtype=np.int64)
        if not len(periods):
            break
        # Places of period q: multiples of (turns - 2) q from which on a block and the block q words on lie in the text.
        counts = np.maximum(0, (len(level) - 1 - periods) // ((turns - 2) * periods) + 1)
        q = np.repeat(periods, counts)
        at = (np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts)) * (turns - 2) * q
        same = level[at] == level[at + q]
        at, q = at[same], q[same]
        # A run that holds many places is extended from the first of them; what it then still holds is left out.
        for last in (False, False, True):
            now = np.ones(len(at), bool)
            if not last:
                now[1:] = q[1:] != q[:-1]
            a, own = at[now], q[now]
            length = own + agree_after(levels, a, a + own)
            before = agree_before(levels, a, a + own)
            start, length = a - before, length + before
            long = length >= np.maximum(words, turns * own)
            out.append(np.column_stack([start, length, own])[long])
            if last or now.all():
                break
            upto = np.repeat(start + length - own, np.diff(np.append(np.flatnonzero(now), len(at))))
            at, q = at[left := ~now & (at >= upto)], q[left]
    found = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 3), np.int64)
    # A run that a divisor of its period makes as well has the same place under the divisor, the smaller period.
    order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
    found = found[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when of every run the first period alone does."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def named(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words))


def collapse_runs(docs: DataFrame, text_col: str = "text", turns: int = LEAST_TURNS, words: int = LEAST_WORDS, runs_col: str = "runs", kept_col: str = "kept_text") -> DataFrame:
    """docs with runs_col, an array of (start, length, period) in words by start and period, and kept_col, the words that stay
    when every run is cut to its first period, joined by one space; both are last, and columns of these names go.

    Words are what stands between the bytes 9 to 13 and 32 of the whole text; null, empty and blank texts have none.
    Each row is worked on by itself, so repeated rows and an empty table need no rule. A task holds one batch of texts, and
    of one text log2 of its longest repeated stretch arrays of one number a word: nothing is shuffled."""
    if text_col.lower() in (runs_col.lower(), kept_col.lower()) or runs_col.lower() == kept_col.lower():
        raise ValueError("the text and both results need columns of their own")
    small_batches(docs.sparkSession)
    gone = {runs_col.lower(), kept_col.lower()}
    rest = docs.drop(*[c for c in docs.columns if c.lower() in gone])
    data = fresh(rest, "text_bytes")
    rest = rest.withColumn(data, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    shape = rest.drop(data).withColumn(runs_col, F.lit(None).cast("array<struct<start:long,length:long,period:long>>")).withColumn(kept_col, F.lit(None).cast("string")).schema
    at, names = rest.columns.index(data), shape.names
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def collapsed(batches):
        for b in batches:
            runs, kept = [], []
            for text in b.column(at).to_pylist():
                some = text.split()
                found = runs_of(named(some), turns, words)
                runs.append(found)
                kept.append(b" ".join(some if not len(found) else [some[k] for k in np.flatnonzero(kept_words(len(some), found))]))
            flat = np.concatenate([np.empty((0, 3), np.int64), *runs])
            edges = np.cumsum([0, *map(len, runs)])
            spans = pa.StructArray.from_arrays([pa.array(c) for c in flat.T.copy()], fields=list(triple))
            runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([*[c for k, c in enumerate(b.columns) if k != at], runs, pa.array(kept, pa.binary()).cast(pa.string())], names)

    return rest.mapInArrow(collapsed, shape)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which one id in ten repeats words: with h = crc32 of the decimal id and g = h div 10, where 10 divides h each
    word i >= a becomes word a + (i - a) mod p, for a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Rows without an id stay."""
    small_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema
    ident, text = names.index(id_col), names.index(text_col)

    def planted(batches):
        for b in batches:
            out = []
            for k, t in zip(b.column(ident).to_pylist(), b.column(text).to_pylist()):
                h = zlib.crc32(str(k).encode()) if k is not None else 1
                if h % 10 == 0 and t is not None and (some := t.encode().split()):
                    g, n = h // 10, len(some)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    some[a:] = [some[a + j % p] for j in range(n - a)]
                    t = b" ".join(some).decode()
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == text else c for k, c in enumerate(b.columns)], names)

    return docs.mapInArrow(planted, schema)


def longest_run(runs: Column) -> Column:
    """The run with the greatest length; of equal ones the first, then the one of the smaller period; null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document; see collapse_runs for odd rows. A row without an id keeps its words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = collapse_runs(with_repeats(docs)).select("doc_id", "runs", "kept_text", longest_run(F.col("runs")).alias("best"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
