"""What is done with window results: totals, the largest keys, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.operators.windows import spine

WINDOW = ["w", "i", "window_start", "window_end"]


def totals(counts: DataFrame, timescales, start: int, until: int, value: str = "n", name: str = "total") -> DataFrame:
    """The sum of `value` over all keys for every window, 0 for windows without records."""
    every = spine(counts.sparkSession, timescales, start, until)
    sums = counts.groupBy("w", "i", "window_end", "window_start").agg(F.sum(value).alias(name))
    return every.join(sums, ["w", "i", "window_end", "window_start"], "left").select(*WINDOW, F.coalesce(name, F.lit(0)).alias(name), "fully_processed")


def top_keys(counts: DataFrame, key: str, k: int = 10, value: str = "n", total: str = "total") -> DataFrame:
    """For each window its k keys with the largest value, ties by key, with their rank and the sum over all keys.

    The largest keys of each part of a window are found first, so that no window's keys meet in one task whole."""
    cut = counts.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(32)))
    inside = W.partitionBy(*WINDOW, "_part").orderBy(F.desc(value), key)
    few = cut.withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= k)
    best = few.withColumn("rank", F.row_number().over(W.partitionBy(*WINDOW).orderBy(F.desc(value), key))).where(F.col("rank") <= k)
    sums = counts.groupBy(*WINDOW).agg(F.sum(value).alias(total))
    return best.join(sums, WINDOW).select(*WINDOW, "rank", key, value, total)


def as_maps(counts: DataFrame, key: str, value: str = "n", name: str = "result") -> DataFrame:
    """One row a window with a map from key to value, as large as the window's keys."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    return counts.groupBy(*WINDOW).agg(pairs.alias(name))
