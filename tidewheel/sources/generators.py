"""Generated input: random words, Zipf words, random timescales."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.plans.slices import period
from tidewheel.plans.timescale import Timescale


def random_words(df: DataFrame, digits: int = 4, seed: int = 0, name: str = "word") -> DataFrame:
    """Adds a random word of hexadecimal digits."""
    return df.withColumn(name, F.lpad(F.lower(F.hex(F.floor(F.rand(seed) * 16**digits).cast("long"))), digits, "0"))


def zipf_rank(keys: int, constant: float = 0.99, seed: int = 0) -> Column:
    """A rank from 0 to keys - 1 whose frequency falls as (rank + 1)^-constant, by the inverse of the continuous distribution."""
    u, n = F.rand(seed), float(keys)
    if abs(constant - 1) < 1e-9:
        x = F.exp(u * F.log(F.lit(n + 1)))
    else:
        e = 1 - constant
        x = F.pow(u * ((n + 1) ** e - 1) + 1, F.lit(1 / e))
    return F.least(F.floor(x) - 1, F.lit(keys - 1)).cast("long")


def zipf_words(spark: SparkSession, rows: int, keys: int = 500, constant: float = 0.99, per_tick: int = 20_000, seed: int = 0) -> DataFrame:
    """(tick, word): rows in order, per_tick of them a tick."""
    return spark.range(rows).select(F.floor(F.col("id") / per_tick).cast("long").alias("tick"), F.concat(F.lit("w"), zipf_rank(keys, constant, seed)).alias("word"))


def rate_stream(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """A stream (timestamp, value) at a steady rate, for random_words or zipf_rank."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def beats(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A stream of the clock's times, which lets windows of an idle source fire (see streaming.state)."""
    return rate_stream(spark, per_second).select("timestamp")


def random_timescales(n: int, windows: tuple[int, int], intervals: tuple[int, int], seed: int = 0, max_period: int | None = None, divisors_of: int | None = None) -> list[Timescale]:
    """n timescales with different windows; the common period stays within max_period. With divisors_of, intervals divide it."""
    r, out = random.Random(seed), []
    choice = [i for i in range(intervals[0], intervals[1] + 1) if divisors_of is None or divisors_of % i == 0]
    for _ in range(1000 * n):
        if len(out) == n:
            break
        w, i = r.randint(*windows), r.choice(choice)
        if i <= w and all(t.w != w for t in out) and (max_period is None or period([*out, Timescale(w, i)]) <= max_period):
            out.append(Timescale(w, i))
    if len(out) < n:
        raise ValueError("no such set of timescales found")
    return sorted(out, key=lambda t: (t.w, t.i))
