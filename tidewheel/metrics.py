"""Counts and times of plans as they are executed, and what executors hold meanwhile."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewheel.operators.windows import multi_window


class Times:
    """Seconds by name, summed up."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def measure(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began


def observed(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """df whose rows are counted as they pass, and where the count is found after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class Watch:
    """multi_window(..., watch=Watch()) counts the rows of each step as the first action executes them.

    A step that the plan executes twice, or a task that is run again, counts once: Spark keeps the counts of successful tasks."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def __call__(self, name: str, rows: DataFrame) -> DataFrame:
        out, self.seen[name] = observed(rows, f"{name}-{id(self)}")
        return out

    def counts(self) -> dict[str, int]:
        """Rows by step, after an action on the result."""
        return {name: seen.get["rows"] for name, seen in self.seen.items()}


def merge_counts(df: DataFrame, timescales, keys, agg, tick: str, until: int, mode: str = "slices") -> dict[str, int]:
    """Records read, slices stored, rows handed to windows (each one merge) and windows made, by executing a mode of multi_window."""
    watch = Watch()
    multi_window(df, timescales, keys, agg, tick, until=until, mode=mode, watch=watch).write.format("noop").mode("overwrite").save()
    return watch.counts()


def executor_memory(spark: SparkSession) -> dict[str, dict[str, int]]:
    """By executor's address: bytes of storage memory used and there, and running tasks, as the driver knows them just now."""
    out = {}
    for x in spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos():
        out[f"{x.host()}:{x.port()}"] = {
            "used": x.usedOnHeapStorageMemory() + x.usedOffHeapStorageMemory(), "total": x.totalOnHeapStorageMemory() + x.totalOffHeapStorageMemory(), "tasks": x.numRunningTasks(),
        }
    return out
