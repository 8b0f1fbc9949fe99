"""The same windows over streams.

windows_by_time: one native window aggregation a timescale, in append mode, bounded by the watermark.
live_windows: all timescales in one query, in complete mode.
WindowStream: a sink for foreachBatch that keeps slice results in tables and emits windows once their ticks are past; its
timescales may come and go while it runs, and a batch that is run again replaces what it wrote."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.aggregates import Aggregate
from tidewheel.operators.windows import LEVELS, _named, fanned, planned_windows, tick_of
from tidewheel.plans.horizon import HorizonPlan
from tidewheel.plans.timescale import Registry, as_timescales
from tidewheel.sources.signals import registry_of


def windows_by_time(events: DataFrame, ts: str, timescales, keys: list[str], agg: Aggregate, unit_s: int, delay: str, origin_s: int = 0) -> DataFrame:
    """events must hold a TIMESTAMP; windows (w, i) of unit_s seconds a tick end at origin_s + k*i ticks.

    Records before the origin are left out, and so are windows that end by it; those that begin before it come with what
    there is. Empty windows don't fire."""
    marked = events.where(F.col(ts) >= F.timestamp_seconds(F.lit(origin_s))).withWatermark(ts, delay)

    def one(t) -> DataFrame:
        w, i = t.w * unit_s, t.i * unit_s
        span = F.window(ts, f"{w} seconds", f"{i} seconds", f"{(origin_s - w) % i} seconds")
        rows = marked.groupBy(span.alias("_span"), *keys).agg(*agg.partials())
        end = ((F.unix_seconds("_span.end") - origin_s) / unit_s).cast("long")
        return rows.select(F.lit(t.w).cast("long").alias("w"), F.lit(t.i).cast("long").alias("i"), F.greatest(end - t.w, F.lit(0)).cast("long").alias("window_start"), end.alias("window_end"), *keys, *agg.finals())

    return reduce(DataFrame.unionByName, [one(t) for t in as_timescales(timescales)])


def live_windows(events: DataFrame, ts: str, timescales, keys: list[str], agg: Aggregate, unit_s: int, origin: str, until: int) -> DataFrame:
    """Every window of every timescale up to tick `until`, for output mode complete; state holds all windows."""
    registry = Registry.of(timescales)
    rows = events.withColumn("_end", tick_of(ts, origin, unit_s) + 1).where("_end > 0")
    rows = fanned(rows, "_end", registry, F.lit(until).cast("long"), "window_end")
    return _named(rows.groupBy("w", "i", "_since", "_n_life", "window_end", *keys).agg(*agg.partials()), keys, agg)


#: Edges of the plan of one batch; a batch that needs more hands slices to windows.
MOST_EDGES = 100_000


class WindowStream:
    """query = events.writeStream.foreachBatch(WindowStream(...)).option("checkpointLocation", ...).start()

    path holds slices/batch=n (results by tick and key, deleted when no live window reaches them any more), closed/batch=n
    (the tick up to which windows are out) and out/batch=n. A record later than `late` ticks behind the newest one may miss windows that are out already.
    signals: path of a signal table, read at each batch; timescales that it adds see the slices since their start.

    select: "slices" (each window from slices), "greedy" or "dp" (a batch's windows also from each other, by a plan of just
    these) or "adaptive": dp while planning has taken at most `threshold` of the seconds that making and writing windows
    took in all batches so far, else greedy. All give the same rows. planning_s and final_s hold what `clock` measured
    since this object was made, selected what the last batch took."""

    def __init__(self, path: str, timescales, keys: list[str], agg: Aggregate, tick: str = "tick", late: int = 0, signals: str | None = None, start: int = 0, select: str = "slices", threshold: float = 0.05, clock: Callable[[], float] = time.perf_counter):
        if select not in ("slices", "greedy", "dp", "adaptive"):
            raise ValueError(f"select is slices, greedy, dp or adaptive, not {select!r}")
        self.path, self.timescales, self.keys, self.agg = path.rstrip("/"), timescales, keys, agg
        self.tick, self.late, self.signals, self.start = tick, late, signals, start
        self.select, self.threshold, self.clock = select, threshold, clock
        self.planning_s, self.final_s, self.selected = 0.0, 0.0, None

    def _registry(self, spark: SparkSession) -> Registry:
        registry = Registry.of(as_timescales(self.timescales), self.start)
        return registry if self.signals is None else registry_of(spark.read.parquet(self.signals), registry, self.start)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slices = batch.groupBy((F.col(self.tick).cast("long") + 1).alias("_end"), *self.keys).agg(*self.agg.partials())
        slices.write.mode("overwrite").parquet(f"{self.path}/slices/batch={number}")
        mine = spark.read.parquet(f"{self.path}/slices/batch={number}")
        newest = mine.agg(F.max("_end")).first()[0]
        closed = self._closed(spark, number)
        self._emit(spark, number, closed, closed if newest is None else max(closed, newest - 1 - self.late))
        self.clean(spark, number)

    def _closed(self, spark: SparkSession, number: int) -> int:
        """Up to where batches before this one have emitted."""
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/closed")
        if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            return self.start
        top = spark.read.parquet(f"{self.path}/closed").where(F.col("batch") < number).agg(F.max("upto")).first()[0]
        return self.start if top is None else top

    def _emit(self, spark: SparkSession, number: int, closed: int, upto: int) -> None:
        registry = self._registry(spark)
        reach = max(x.scale.w for x in registry.lives)
        known = spark.read.parquet(f"{self.path}/slices").where((F.col("batch") <= number) & (F.col("_end") > closed - reach) & (F.col("_end") <= upto)).drop("batch")
        began = self.clock()
        plan = self._plan(registry, closed, upto)
        planned = self.clock()
        if plan is None:
            wide = fanned(known, "_end", registry, F.lit(upto).cast("long"), "window_end").where(F.col("window_end") > closed)
            done = _named(wide.groupBy("w", "i", "_since", "_n_life", "window_end", *self.keys).agg(*self.agg.merges()), self.keys, self.agg)
        else:
            done = planned_windows(known, plan, registry, self.keys, self.agg)
        done.write.mode("overwrite").parquet(f"{self.path}/out/batch={number}")
        self.planning_s += planned - began
        self.final_s += self.clock() - planned
        spark.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/closed/batch={number}")

    def _plan(self, registry: Registry, closed: int, upto: int) -> HorizonPlan | None:
        """The plan of the windows that fire in (closed, upto]; None where slices go to windows."""
        self.selected = self.select
        if self.select == "adaptive":
            self.selected = "dp" if self.planning_s <= self.threshold * self.final_s else "greedy"
        if self.selected == "slices":
            return None
        plan = HorizonPlan(registry, closed, self.selected, LEVELS, after=closed)
        step, edges = max(x.scale.i for x in registry.lives), 0
        for at in range(closed, upto, step):
            before = len(plan.spans)
            plan.extend(min(upto, at + step))
            edges += sum(len(s.children) for s in islice(plan.spans.values(), before, None))
            if edges > MOST_EDGES:
                self.selected = "slices"
                return None
        return plan

    def clean(self, spark: SparkSession, number: int) -> int:
        """Deletes slices of batches before `number` that no live window reached any more when it began, so that `number` can
        be run again, and all earlier notes of what is out but the last; returns how many batches of slices went. Each batch does
        so at its end."""
        closed, registry = self._closed(spark, number), self._registry(spark)
        keep = closed - max((x.scale.w for x in registry.lives if x.until is None or x.until > closed), default=0)
        old = spark.read.parquet(f"{self.path}/slices").where(F.col("batch") < number).groupBy("batch").agg(F.max("_end").alias("top")).where(F.col("top") <= keep).collect()
        notes = sorted(r["batch"] for r in spark.read.parquet(f"{self.path}/closed").where(F.col("batch") < number).select("batch").distinct().collect())
        jvm = spark.sparkContext._jvm
        for name in [*(f"slices/batch={r['batch']}" for r in old), *(f"closed/batch={n}" for n in notes[:-1])]:
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return len(old)

    def flush(self, spark: SparkSession, number: int, upto: int) -> None:
        """Emits what is due up to `upto`, as batch `number`, once no more records come."""
        closed = self._closed(spark, number)
        self._emit(spark, number, closed, max(closed, upto))

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/out").drop("batch")
