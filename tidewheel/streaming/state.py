"""All timescales in one append query, over state that is updated as records come.

Records are combined by tick and key before the shuffle and in a first state; closed ticks go to the nodes of a binary tree
over time, in a second one; a third merges each window from the few nodes that make it up. All of that is Spark's own streaming
aggregation, so it takes every aggregate. Where timescales change while the query runs, nodes wait in a keyed state of their
own, which knows the timescales and hands out what is due."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidewheel.functions.aggregates import Aggregate
from tidewheel.operators.windows import _lives, _named
from tidewheel.plans.timescale import Live, Registry, Timescale

#: Keys and buffers travel as text through the state of changing timescales; times keep their microseconds.
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Marks a time that later stages close by: it is in step with the watermark already.
_CLOSING = {"spark.watermarkDelayMs": 0}


def _at(tick: Column, origin_s: int, unit_s: int, name: str) -> Column:
    """The time of a tick as a column that state is closed by."""
    return F.timestamp_seconds(F.lit(origin_s) + tick * unit_s).alias(name, metadata=_CLOSING)


def ticks(events: DataFrame, ts: str, keys: list[str], agg: Aggregate, unit_s: int, delay: str, origin_s: int, low: int, salts: int, beat: str | None = None) -> DataFrame:
    """(_tick, keys, buffers), once the watermark has passed a tick's end; up to `salts` rows of a tick and key.

    Records of one key are combined in every task before they meet in its state. Aggregates that gather rows can't be:
    their records are dealt to `salts` states by a hash of the whole record. beat: a column that is null in records; rows
    where it is not move the watermark and are nothing else."""
    origin = F.timestamp_seconds(F.lit(origin_s))
    start = F.timestamp_seconds(F.lit(origin_s + low * unit_s))
    # Beats are left out after the watermark has seen them.
    time = F.col(ts) if beat is None else F.when(F.col(beat).isNull() & (F.rand() < 2), F.col(ts))
    marked = events.withWatermark(ts, delay).where((time >= origin) & (time >= start))
    span = F.window(ts, f"{unit_s} seconds", f"{unit_s} seconds", f"{origin_s % unit_s} seconds")
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in events.columns if not events.schema[c].dataType.simpleString().startswith(("map", "variant"))]), F.lit(salts))
    rows = marked.groupBy(span.alias("_span"), deal.alias("_salt"), *keys).agg(*agg.partials())
    tick = ((F.unix_seconds("_span.start") - origin_s) / unit_s).cast("long")
    return rows.select(tick.alias("_tick"), "_span", *keys, *agg.partial)


def nodes(closed: DataFrame, keys: list[str], agg: Aggregate, unit_s: int, origin_s: int, depth: int, leaf: Column | None = None) -> DataFrame:
    """(_up, _node, keys, buffers, _closes): nodes [_node * 2^_up, (_node + 1) * 2^_up) of a tree over ticks, each once, when it closes.

    A tick feeds a node of each of the levels 0 to depth; levels whose nodes are still open hold one buffer a key each. leaf:
    rows for which only level 0 counts."""
    up = F.sequence(F.lit(0), F.lit(depth) if leaf is None else F.when(leaf, 0).otherwise(depth))
    wide = closed.withColumn("_up", F.explode(up)).withColumn("_node", F.expr("shiftright(_tick, _up)"))
    end = F.expr("(_node + 1) * shiftleft(1L, _up)")
    wide = wide.select("_up", "_node", _at(end, origin_s, unit_s, "_closes"), *keys, *agg.partial)
    return wide.groupBy("_closes", "_up", "_node", *keys).agg(*agg.merges())


def handed_out(table: DataFrame, registry: Registry, depth: int) -> DataFrame:
    """Nodes once for every window of which they are a piece: that hold them, but not the next larger node that they are in.

    These windows' ends are one range for each timescale: a left half serves those that end within the right one, a right half
    those that begin within the left one."""
    size = F.expr("shiftleft(1L, _up)")
    life = table.withColumn("_life", F.explode(_lives(registry))).withColumn("_a", F.col("_node") * size).withColumn("_z", F.col("_a") + size)
    since, i, w = F.col("_life.since"), F.col("_life.i"), F.col("_life.w")
    life = life.where(F.col("_a") >= since)
    top, left = F.col("_up") == depth, F.col("_node") % 2 == 0
    last = F.col("_a") + w
    low = F.when(top | left | (F.col("_a") - size < since), F.col("_z")).otherwise(F.greatest(F.col("_z"), last - size + 1))
    high = F.least(F.when(top | ~left, last).otherwise(F.least(last, F.col("_z") + size - 1)), F.coalesce(F.col("_life.gone"), last))
    first = since + F.ceil((low - since) / i).cast("long") * i
    out = life.withColumn("window_end", F.explode(F.when(first <= high, F.sequence(first, high, i))))
    return out.select("*", w.alias("w"), i.alias("i"), since.alias("_since"), F.col("_life.life").alias("_n_life"))


def pieces(begin: int, end: int, depth: int) -> list[tuple[int, int]]:
    """(level, number) of the nodes that make up [begin, end), at most 2 a level below `depth`."""
    out, up = [], 0
    while begin < end and up < depth:
        if begin & 1:
            out.append((up, begin))
            begin += 1
        if end & 1:
            end -= 1
            out.append((up, end))
        begin, end, up = begin >> 1, end >> 1, up + 1
    return out + [(depth, k) for k in range(begin, end)]


class _Changing(StatefulProcessor):
    """State of a bucket of keys: nodes with what is in them, the timescales so far, and up to which tick windows are out.

    A window that is due gets its nodes looked up, 2 log2(w) at most. Nodes go when no open timescale reaches them: one that comes
    later reads only what comes later."""

    def __init__(self, lives: list[Live], depth: int, origin_s: int, unit_s: int):
        self.lives, self.depth, self.origin_s, self.unit_s = lives, depth, origin_s, unit_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.nodes = handle.getMapState("nodes", "up int, node long", "held array<string>")
        self.known = handle.getValueState("known", "lives string, out long, newest long")

    def _load(self) -> tuple[Registry, int, int]:
        if not self.known.exists():
            return Registry(0, list(self.lives)), min((x.since for x in self.lives), default=0), -1
        text, out, newest = self.known.get()
        return Registry(0, [Live(Timescale(w, i), since, until) for w, i, since, until in json.loads(text)]), out, newest

    def _save(self, registry: Registry, out: int, newest: int) -> None:
        lives = [(x.scale.w, x.scale.i, x.since, x.until) for x in registry.lives]
        self.known.update((json.dumps(lives), out, newest))

    def _wake(self, registry: Registry, out: int, newest: int) -> None:
        """A timer for the next firing, while a window to come may hold a record."""
        due = []
        for x in registry.lives:
            at = x.since + max(1, (out - x.since) // x.scale.i + 1) * x.scale.i
            if (x.until is None or at <= x.until) and at - x.scale.w <= newest:
                due.append(at)
        if due:
            self.handle.registerTimer((self.origin_s + min(due) * self.unit_s) * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        registry, out, newest = self._load()
        got, told = {}, []
        for frame in rows:
            for kind, w, i, up, node, held in zip(frame["kind"], frame["w"], frame["i"], frame["up"], frame["node"], frame["held"]):
                if kind:
                    told.append((int(w), int(i), int(kind), int(node)))
                else:
                    got.setdefault((int(up), int(node)), []).append(held)
                    newest = max(newest, ((int(node) + 1) << int(up)) - 1)
        for w, i, kind, at in sorted(set(told), key=lambda s: (s[3], s[2])):
            if kind == 1:
                registry.add((w, i), at)
            elif any(x.scale == Timescale(w, i) and x.until is None and x.since <= at for x in registry.lives):
                registry.remove((w, i), at)
        for node, held in got.items():
            old = self.nodes.getValue(node)[0] if self.nodes.containsKey(node) else []
            self.nodes.updateValue(node, ([*old, *held],))
        self._save(registry, out, newest)
        self._wake(registry, out, newest)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = (timerValues.getCurrentWatermarkInMs() // 1000 - self.origin_s) // self.unit_s
        registry, out, newest = self._load()
        if upto <= out:
            yield pd.DataFrame()
            return
        rows = []
        for n, x in enumerate(registry.lives):
            last = upto if x.until is None else min(upto, x.until)
            last = min(last, newest + x.scale.w)  # later ones hold nothing
            for end in range(x.since + max(1, (out - x.since) // x.scale.i + 1) * x.scale.i, last + 1, x.scale.i):
                for node in pieces(max(x.since, end - x.scale.w), end, self.depth):
                    if self.nodes.containsKey(node):
                        rows += [(x.scale.w, x.scale.i, x.since, n, end, held) for held in self.nodes.getValue(node)[0]]
        reach = min((max(x.since, upto + 1 - x.scale.w) for x in registry.lives if x.until is None or x.until > upto), default=upto)
        for node, _ in list(self.nodes.iterator()):
            if (node[1] + 1) << node[0] <= reach:
                self.nodes.removeKey(tuple(node))
        open_ = [x for x in registry.lives if x.until is None or x.until > upto]
        gone = [x for x in registry.lives if not (x.until is None or x.until > upto)]
        # Numbers of lives tell equal timescales of one start apart; those that ended stay, as few as the changes are.
        self._save(registry if open_ or gone else Registry(0), upto, newest)
        self._wake(registry, upto, newest)
        if rows:
            out_rows = pd.DataFrame(rows, columns=["w", "i", "_since", "_n_life", "window_end", "held"])
            out_rows.insert(0, "fires", pd.to_datetime(self.origin_s + out_rows["window_end"] * self.unit_s, unit="s"))
            yield out_rows
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def windows_in_state(events: DataFrame, ts: str, timescales, keys: list[str], agg: Aggregate, unit_s: int, delay: str, origin_s: int = 0, mode: str = "tree", salts: int | None = None, signals: DataFrame | None = None, largest: int | None = None, buckets: int | None = None, beats: DataFrame | None = None) -> DataFrame:
    """Every window of every timescale once, in append mode, when the watermark passes its end; columns of multi_window.

    Takes every aggregate. Timescales may be a Registry whose lives come and go. mode: "tree" (a window is merged from at
    most 2 log2(w) nodes of a key) or "ticks" (from its ticks). salts: into how many states the records of a tick and key
    are dealt at first (default: 1; for aggregates that gather rows, spark.sql.shuffle.partitions).

    signals: a stream of changes (window, interval, type, start_time) with type 1 to add and 2 to remove, as of
    sources.signals. They take effect in the running query at their start_time, and have to come before the watermark
    passes it, as records do; a removal still fires at its own tick; a removal of what is not there, and repeated signals,
    do nothing. They need `largest`, the largest window that may come, and the RocksDB state store; keys are dealt to
    `buckets` states (default: spark.sql.shuffle.partitions), and signals go to each.

    beats: a stream with a column of times, such as sources.generators.beats(): each moves the watermark on as a record of
    its time would, so windows fire by the clock while the source is idle.

    Records before the origin, without a time, or not later than the watermark are left out; null keys are a key; empty
    windows don't fire. Output comes with the micro-batch in which the watermark passes."""
    if mode not in ("tree", "ticks"):
        raise ValueError(f"mode is tree or ticks, not {mode!r}")
    spark, registry = events.sparkSession, Registry.of(timescales) if timescales else Registry(0)
    if not registry.lives and signals is None:
        raise ValueError("no timescales")
    if signals is not None and largest is None:
        raise ValueError("signals need the largest window that may come")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = (parts if agg.gathers else 1) if salts is None else salts
    largest = max([largest or 0, *(x.scale.w for x in registry.lives)])
    depth = largest.bit_length() - 1 if mode == "tree" else 0
    low = 0 if signals is not None else min(x.since for x in registry.lives)
    buffers = list(agg.partial)
    beat = None
    if beats is not None:
        beat, kind = "_beat", events.schema[ts].dataType
        # Neither a constant nor deterministic: else the optimizer would leave beats out before the watermark sees them.
        ticking = beats.select(F.col(beats.columns[0]).cast(kind).alias(ts), F.when(F.rand() < 2, True).alias(beat))
        events = events.withColumn(beat, F.lit(None).cast("boolean")).unionByName(ticking, allowMissingColumns=True)
    if signals is None:
        closed = ticks(events, ts, keys, agg, unit_s, delay, origin_s, low, salts, beat)
        # Ticks are nodes of level 0, in as many rows as there are salts.
        made = nodes(closed, keys, agg, unit_s, origin_s, depth) if depth else closed.withColumn("_up", F.lit(0)).withColumnRenamed("_tick", "_node")
        wide = handed_out(made, registry, depth)
        by = ["w", "i", "_since", "_n_life", "window_end", *keys]
        wide = wide.select(_at(F.col("window_end"), origin_s, unit_s, "_fires"), *by, *buffers)
        return _named(wide.groupBy("_fires", *by).agg(*agg.merges()), keys, agg)
    buckets = parts if buckets is None else buckets
    told = signals.select(
        F.timestamp_seconds(F.lit(origin_s) + F.col("start_time") * unit_s).cast(events.schema[ts].dataType).alias(ts),
        F.struct(F.col("type").cast("int").alias("kind"), F.col("window").cast("long").alias("w"), F.col("interval").cast("long").alias("i"), F.col("start_time").cast("long").alias("at")).alias("_signal"),
    )
    both = events.withColumn("_signal", F.lit(None).cast(told.schema["_signal"].dataType)).unionByName(told, allowMissingColumns=True)
    closed = ticks(both, ts, ["_signal", *keys], agg, unit_s, delay, origin_s, low, salts, beat)
    is_signal = F.col("_signal").isNotNull()
    made = nodes(closed, ["_signal", *keys], agg, unit_s, origin_s, depth, is_signal)
    shape = StructType([made.schema[c] for c in (*keys, *buffers)])
    who = F.pmod(F.xxhash64(*keys, F.lit(0)), F.lit(buckets))
    routed = made.withColumn("bucket", F.explode(F.when(is_signal, F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<long>")).otherwise(F.array(who.cast("long")))))
    routed = routed.select(
        "_closes", "bucket", F.coalesce("_signal.kind", F.lit(0)).alias("kind"), F.coalesce("_signal.w", F.lit(0)).cast("long").alias("w"), F.coalesce("_signal.i", F.lit(0)).cast("long").alias("i"),
        F.col("_up").cast("int").alias("up"), F.coalesce("_signal.at", "_node").alias("node"), F.to_json(F.struct(*keys, *buffers), _JSON).alias("held"),
    )
    out = "fires timestamp, w long, i long, _since long, _n_life long, window_end long, held string"
    due = routed.groupBy("bucket").transformWithStateInPandas(_Changing(registry.lives, depth, origin_s, unit_s), out, "append", "eventTime", eventTimeColumnName="fires")
    back = {k: v for k, v in _JSON.items() if k != "ignoreNullFields"}
    due = due.withColumn("held", F.from_json("held", shape, back))
    by = ["w", "i", "_since", "_n_life", "window_end", *keys]
    rows = due.select("fires", "w", "i", "_since", "_n_life", "window_end", *[F.col("held")[c].alias(c) for c in (*keys, *buffers)])
    return _named(rows.groupBy("fires", *by).agg(*agg.merges()), keys, agg)
