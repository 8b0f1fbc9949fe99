"""Keyed aggregation over many sliding windows at once.

A record at tick t belongs to [t, t+1). A timescale (w, i) registered at s fires at e = s + k*i, k >= 1, over [e-w, e) cut
off at s. Windows are aligned by their end; those that begin before s are reported with what there is."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.aggregates import Aggregate, presence
from tidewheel.plans.epochs import EpochPlan, TooLarge
from tidewheel.plans.horizon import HorizonPlan
from tidewheel.plans.sharing import Options, SharePlan, cost_groups, edges_per_tick
from tidewheel.plans.timescale import Live, Registry, Timescale

#: Rows of driver-built plan tables that are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 100_000


def tick_of(ts, origin: str, unit_s: int = 1) -> Column:
    """The tick of a timestamp: whole units since origin, rounded down."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    us = F.unix_micros(ts.cast("timestamp")) - F.unix_micros(F.lit(origin).cast("timestamp"))
    return F.floor(us / F.lit(unit_s * 1_000_000)).cast("long")


def slice_end(tick: Column, lives: list[Live]) -> Column:
    """The end of the slice that holds a tick: the nearest edge after it of any life that still fires (2^62 if none does).

    One expression a life, so it does not depend on the length of the common period."""

    def edge(x: Live) -> Column:
        t, s = tick - F.lit(x.since), x.scale
        c = F.pmod(t, F.lit(s.i))
        step = F.when(c < s.turn, s.turn).otherwise(s.i) if s.turn else F.lit(s.i)
        after = tick - c + step
        out = F.when(t < 0, F.lit(x.since)).otherwise(after).cast("long")
        return out if x.until is None else F.when(tick < x.until, out).otherwise(F.lit(2**62))

    edges = [edge(x) for x in lives]
    return F.least(*edges) if len(edges) > 1 else edges[0]


def active_end(tick: Column, lives: list[Live]) -> Column:
    """slice_end for coarser slices, which are cut only where windows begin; those that end inside one read what it holds so far."""

    def edge(x: Live) -> Column:
        t, s = tick - F.lit(x.since), x.scale
        c = F.pmod(t, F.lit(s.i))
        step = F.when(c < s.turn, s.turn).otherwise(s.i + s.turn) if s.turn else F.lit(s.i)
        out = F.when(t < 0, F.lit(x.since)).otherwise(tick - c + step).cast("long")
        return out if x.until is None else F.when(tick < x.until, out).otherwise(F.lit(2**62))

    edges = [edge(x) for x in lives]
    return F.least(*edges) if len(edges) > 1 else edges[0]


def _lives(registry: Registry) -> Column:
    return F.array(*[F.struct(F.lit(x.scale.w).cast("long").alias("w"), F.lit(x.scale.i).cast("long").alias("i"), F.lit(x.since).cast("long").alias("since"), F.lit(x.until).cast("long").alias("gone"), F.lit(k).alias("life")) for k, x in enumerate(registry.lives)])


def fanned(df: DataFrame, end: str, registry: Registry, until: Column, name: str, groups: list[int] | None = None) -> DataFrame:
    """df once for every window that the span of ticks ending at column `end` feeds; adds w, i, since, life and the window's end.

    The span lies between edges, so it is in a window wholly or not at all: end <= e < end + w. groups: the group of each
    life, where rows of df are for the lives of the group in _group only."""
    life = df.withColumn("_life", F.explode(_lives(registry))).where(F.col(end) > F.col("_life.since"))
    if groups is not None:
        life = life.where(F.element_at(F.array(*map(F.lit, groups)), F.col("_life.life") + 1) == F.col("_group"))
    since, i, w = F.col("_life.since"), F.col("_life.i"), F.col("_life.w")
    first = since + F.ceil((F.col(end) - since) / i) * i
    last = F.least(F.col(end) + w - 1, until, F.coalesce(F.col("_life.gone"), until))
    out = life.withColumn(name, F.explode(F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), i))))
    return out.select("*", w.alias("w"), i.alias("i"), since.alias("_since"), F.col("_life.life").alias("_n_life")).drop("_life")


def last_tick(df: DataFrame, tick: str) -> int:
    """The tick at which the last record's interval closes; 0 without records."""
    top = df.agg(F.max(tick)).first()[0]
    return 0 if top is None else int(top) + 1


def _named(df: DataFrame, keys: list[str], agg: Aggregate) -> DataFrame:
    """Result columns: w, i, window_start (cut off), window_end, keys, results, nominal_start, fully_processed."""
    nominal = F.col("window_end") - F.col("w")
    since = F.col("_since")
    return df.select("w", "i", F.greatest(nominal, since).alias("window_start"), "window_end", *keys, *agg.finals(), nominal.alias("nominal_start"), (nominal >= since).alias("fully_processed"))


#: Rounds that a plan over absolute time takes at most: each is a shuffle.
LEVELS = 3
#: Ticks over which windows are listed without a look at where the records end.
LISTED = 1_000_000
#: Rows of one group that are gathered at a time, for aggregates that gather rows.
GATHERED = 1024


def folded(rows: DataFrame, by: list[str], agg: Aggregate) -> DataFrame:
    """Buffers of rows by group. Aggregates that gather rows fold at most GATHERED of one group at a time, and their results in steps."""
    if not agg.gathers:
        return rows.groupBy(*by).agg(*agg.partials())
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    # Numbers of rows go up by one within a partition, whose number is in the bits from 33 on.
    out = rows.withColumn("_part", F.floor(F.col("_row") / GATHERED)).groupBy(*by, "_part").agg(*agg.partials())
    for size in (GATHERED, 2**33 // GATHERED**2):
        out = out.withColumn("_part", F.floor(F.col("_part") / size)).groupBy(*by, "_part").agg(*agg.merges())
    return out.groupBy(*by).agg(*agg.merges())


def partials(df: DataFrame, registry: Registry, keys: list[str], agg: Aggregate, tick: str) -> DataFrame:
    """One row for each slice and key that has records: _end, keys, buffers."""
    cut = df.where(F.col(tick) >= min(x.since for x in registry.lives)).withColumn("_end", slice_end(F.col(tick).cast("long"), registry.lives))
    return folded(cut, ["_end", *keys], agg)


def _fan_out(registry: Registry) -> float:
    """To how many windows a record belongs."""
    return sum(x.scale.w / x.scale.i for x in registry.lives)


#: Estimated bytes of input, times the windows that a record belongs to, up to which one shuffle beats slicing first.
SMALL = 256 << 20


def mode_costs(registry: Registry) -> dict[str, float]:
    """Rows a tick and key that slices and the tree hand out and merge, besides reading the records. How many keys and ticks there
    are multiplies both alike, so the choice between them needs no look at the data."""
    scales = [x.scale for x in registry.lives]
    low = min(x.since for x in registry.lives)
    unit = math.gcd(*(n for x in registry.lives for n in (x.scale.w, x.scale.i, x.since - low)))
    levels = max(t.w // unit for t in scales).bit_length() + 1
    picked = sum(min(t.w / unit, 2 * math.log2(t.w / unit) + 1) / t.i for t in scales)
    # The tree's windows meet its nodes in a join: a row there costs about three of those that are only handed out.
    return {"slices": edges_per_tick(scales) * _fan_out(registry), "tree": levels / unit + 3 * picked}


def choose_mode(df: DataFrame, registry: Registry) -> str:
    """naive for inputs so small that a second shuffle costs more than handing records to all their windows; else slices or tree."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size * _fan_out(registry) < SMALL:
        return "naive"
    costs = mode_costs(registry)
    return min(costs, key=costs.get)


def multi_window(df: DataFrame, timescales, keys: list[str], agg: Aggregate, tick: str = "tick", start: int = 0, until: int | None = None, mode: str = "auto", watch: Callable[[str, DataFrame], DataFrame] | None = None, **plan) -> DataFrame:
    """The aggregate of every window of every timescale, by key; windows without records of a key have no row of it.

    timescales: text, pairs or a Registry. until: the last tick at which windows fire (default: when the last record's
    tick closes). mode: "naive" (each record goes to all its windows), "slices" (records are aggregated by slice once,
    slices go to windows), "active" (the same with fewer slices, cut only where windows begin, and open ones read by record), "auto" (one of these, see choose_mode), "greedy", "dp" or "adaptive" (windows also from windows, by
    EpochPlan, whose size does not follow the time span, or by the tree where that is too large; with options of SharePlan by it), "grouped" (timescales that gain by it slice together, from one set of common slices), "tree" (slices in a
    tree of merges, of which each window reads a few nodes). All modes give the same rows, for timescales that come and go
    as well. Records before start are left out.

    watch: gets "records", "slices", "handed" (rows that windows are merged from) and "windows" with their rows as they
    are made, and returns these; see metrics.Watch."""
    watch = watch or (lambda name, rows: rows)
    registry = Registry.of(timescales, start)
    if not registry.lives:
        raise ValueError("no timescales")
    if agg.value is not None:
        # Distinct values are a key first, so that no buffer holds them; then they are gathered by window.
        held = multi_window(df.withColumn("_value", agg.value), registry, [*keys, "_value"], presence(), tick, until=until, mode=mode, watch=watch, **plan)
        window = ["w", "i", "window_start", "window_end", "nominal_start", "fully_processed"]
        out = held.groupBy(*window, *keys).agg(*agg.gathered())
        return out.select("w", "i", "window_start", "window_end", *keys, *agg.final, "nominal_start", "fully_processed")
    if mode == "auto":
        mode = choose_mode(df, registry)
    last = last_tick(df, tick) if until is None else until
    end = F.lit(last).cast("long")
    by = ["w", "i", "_since", "_n_life", "window_end", *keys]
    if mode == "tree":
        return _by_tree(df, registry, keys, agg, tick, last, watch)
    df = watch("records", df)
    if mode == "naive":
        low = min(x.since for x in registry.lives)
        rows = df.where(F.col(tick) >= low).withColumn("_end", F.col(tick).cast("long") + 1)
        rows = watch("handed", fanned(rows, "_end", registry, end, "window_end"))
        return watch("windows", _named(folded(rows, by, agg), keys, agg))
    if mode == "active":
        low = min(x.since for x in registry.lives)
        rows = df.where(F.col(tick) >= low).withColumn("_end", active_end(F.col(tick).cast("long"), registry.lives))
        whole = fanned(watch("slices", folded(rows, ["_end", *keys], agg)), "_end", registry, end, "window_end")
        # A window that ends inside a slice began at its start or before: of that slice it holds the records so far.
        inside = fanned(rows.withColumn("_next", F.col(tick).cast("long") + 1), "_next", registry, F.least(end, F.col("_end") - 1), "window_end")
        parts = watch("handed", folded(inside, by, agg).unionByName(whole.select(*by, *agg.partial)))
        return watch("windows", _named(parts.groupBy(*by).agg(*agg.merges()), keys, agg))
    cut = watch("slices", partials(df, registry, keys, agg, tick))
    if mode == "slices":
        wide = watch("handed", fanned(cut, "_end", registry, end, "window_end"))
        return watch("windows", _named(wide.groupBy(*by).agg(*agg.merges()), keys, agg))
    if mode == "grouped":
        numbers: dict[Timescale, list[int]] = {}
        for k, x in enumerate(registry.lives):
            numbers.setdefault(x.scale, []).append(k)
        groups = [[numbers[t].pop(0) for t in group] for group in cost_groups([x.scale for x in registry.lives])]
        wide = fanned(group_slices(cut, registry, groups, keys, agg), "_end", registry, end, "window_end", [next(g for g, some in enumerate(groups) if k in some) for k in range(len(registry.lives))])
        return _named(wide.groupBy(*by).agg(*agg.merges()), keys, agg)
    if not plan:
        try:
            shared = EpochPlan(registry, last, mode, LEVELS)
        except TooLarge:
            return _by_tree(df, registry, keys, agg, tick, last, watch)
        return _by_segments(cut, shared, registry, keys, agg)
    # Options of sharing are for timescales that live all the time.
    if len({(x.since, x.until) for x in registry.lives}) > 1:
        raise ValueError("timescales that come and go take no options of sharing")
    since, scales = registry.lives[0].since, [x.scale for x in registry.lives]
    shared = SharePlan(scales, Options(select=mode, **plan))
    stop = last if registry.lives[0].until is None else min(last, registry.lives[0].until)
    rows, schema = [(n, c, phase, p, delta) for n, p, c, phase, delta in shared.patterns()], "_level int, _c int, _phase long, _parent int, _delta long"
    known = cut.select(F.lit(-1).alias("_c"), F.col("_end").alias("_at"), *keys, *agg.partial).withColumn("_phase", F.pmod(F.col("_at") - since, F.lit(shared.period)))
    return _by_levels(known, shared.levels, rows, schema, lambda t: t.withColumn("_to", F.col("_at") + F.col("_delta")).where(F.col("_to") <= stop), registry, keys, agg, lambda t: t.withColumn("_phase", F.pmod(F.col("_at") - since, F.lit(shared.period))))


def group_slices(cut: DataFrame, registry: Registry, groups: list[list[int]], keys: list[str], agg: Aggregate) -> DataFrame:
    """Slices of each group, from common ones: a group's are unions of these, as its edges are among theirs. One row for
    each group that a common slice is in; adds _group."""
    ends = F.array(*[slice_end(F.col("_end") - 1, [registry.lives[k] for k in group]) for group in groups])
    coarse = cut.select("*", F.posexplode(ends).alias("_group", "_coarse")).where(F.col("_coarse") < 2**62)
    return coarse.groupBy("_group", F.col("_coarse").alias("_end"), *keys).agg(*agg.merges())


def _by_segments(cut: DataFrame, plan: EpochPlan, registry: Registry, keys: list[str], agg: Aggregate) -> DataFrame:
    """Executes a plan by epochs level by level: each level is one join with its rows of the plan, by phase, and one merge.

    Segments (a few for each change) are broadcast; patterns up to BROADCAST_ROWS rows a level."""
    spark, buffers = cut.sparkSession, list(agg.partial)
    if len(plan.groups) > 1:
        cut = group_slices(cut, registry, plan.groups, keys, agg)
    else:
        cut = cut.withColumn("_group", F.lit(0))
    known = cut.select(F.lit(-1).alias("_c"), F.col("_end").alias("_at"), "_group", *keys, *buffers)
    segments = spark.createDataFrame(plan.segment_rows() or [(0, -1, 0, 0, 1, 0)], "_seg int, _group int, _low long, _high long, _mod long, _reach long")
    patterns, level_of = plan.pattern_rows(), {}
    for r in patterns:
        level_of.setdefault(r[4], set()).add(r[1])
    group_of = F.array(*[F.lit(next(g for g, some in enumerate(plan.groups) if k in some)) for k in range(len(registry.lives))])

    def placed(t: DataFrame) -> DataFrame:
        """Rows once for each segment whose windows they may be in, with their phase there."""
        inside = (F.col("_at") > F.col("_low") - F.col("_reach")) & (F.col("_at") <= F.col("_high"))
        return t.join(F.broadcast(segments), "_group").where(inside).withColumn("_phase", F.pmod(F.col("_at") - F.col("_low") + F.col("_reach"), "_mod"))

    made, done = {0: placed(known)}, []
    for level in range(1, plan.levels + 1):
        mine = [r for r in patterns if r[1] == level]
        names = ("_seg", "_c", "_phase", "_parent", "_delta")
        columns = zip(*((s, c, ph, p, d) for s, _, c, ph, p, d in mine))
        table = spark.createDataFrame(pa.table({n: pa.array(c, pa.int32() if n in ("_seg", "_c", "_parent") else pa.int64()) for n, c in zip(names, columns)}))
        table = F.broadcast(table) if len(mine) <= BROADCAST_ROWS else table
        children = {r[2] for r in mine}
        needed = {0} if -1 in children else set()
        needed |= {n for c in children if c >= 0 for n in level_of.get(c, ()) if n < level}
        fed = [made[n].join(table, ["_seg", "_c", "_phase"]).withColumn("_to", F.col("_at") + F.col("_delta")).where("_to > _low AND _to <= _high") for n in sorted(needed)]
        fed = reduce(DataFrame.unionByName, [x.select("_parent", "_to", *keys, *buffers) for x in fed])
        out = fed.groupBy("_parent", "_to", *keys).agg(*agg.merges()).select(F.col("_parent").alias("_c"), F.col("_to").alias("_at"), *keys, *buffers)
        made[level] = placed(out.withColumn("_group", F.element_at(group_of, F.col("_c") + 1)))
        done.append(out)
    return _finished(done, known, registry, keys, agg)


def _by_levels(known: DataFrame, levels: int, rows: list[tuple], schema: str, reach, registry: Registry, keys: list[str], agg: Aggregate, mark=lambda t: t) -> DataFrame:
    """Executes a plan level by level: each level is one join with its rows of the plan and one merge.

    known: slices (_c, _at, keys, buffers). rows: the plan, (level, what tells a child, its parent, what leads to the
    parent's end). reach adds the parent's end, _to. A level joins only those earlier levels of which it has children."""
    spark, buffers = known.sparkSession, list(agg.partial)
    level_of: dict[int, set[int]] = {}
    for r in rows:
        level_of.setdefault(r[3], set()).add(r[0])
    names = [c.split()[0] for c in schema.split(", ")]
    on = [c for c in names[1:3] if c in known.columns] + [c for c in names[2:3] if c not in known.columns]
    made, done = {0: known}, []
    for level in range(1, levels + 1):
        mine = [r for r in rows if r[0] == level]
        table = spark.createDataFrame(mine, schema).drop("_level")
        table = F.broadcast(table) if len(mine) <= BROADCAST_ROWS else table
        children = {r[1] for r in mine}
        needed = {0} if -1 in children else set()
        needed |= {n for c in children if c >= 0 for n in level_of.get(c, ()) if n < level}
        fed = [reach(made[n].join(table, on)) for n in sorted(needed)]
        fed = reduce(DataFrame.unionByName, [x.select("_parent", "_to", *keys, *buffers) for x in fed])
        out = fed.groupBy("_parent", "_to", *keys).agg(*agg.merges()).select(F.col("_parent").alias("_c"), F.col("_to").alias("_at"), *keys, *buffers)
        made[level] = mark(out)
        done.append(out)
    return _finished(done, known, registry, keys, agg)


def planned_windows(known: DataFrame, plan: HorizonPlan, registry: Registry, keys: list[str], agg: Aggregate) -> DataFrame:
    """The windows of a plan over absolute time, from results of any finer slices (_end, keys, buffers) that reach back far enough."""
    end = slice_end(F.col("_end") - 1, registry.lives).alias("_at")
    cut = known.where(F.col("_end") > min(x.since for x in registry.lives)).groupBy(end, *keys).agg(*agg.merges())
    known = cut.select(F.lit(-1).alias("_c"), "_at", *keys, *agg.partial)
    return _by_levels(known, plan.levels, plan.edge_rows(), "_level int, _c int, _at long, _parent int, _to long", lambda t: t, registry, keys, agg)


def _finished(done: list[DataFrame], known: DataFrame, registry: Registry, keys: list[str], agg: Aggregate) -> DataFrame:
    """Windows of all levels (_c, _at, keys, buffers) as results."""
    buffers = list(agg.partial)
    if not done:
        w = F.lit(None).cast("long")
        return _named(known.where(F.lit(False)).select(w.alias("w"), w.alias("i"), w.alias("_since"), w.alias("window_end"), *keys, *buffers), keys, agg)
    every = reduce(DataFrame.unionByName, done)
    w, i, since = (F.element_at(F.array(*[F.lit(x).cast("long") for x in some]), F.col("_c") + 1) for some in zip(*((x.scale.w, x.scale.i, x.since) for x in registry.lives)))
    return _named(every.select(w.alias("w"), i.alias("i"), since.alias("_since"), F.col("_at").alias("window_end"), *keys, *buffers), keys, agg)


def _by_tree(df: DataFrame, registry: Registry, keys: list[str], agg: Aggregate, tick: str, last: int, watch) -> DataFrame:
    """Equal slices in a binary tree of merges: a window of n slices reads at most 2 log2(n) nodes.

    A slice has as many ticks as divide all windows, intervals and starts. All levels are made in one shuffle, to which a
    slice and key adds a row a level after map-side merging."""
    low = min(x.since for x in registry.lives)
    if last - low > LISTED:  # windows are listed: none that come after the last record
        last = min(last, last_tick(df, tick) + max(x.scale.w for x in registry.lives))
    unit = math.gcd(*(n for x in registry.lives for n in (x.scale.w, x.scale.i, x.since - low)))
    depth = max(x.scale.w // unit for x in registry.lives).bit_length()
    rows = watch("records", df).where(F.col(tick) >= low).withColumn("_node", F.floor((F.col(tick).cast("long") - low) / unit).cast("long"))
    leaves = watch("slices", folded(rows, ["_node", *keys], agg))
    up = leaves.withColumn("_up", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("_node", F.expr("shiftright(_node, _up)"))
    nodes = up.groupBy("_up", "_node", *keys).agg(*agg.merges())
    windows = spine(df.sparkSession, registry, low, last).withColumn("_a", F.expr(f"(window_start - {low}) div {unit}")).withColumn("_z", F.expr(f"(window_end - {low}) div {unit}"))
    wide = windows.withColumn("_up", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    wide = wide.withColumn("_a", F.expr("shiftright(_a + shiftleft(1L, _up) - 1, _up)")).withColumn("_z", F.expr("shiftright(_z, _up)")).where("_a < _z")
    left, right = F.when(F.expr("_a % 2 = 1"), F.col("_a")), F.when(F.expr("_z % 2 = 1 AND _a + _a % 2 < _z"), F.col("_z") - 1)
    top = F.col("_up") == depth  # nodes above are not made: what is left is read whole
    picked = F.when(top, F.sequence(F.col("_a"), F.col("_z") - 1)).otherwise(F.array_compact(F.array(left, right)))
    wide = wide.withColumn("_node", F.explode(picked)).select("w", "i", F.col("_life"), F.col("_since"), "window_end", "_up", "_node")
    by = ["w", "i", "_since", "_life", "window_end", *keys]
    handed = watch("handed", nodes.join(wide, ["_up", "_node"]))
    return watch("windows", _named(handed.groupBy(*by).agg(*agg.merges()), keys, agg))


def spine(spark, timescales, start: int = 0, until: int = 0) -> DataFrame:
    """(w, i, window_start, window_end, nominal_start, fully_processed, _since, _life) of every window that fires up to `until`, with records or not."""
    registry = Registry.of(timescales, start)
    life = spark.range(1).select(F.explode(_lives(registry)).alias("x"))
    last = F.least(F.lit(until).cast("long"), F.coalesce(F.col("x.gone"), F.lit(until).cast("long")))
    first = F.col("x.since") + F.col("x.i")
    ends = life.select("x", F.explode(F.when(first <= last, F.sequence(first, last, F.col("x.i")))).alias("window_end"))
    nominal = F.col("window_end") - F.col("x.w")
    return ends.select(
        F.col("x.w").alias("w"), F.col("x.i").alias("i"), F.greatest(nominal, F.col("x.since")).alias("window_start"), "window_end", nominal.alias("nominal_start"),
        (nominal >= F.col("x.since")).alias("fully_processed"), F.col("x.since").alias("_since"), F.col("x.life").alias("_life"),
    )
