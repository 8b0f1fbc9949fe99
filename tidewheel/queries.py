"""Queries over the sample tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.functions import aggregates as A
from tidewheel.operators import countwin, dataflow, postops
from tidewheel.operators.windows import fanned, last_tick, multi_window, slice_end, tick_of
from tidewheel.plans.slices import SlicePlan
from tidewheel.plans.timescale import Registry
from tidewheel.sources import text

ORIGIN = "2024-01-01"
SCALES = "(5,4)(6,6)(24,6)(48,10)"
NESTED = "(4,2)(8,4)(10,5)(16,4)"
#: Later than any tick: every window that holds a record fires.
ALL = 2**62
# Words that the word queries leave out.
STOP_WORDS = ("the", "of", "and", "to", "a", "in", "is", "on")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their hour as tick."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("tick", tick_of("ts", ORIGIN, 3600))


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the days since 1992-01-01 as tick."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("tick", F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long"))


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all conversation turns; a tick is ten conversations."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.floor(F.col("conv_id") / 10).cast("long").alias("tick"), F.coalesce("text", F.lit("")).alias("line"))
    return said.transform(dataflow.split_then_filter("line", STOP_WORDS)).select("tick", "word")


def _hourly(aggregate, mode: str = "auto", scales: str = SCALES, **plan):
    """aggregate makes the aggregate once there is a session."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        agg = aggregate()
        out = multi_window(events(spark, sf_dir), scales, ["event_type"], agg, until=ALL, mode=mode, **plan)
        return out.select("w", "i", "window_end", "event_type", *agg.final)

    return query


_HOUR = f"CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) / 3600000000) AS BIGINT)"


def _with(scales: str, value: str, having: str = "events", extra: str = "") -> str:
    pairs = ", ".join(f"({w},{i})" for w, i in ((t.w, t.i) for t in SlicePlan(scales).scales))
    return f"""
WITH s(w, i) AS (VALUES {pairs}),
ev AS (SELECT *, {_HOUR} AS t FROM {having}),
top AS (SELECT max(t) AS last FROM ev),
sp AS (SELECT w, i, e FROM s, top, LATERAL (SELECT unnest(range(i, last + w + 1, i)) AS e))
SELECT CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, CAST(e AS BIGINT) AS window_end, event_type, {value}
FROM sp JOIN ev ON t >= e - w AND t < e{extra} GROUP BY w, i, e, event_type"""


_COUNT = "count(*) AS n"


def mts_sum_value(spark, sf_dir):
    cents = events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return multi_window(cents, SCALES, ["event_type"], A.total("cents", "total_cents"), until=ALL).select("w", "i", "window_end", "event_type", "total_cents")


def mts_avg(spark, sf_dir):
    """The mean in cents: whole sums, so that the order of addition can't show."""
    cents = events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return multi_window(cents, SCALES, ["event_type"], A.avg("cents", "mean_cents"), until=ALL).select("w", "i", "window_end", "event_type", "mean_cents")


def mts_avg_trunc(spark, sf_dir):
    whole = events(spark, sf_dir).withColumn("whole", F.floor("value").cast("long") - 20)
    return multi_window(whole, SCALES, ["event_type"], A.avg_trunc("whole", "mean"), until=ALL).select("w", "i", "window_end", "event_type", "mean")


def mts_uniq_set(spark, sf_dir):
    some = events(spark, sf_dir).withColumn("weekday", F.pmod("user_id", F.lit(7)))
    out = multi_window(some, SCALES, ["event_type"], A.uniq("weekday", "found"), until=ALL)
    return out.select("w", "i", "window_end", "event_type", F.array_join("found", ",").alias("found"))


def mts_topk(spark, sf_dir):
    counts = multi_window(events(spark, sf_dir), SCALES, ["user_id"], A.count(), until=ALL)
    return postops.top_keys(counts, "user_id", 10).select("w", "i", "window_end", "rank", "user_id", "n", "total")


def mts_totals(spark, sf_dir):
    counts = multi_window(events(spark, sf_dir), SCALES, ["event_type"], A.count(), until=ALL)
    return postops.totals(counts, SCALES, 0, last_tick(events(spark, sf_dir), "tick")).select("w", "i", "window_start", "window_end", "total", "fully_processed")


def mts_map_view(spark, sf_dir):
    counts = multi_window(events(spark, sf_dir), SCALES, ["event_type"], A.count(), until=ALL)
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("result")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return postops.as_maps(counts, "event_type").select("w", "i", "window_end", pairs.alias("result"))


def mts_fully_processed(spark, sf_dir):
    out = multi_window(events(spark, sf_dir), SCALES, ["event_type"], A.count(), until=ALL)
    return out.select("w", "i", "window_start", "window_end", "nominal_start", "event_type", "n", "fully_processed")


def mts_late_start(spark, sf_dir):
    out = multi_window(events(spark, sf_dir), SCALES, ["event_type"], A.count(), start=101, until=ALL)
    return out.select("w", "i", "window_start", "window_end", "event_type", "n", "fully_processed")


def mts_count_based(spark, sf_dir):
    ticks = countwin.count_ticks(events(spark, sf_dir).drop("tick"), "ts", "event_id", 100)
    return multi_window(ticks, "(5,2)(10,5)", ["event_type"], A.count(), until=ALL).select("w", "i", "window_end", "event_type", "n")


RATES = [50, 150, 100, 300, 200]


def mts_rate_based(spark, sf_dir):
    ticks = countwin.rate_ticks(events(spark, sf_dir).drop("tick"), "ts", "event_id", RATES, rounds=True)
    return multi_window(ticks, "(5,2)(10,5)", ["event_type"], A.count(), until=ALL).select("w", "i", "window_end", "event_type", "n")


SIGNALS = [(24, 6, 1, 100), (48, 10, 1, 205), (24, 6, 2, 400), (6, 6, 2, 300), (24, 6, 1, 500)]


def _dynamic(align: str, signals):
    def query(spark, sf_dir):
        registry = Registry.of("(5,4)(6,6)").apply(signals, align)
        out = multi_window(events(spark, sf_dir), registry, ["event_type"], A.count(), until=ALL)
        return out.select("w", "i", "window_start", "window_end", "event_type", "n", "fully_processed")

    return query


def _spine_sql(lives) -> str:
    rows = ", ".join(f"({x.scale.w},{x.scale.i},{x.since},{'CAST(NULL AS BIGINT)' if x.until is None else x.until})" for x in lives)
    return f"""
WITH s(w, i, b, z) AS (VALUES {rows}),
ev AS (SELECT *, {_HOUR} AS t FROM events),
top AS (SELECT max(t) AS last FROM ev),
sp AS (SELECT w, i, b, e FROM s, top, LATERAL (SELECT unnest(range(b + i, coalesce(z, last + w) + 1, i)) AS e))"""


_WINDOW_SQL = "CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, CAST(greatest(e - w, b) AS BIGINT) AS window_start, CAST(e AS BIGINT) AS window_end"
_CENTS = "CAST(round(value * 100) AS BIGINT)"
_JOIN_SQL = "FROM sp JOIN ev ON t >= greatest(e - w, b) AND t < e"


def _dynamic_sql(align: str, signals) -> str:
    lives = Registry.of("(5,4)(6,6)").apply(signals, align).lives
    return f"{_spine_sql(lives)} SELECT {_WINDOW_SQL}, event_type, count(*) AS n, e - w >= b AS fully_processed {_JOIN_SQL} GROUP BY w, i, b, e, event_type"


def mts_linreg(spark, sf_dir):
    out = multi_window(lineitems(spark, sf_dir), "(30,30)(90,30)(100,60)", ["l_returnflag"], A.linreg("l_quantity", "l_extendedprice"), until=ALL)
    return out.select("w", "i", "window_end", "l_returnflag", F.round("slope", 3).alias("slope"), F.round("intercept", 2).alias("intercept"))


_LINREG_SQL = """
WITH s(w, i) AS (VALUES (30,30), (90,30), (100,60)),
top AS (SELECT max(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) AS t FROM lineitem),
sp AS (SELECT w, i, e FROM s, top, LATERAL (SELECT unnest(range(i, top.t + w + 1, i)) AS e)),
li AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS t FROM lineitem)
SELECT CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, CAST(e AS BIGINT) AS window_end, l_returnflag,
  round(CASE WHEN count(*) * sum(x * x) - sum(x) * sum(x) = 0 THEN 0 ELSE (count(*) * sum(x * y) - sum(x) * sum(y)) / (count(*) * sum(x * x) - sum(x) * sum(x)) END, 3) AS slope,
  round(CASE WHEN count(*) * sum(x * x) - sum(x) * sum(x) = 0 THEN 0 ELSE (sum(x * x) * sum(y) - sum(x * y) * sum(x)) / (count(*) * sum(x * x) - sum(x) * sum(x)) END, 2) AS intercept
FROM sp JOIN li ON t >= e - w AND t < e GROUP BY w, i, e, l_returnflag"""


_LIVE = "(5,4)(6,6)"


def _changing() -> Registry:
    return Registry.of(_LIVE).apply(SIGNALS)


def word_count_dynamic(spark, sf_dir):
    registry = Registry.of("(4,2)").apply([(5, 3, 1, 6), (4, 2, 2, 20)])
    return multi_window(words(spark, sf_dir), registry, ["word"], A.count(), until=ALL).select("w", "i", "window_end", "word", "n")


def mts_avg_dynamic(spark, sf_dir):
    cents = events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return multi_window(cents, _changing(), ["event_type"], A.avg("cents", "mean_cents"), until=ALL).select("w", "i", "window_start", "window_end", "event_type", "mean_cents")


def mts_linreg_dynamic(spark, sf_dir):
    cents = events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    out = multi_window(cents, _changing(), ["event_type"], A.linreg("user_id", "cents"), until=ALL)
    return out.select("w", "i", "window_start", "window_end", "event_type", "slope", "intercept")


def mts_topk_dynamic(spark, sf_dir):
    counts = multi_window(events(spark, sf_dir), _changing(), ["user_id"], A.count(), until=ALL)
    return postops.top_keys(counts, "user_id", 5).select("w", "i", "window_start", "window_end", "rank", "user_id", "n", "total")


def custom_fold(spark, sf_dir):
    """The largest of two numbers as a fold of one's own, over user ids."""
    agg = A.fold(F.col("user_id"), F.lit(-1).cast("long"), lambda a, b: F.when(b > a, b).otherwise(a), "largest")
    return multi_window(events(spark, sf_dir), SCALES, ["event_type"], agg, until=ALL).select("w", "i", "window_end", "event_type", "largest")


def filter_drop(spark, sf_dir):
    return events(spark, sf_dir).transform(dataflow.drop_where(F.col("event_type").startswith("p"))).select("event_id", "event_type")


def map_project(spark, sf_dir):
    return events(spark, sf_dir).transform(dataflow.map_rows(event_id=F.col("event_id"), label=F.concat("event_type", F.lit(":"), "user_id"), hour=F.col("tick")))


def _lines(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("line"))


def split_words(spark, sf_dir):
    return _lines(spark, sf_dir).transform(dataflow.split_words("line")).groupBy("word").agg(F.count("*").alias("n"))


def stopword_split_then_filter(spark, sf_dir):
    return _lines(spark, sf_dir).transform(dataflow.split_then_filter("line", STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))


def stopword_filter_then_split(spark, sf_dir):
    return _lines(spark, sf_dir).transform(dataflow.filter_then_split("line", STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))


_SPLIT = "unnest(CASE WHEN text = '' THEN [''] WHEN rtrim(text, ' ') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(rtrim(text, ' '), ' ') END) AS word"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def word_count_windows(spark, sf_dir):
    return multi_window(words(spark, sf_dir), "(4,2)(5,3)", ["word"], A.count(), until=ALL).select("w", "i", "window_end", "word", "n")


_WORDS_SQL = f"""
WITH s(w, i) AS (VALUES (4,2), (5,3)),
top AS (SELECT max(conv_id) // 10 AS t FROM conversations),
sp AS (SELECT w, i, e FROM s, top, LATERAL (SELECT unnest(range(i, top.t + w + 1, i)) AS e)),
said AS (SELECT conv_id // 10 AS t, coalesce(text, '') AS text FROM conversations),
ev AS (SELECT t, word FROM (SELECT t, {_SPLIT} FROM said) WHERE word NOT IN ({_STOP}))
SELECT CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, CAST(e AS BIGINT) AS window_end, word, count(*) AS n
FROM sp JOIN ev ON t >= e - w AND t < e GROUP BY w, i, e, word"""


#: 24 timescales with windows of 50 to 510 hours that fire every 1 to 10 hours: a record belongs to 1,800 windows.
WIDE = "".join(f"({50 + 20 * k},{1 + k % 10})" for k in range(24))


def mts_shared_dynamic(spark, sf_dir):
    """Windows from windows while timescales come and go."""
    out = multi_window(events(spark, sf_dir), _changing(), ["event_type"], A.count(), until=ALL, mode="greedy")
    return out.select("w", "i", "window_start", "window_end", "event_type", "n", "fully_processed")


#: Windows that end inside the slices of others: begins and ends are never the same ticks.
UNEVEN = "(5,4)(7,6)(25,8)(51,12)"


def mts_active_dynamic(spark, sf_dir):
    """Slices cut only where windows begin, while timescales come and go."""
    out = multi_window(events(spark, sf_dir), _changing(), ["event_type"], A.count(), until=ALL, mode="active")
    return out.select("w", "i", "window_start", "window_end", "event_type", "n", "fully_processed")


def mts_grouped_dynamic(spark, sf_dir):
    out = multi_window(events(spark, sf_dir), _changing(), ["event_type"], A.count(), until=ALL, mode="grouped")
    return out.select("w", "i", "window_start", "window_end", "event_type", "n", "fully_processed")


def _written(spark, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, else in the context's own. Without either, a
    local master gets a temporary folder; on a cluster there is none that every machine sees, and that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            base = f"file://{tempfile.mkdtemp()}"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def sink_by_timescale(spark, sf_dir):
    """Results in folders by timescale, written and read again."""
    path = _written(spark, "by-timescale")
    text.write_by_timescale(QUERIES["mts_count_shared"](spark, sf_dir), path)
    out = spark.read.parquet(path)
    return out.select(F.col("w").cast("long").alias("w"), F.col("i").cast("long").alias("i"), "window_end", "event_type", "n")


def _cuts(frame: DataFrame) -> DataFrame:
    """(slice_end, n) of the slices of SCALES that hold records."""
    cut = frame.withColumn("slice_end", slice_end(F.col("tick"), Registry.of(SCALES).lives))
    return cut.groupBy("slice_end").agg(F.count("*").alias("n"))


def _edges(spark, last: int) -> DataFrame:
    """Ends of all slices of SCALES up to `last`, whether they hold records or not."""
    ticks = spark.range(last).select(F.col("id").alias("tick"))
    return ticks.select(slice_end(F.col("tick"), Registry.of(SCALES).lives).alias("slice_end")).distinct().where(F.col("slice_end") <= last)


def sink_totals(spark, sf_dir):
    """Totals with the number of slices each was merged from, as tab-separated lines, written and read again."""
    path = _written(spark, "totals")
    rows = events(spark, sf_dir)
    counts, last = multi_window(rows, SCALES, ["event_type"], A.count(), until=ALL), last_tick(rows, "tick")
    # Slices go to the windows that they are in: no join of ranges.
    lives = Registry.of(SCALES)
    deps = fanned(_edges(spark, last), "slice_end", lives, F.lit(last), "window_end").groupBy("w", "i", "window_end").agg(F.count("*").alias("n_children"))
    text.write_totals(postops.totals(counts, SCALES, 0, last).join(deps, ["w", "i", "window_end"]), path, deps="n_children")
    cells = F.split("value", "\t")
    return spark.read.text(path).select(F.col("w").cast("long").alias("w"), F.col("i").cast("long").alias("i"), *[F.get(cells, F.lit(k)).cast("long").alias(n) for k, n in enumerate(("window_end", "total", "n_deps"))])


def source_lines(spark, sf_dir):
    """Lines of text files, split into words."""
    path = _written(spark, "lines")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text.write_lines(turns.select(F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", " ").alias("line")), path, "line")
    return text.lines(spark, path).transform(dataflow.split_words("line")).groupBy("word").agg(F.count("*").alias("n"))


def source_separated(spark, sf_dir):
    """One field of a log whose fields a bar separates."""
    path = _written(spark, "log")
    log = events(spark, sf_dir).select(F.concat_ws("|", F.col("event_id").cast("string"), F.col("tick").cast("string"), "event_type").alias("line"))
    text.write_lines(log, path, "line")
    return text.separated(spark, path, 2, column="event_type").groupBy("event_type").agg(F.count("*").alias("n"))


def plan_slices(spark, sf_dir):
    """The slices of the timescales that hold events, with how many."""
    cut = _cuts(events(spark, sf_dir))
    start = F.lit(0).cast("long")
    for x in Registry.of(SCALES).lives:  # a slice begins at the last edge before its end
        back = (F.col("slice_end") - 1) % x.scale.i
        edge = F.col("slice_end") - 1 - back
        start = F.greatest(start, F.when(back >= x.scale.turn, edge + x.scale.turn).otherwise(edge))
    return cut.select(start.alias("slice_start"), "slice_end", "n")


_CUTS_SQL = f"""
WITH s(w, i) AS (VALUES (5,4), (6,6), (24,6), (48,10)),
ev AS (SELECT {_HOUR} AS t FROM events),
top AS (SELECT max(t) AS last FROM ev),
cuts AS (SELECT DISTINCT c FROM (SELECT unnest(range(0, last + i + 1, i)) AS c FROM s, top UNION ALL SELECT unnest(range((i - w % i) % i, last + i + 1, i)) AS c FROM s, top)),
sl AS (SELECT * FROM (SELECT lag(c) OVER (ORDER BY c) AS a, c AS z FROM cuts) WHERE a IS NOT NULL)"""
_PLAN_SQL = f"{_CUTS_SQL} SELECT CAST(a AS BIGINT) AS slice_start, CAST(z AS BIGINT) AS slice_end, count(*) AS n FROM sl JOIN ev ON t >= a AND t < z GROUP BY a, z"


def plan_nodes(spark, sf_dir):
    """How many slices with events each window is merged from, and how many events they hold."""
    cut = _cuts(events(spark, sf_dir))
    wide = fanned(cut, "slice_end", Registry.of(SCALES), F.lit(ALL), "window_end")
    return wide.groupBy("w", "i", "window_end").agg(F.count("*").alias("n_children"), F.sum("n").alias("n"))


def plan_edges(spark, sf_dir):
    """Which slices with events each window is merged from, by place."""
    cut = _cuts(events(spark, sf_dir))
    wide = fanned(cut, "slice_end", Registry.of(SCALES), F.lit(ALL), "window_end")
    by = W.partitionBy("w", "i", "window_end").orderBy("slice_end")  # at most as many rows as a window has ticks
    return wide.select("w", "i", "window_end", (F.row_number().over(by) - 1).alias("position"), "slice_end", "n")


_NODES_SQL = f"""{_CUTS_SQL},
held AS (SELECT z, count(*) AS n FROM sl JOIN ev ON t >= a AND t < z GROUP BY z),
sp AS (SELECT w, i, e FROM s, top, LATERAL (SELECT unnest(range(i, last + i + w + 1, i)) AS e))
SELECT CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, CAST(e AS BIGINT) AS window_end, """
_IN_SQL = "FROM sp JOIN held ON z > e - w AND z <= e"


QUERIES = {
    "mts_count_shared": _hourly(A.count, "slices"),
    "mts_count_auto": _hourly(A.count),
    "mts_count_naive": _hourly(A.count, "naive"),
    "mts_sum_value": mts_sum_value,
    "mts_avg": mts_avg,
    "mts_avg_trunc": mts_avg_trunc,
    "mts_linreg": mts_linreg,
    "mts_uniq_count": _hourly(lambda: A.uniq("user_id", count_name="n_users")),
    "mts_uniq_set": mts_uniq_set,
    "mts_minmax": _hourly(lambda: A.minmax("value")),
    "mts_topk": mts_topk,
    "mts_totals": mts_totals,
    "mts_map_view": mts_map_view,
    "mts_tumbling": _hourly(A.count, scales="(1,1)(6,6)(24,24)"),
    "mts_fully_processed": mts_fully_processed,
    "mts_clamped_start": mts_late_start,
    "mts_count_based": mts_count_based,
    "mts_rate_based": mts_rate_based,
    "mts_dynamic_add": _dynamic("own", SIGNALS[:2]),
    "mts_dynamic_remove": _dynamic("own", SIGNALS),
    "mts_dynamic_grid_align": _dynamic("grid", SIGNALS),
    "mts_shared_greedy": _hourly(A.count, "greedy", NESTED),
    "mts_shared_dp": _hourly(A.count, "dp", NESTED),
    "mts_shared_adaptive": _hourly(A.count, "adaptive", NESTED),
    "mts_shared_pruned": _hourly(lambda: A.minmax("value"), "dp", NESTED, prune="cost", reuse=0.5, tradeoff=10),
    "mts_grouped": _hourly(A.count, "grouped", NESTED),
    "mts_tree": _hourly(A.count, "tree"),
    "mts_active": _hourly(lambda: A.minmax("value"), "active", UNEVEN),
    "mts_active_dynamic": mts_active_dynamic,
    "mts_wide_auto": _hourly(A.count, "auto", WIDE),
    "mts_wide_naive": _hourly(A.count, "naive", WIDE),
    "mts_wide_slices": _hourly(A.count, "slices", WIDE),
    "mts_wide_tree": _hourly(A.count, "tree", WIDE),
    "mts_shared_dynamic": mts_shared_dynamic,
    "mts_grouped_dynamic": mts_grouped_dynamic,
    "sink_by_timescale": sink_by_timescale,
    "sink_totals": sink_totals,
    "source_lines": source_lines,
    "source_separated": source_separated,
    "word_count_dynamic": word_count_dynamic,
    "mts_avg_dynamic": mts_avg_dynamic,
    "mts_linreg_dynamic": mts_linreg_dynamic,
    "mts_topk_dynamic": mts_topk_dynamic,
    "filter_drop": filter_drop,
    "map_project": map_project,
    "split_words": split_words,
    "stopword_filter_then_split": stopword_filter_then_split,
    "stopword_split_then_filter": stopword_split_then_filter,
    "word_count_windows": word_count_windows,
    "plan_slices": plan_slices,
    "plan_nodes": plan_nodes,
    "plan_edges": plan_edges,
    "custom_fold": custom_fold,
}

_TICKED = """
WITH s(w, i) AS (VALUES (5,2), (10,5)),
ev AS (SELECT event_type, {tick} AS t FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS p FROM events)),
sp AS (SELECT w, i, e FROM s, LATERAL (SELECT unnest(range(i, {end} + 1, i)) AS e))
SELECT CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, CAST(e AS BIGINT) AS window_end, event_type, count(*) AS n
FROM sp JOIN ev ON t >= e - w AND t < e GROUP BY w, i, e, event_type"""

ORACLE_SQL = {
    "mts_count_shared": _with(SCALES, _COUNT),
    "mts_count_naive": _with(SCALES, _COUNT),
    "mts_count_auto": _with(SCALES, _COUNT),
    "mts_sum_value": _with(SCALES, "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents"),
    "mts_avg": _with(SCALES, "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(value) AS mean_cents"),
    "mts_avg_trunc": _with(SCALES, "CAST(CAST(sum(CAST(floor(value) AS BIGINT) - 20) AS BIGINT) // count(value) AS BIGINT) AS mean"),
    "mts_linreg": _LINREG_SQL,
    "mts_uniq_count": _with(SCALES, "count(DISTINCT user_id) AS n_users"),
    "mts_uniq_set": _with(SCALES, "string_agg(DISTINCT CAST(((user_id % 7) + 7) % 7 AS VARCHAR), ',' ORDER BY CAST(((user_id % 7) + 7) % 7 AS VARCHAR)) AS found"),
    "mts_minmax": _with(SCALES, "min(value) AS low, max(value) AS high"),
    "mts_topk": f"""
WITH c AS ({_with(SCALES, _COUNT).replace("event_type", "user_id")}),
r AS (SELECT *, row_number() OVER (PARTITION BY w, i, window_end ORDER BY n DESC, user_id) AS rank, sum(n) OVER (PARTITION BY w, i, window_end) AS total FROM c)
SELECT w, i, window_end, CAST(rank AS INTEGER) AS rank, user_id, n, CAST(total AS BIGINT) AS total FROM r WHERE rank <= 10""",
    "mts_totals": f"""
WITH s(w, i) AS (VALUES (5,4), (6,6), (24,6), (48,10)),
ev AS (SELECT {_HOUR} AS t FROM events),
top AS (SELECT max(t) AS last FROM ev),
sp AS (SELECT w, i, e FROM s, top, LATERAL (SELECT unnest(range(i, last + 2, i)) AS e))
SELECT CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, CAST(greatest(e - w, 0) AS BIGINT) AS window_start, CAST(e AS BIGINT) AS window_end, count(t) AS total, e >= w AS fully_processed
FROM sp LEFT JOIN ev ON t >= e - w AND t < e GROUP BY w, i, e""",
    "mts_map_view": f"SELECT w, i, window_end, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS result FROM ({_with(SCALES, _COUNT)}) GROUP BY w, i, window_end",
    "mts_tumbling": _with("(1,1)(6,6)(24,24)", _COUNT),
    "mts_fully_processed": f"SELECT w, i, greatest(window_end - w, 0) AS window_start, window_end, window_end - w AS nominal_start, event_type, n, window_end >= w AS fully_processed FROM ({_with(SCALES, _COUNT)})",
    "mts_clamped_start": f"""
WITH s(w, i) AS (VALUES (5,4), (6,6), (24,6), (48,10)),
ev AS (SELECT event_type, {_HOUR} AS t FROM events),
top AS (SELECT max(t) AS last FROM ev),
sp AS (SELECT w, i, e FROM s, top, LATERAL (SELECT unnest(range(101 + i, last + w + 1, i)) AS e))
SELECT CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, CAST(greatest(e - w, 101) AS BIGINT) AS window_start, CAST(e AS BIGINT) AS window_end, event_type, count(*) AS n, e - w >= 101 AS fully_processed
FROM sp JOIN ev ON t >= greatest(e - w, 101) AND t < e GROUP BY w, i, e, event_type""",
    "mts_count_based": _TICKED.format(tick="p // 100", end="(SELECT max(t) + 11 FROM ev)"),
    "mts_rate_based": _TICKED.format(tick="p // 800 * 5 + CASE WHEN p % 800 < 50 THEN 0 WHEN p % 800 < 200 THEN 1 WHEN p % 800 < 300 THEN 2 WHEN p % 800 < 600 THEN 3 ELSE 4 END", end="(SELECT max(t) + 11 FROM ev)"),
    "mts_dynamic_add": _dynamic_sql("own", SIGNALS[:2]),
    "mts_dynamic_remove": _dynamic_sql("own", SIGNALS),
    "mts_dynamic_grid_align": _dynamic_sql("grid", SIGNALS),
    "mts_shared_greedy": _with(NESTED, _COUNT),
    "mts_shared_dp": _with(NESTED, _COUNT),
    "mts_shared_adaptive": _with(NESTED, _COUNT),
    "mts_shared_pruned": _with(NESTED, "min(value) AS low, max(value) AS high"),
    "mts_grouped": _with(NESTED, _COUNT),
    "filter_drop": "SELECT event_id, event_type FROM events WHERE event_type NOT LIKE 'p%' OR event_type IS NULL",
    "map_project": f"SELECT event_id, event_type || ':' || user_id AS label, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) / 3600000000) AS BIGINT) AS hour FROM events",
    "split_words": f"SELECT word, count(*) AS n FROM (SELECT {_SPLIT} FROM conversations) GROUP BY word",
    "stopword_split_then_filter": f"SELECT word, count(*) AS n FROM (SELECT {_SPLIT} FROM conversations) WHERE word NOT IN ({_STOP}) GROUP BY word",
    "stopword_filter_then_split": f"SELECT word, count(*) AS n FROM (SELECT {_SPLIT} FROM conversations WHERE text NOT IN ({_STOP})) GROUP BY word",
    "word_count_windows": _WORDS_SQL,
    "word_count_dynamic": f"""
WITH s(w, i, b, z) AS (VALUES (4,2,0,20), (5,3,6,NULL)),
top AS (SELECT max(conv_id) // 10 AS t FROM conversations),
sp AS (SELECT w, i, b, e FROM s, top, LATERAL (SELECT unnest(range(b + i, coalesce(z, top.t + w) + 1, i)) AS e)),
said AS (SELECT conv_id // 10 AS t, coalesce(text, '') AS text FROM conversations),
ev AS (SELECT t, word FROM (SELECT t, {_SPLIT} FROM said) WHERE word NOT IN ({_STOP}))
SELECT CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, CAST(e AS BIGINT) AS window_end, word, count(*) AS n
FROM sp JOIN ev ON t >= greatest(e - w, b) AND t < e GROUP BY w, i, b, e, word""",
    "mts_avg_dynamic": f"{_spine_sql(_changing().lives)} SELECT {_WINDOW_SQL}, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(value) AS mean_cents {_JOIN_SQL} GROUP BY w, i, b, e, event_type",
    "mts_linreg_dynamic": f"""{_spine_sql(_changing().lives)},
g AS (SELECT w, i, b, e, event_type, count(*) AS n, CAST(sum(user_id) AS DOUBLE) AS x, CAST(sum(c) AS DOUBLE) AS y, CAST(sum(user_id * c) AS DOUBLE) AS xy, CAST(sum(user_id * user_id) AS DOUBLE) AS xx FROM sp JOIN (SELECT *, {_CENTS} AS c FROM ev) ON t >= greatest(e - w, b) AND t < e GROUP BY w, i, b, e, event_type)
SELECT {_WINDOW_SQL}, event_type, CASE WHEN n * xx - x * x = 0 THEN 0 ELSE (n * xy - x * y) / (n * xx - x * x) END AS slope, CASE WHEN n * xx - x * x = 0 THEN 0 ELSE (xx * y - xy * x) / (n * xx - x * x) END AS intercept FROM g""",
    "mts_topk_dynamic": f"""{_spine_sql(_changing().lives)},
c AS (SELECT w, i, b, e, user_id, count(*) AS n {_JOIN_SQL} GROUP BY w, i, b, e, user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY w, i, b, e ORDER BY n DESC, user_id) AS rank, sum(n) OVER (PARTITION BY w, i, b, e) AS total FROM c)
SELECT {_WINDOW_SQL}, CAST(rank AS INTEGER) AS rank, user_id, n, CAST(total AS BIGINT) AS total FROM r WHERE rank <= 5""",
    "mts_tree": _with(SCALES, _COUNT),
    "mts_active": _with(UNEVEN, "min(value) AS low, max(value) AS high"),
    "mts_active_dynamic": _dynamic_sql("own", SIGNALS),
    "mts_wide_auto": _with(WIDE, _COUNT),
    "mts_wide_naive": _with(WIDE, _COUNT),
    "mts_wide_slices": _with(WIDE, _COUNT),
    "mts_wide_tree": _with(WIDE, _COUNT),
    "mts_shared_dynamic": _dynamic_sql("own", SIGNALS),
    "mts_grouped_dynamic": _dynamic_sql("own", SIGNALS),
    "sink_by_timescale": _with(SCALES, _COUNT),
    "sink_totals": f"""
WITH s(w, i) AS (VALUES (5,4), (6,6), (24,6), (48,10)),
ev AS (SELECT {_HOUR} AS t FROM events),
top AS (SELECT max(t) + 1 AS last FROM ev),
sp AS (SELECT w, i, e FROM s, top, LATERAL (SELECT unnest(range(i, last + 1, i)) AS e)),
n AS (SELECT w, i, e, count(t) AS total FROM sp LEFT JOIN ev ON t >= e - w AND t < e GROUP BY w, i, e),
cuts AS (SELECT DISTINCT c FROM (SELECT unnest(range(i, last + 1, i)) AS c FROM s, top UNION ALL SELECT unnest(range((i - w % i) % i, last + 1, i)) AS c FROM s, top) WHERE c > 0)
SELECT CAST(w AS BIGINT) AS w, CAST(i AS BIGINT) AS i, CAST(e AS BIGINT) AS window_end, total, count(c) AS n_deps FROM n LEFT JOIN cuts ON c > greatest(e - w, 0) AND c <= e GROUP BY w, i, e, total""",
    "source_lines": "SELECT word, count(*) AS n FROM (SELECT unnest(CASE WHEN text = '' THEN [''] WHEN rtrim(text, ' ') = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(rtrim(text, ' '), ' ') END) AS word FROM (SELECT regexp_replace(coalesce(text, ''), '[\\r\\n]', ' ', 'g') AS text FROM conversations)) GROUP BY word",
    "source_separated": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "plan_slices": _PLAN_SQL,
    "plan_nodes": f"{_NODES_SQL} count(*) AS n_children, CAST(sum(n) AS BIGINT) AS n {_IN_SQL} GROUP BY w, i, e",
    "plan_edges": f"{_NODES_SQL} CAST(row_number() OVER (PARTITION BY w, i, e ORDER BY z) - 1 AS INTEGER) AS position, CAST(z AS BIGINT) AS slice_end, n {_IN_SQL}",
    "custom_fold": _with(SCALES, "max(user_id) AS largest"),
}
