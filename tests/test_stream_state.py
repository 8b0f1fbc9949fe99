import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import aggregates as A
from tidewheel.operators.windows import multi_window, tick_of
from tidewheel.plans.timescale import Registry
from tidewheel.sources import signals
from tidewheel.streaming.state import handed_out, nodes, pieces, ticks, windows_in_state

DAY = dt.datetime(2024, 1, 1)
ORIGIN = int(DAY.replace(tzinfo=dt.timezone.utc).timestamp())
SCHEMA = "ts timestamp, key int, value long"


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Folders of batches: early, late and repeated records, null keys and values; and the records that count."""
    base = tmp_path_factory.mktemp("stream")
    r = random.Random(8)
    early = [(DAY - dt.timedelta(hours=k, minutes=5), 0, 1) for k in range(6)]
    some = [(DAY + dt.timedelta(minutes=31 * k), r.choice([0, 1, None]), r.choice([3, 2**53 + 1, -4, None])) for k in range(60)]
    late = [(DAY + dt.timedelta(hours=3), 7, 1)]
    after = [(DAY + dt.timedelta(hours=90), 0, 5)]
    for k, part in enumerate((early, some[:30], some[28:30] + some[30:], after, late)):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{base}/in{k}")
    kept = spark.createDataFrame([*some, *some[28:30]], SCHEMA).withColumn("tick", tick_of("ts", "2024-01-01", 3600)).persist()
    return f"{base}/in*", kept


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(out, name, path):
    query = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def rows_of(df):
    out = []
    for r in df.collect():
        out.append(tuple(sorted(x) if isinstance(x, list) else round(x, 6) if isinstance(x, float) else x for x in r))
    return sorted(out, key=str)


def changing():
    return Registry.of("(5,3)(7,2)").apply([(6, 4, 1, 9), (5, 3, 2, 21)])


def larger(a, b):
    return F.when(b > a, b).otherwise(a)


AGGREGATES = {
    "counted": A.count, "means": lambda: A.avg("value"), "ends": lambda: A.minmax("value"), "sets": lambda: A.uniq("value"),
    "numbers": lambda: A.uniq("value", count_name="c"), "folds": lambda: A.fold(F.col("value"), F.lit(-(2**60)).cast("long"), larger), "sketches": lambda: A.approx_uniq("value"),
}


@pytest.mark.parametrize("name", AGGREGATES)
def test_stream_equals_batch_for_every_aggregate(spark, parts, tmp_path, name):
    path, kept = parts
    agg = AGGREGATES[name]()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    run(windows_in_state(stream, "ts", changing(), ["key"], agg, 3600, "2 hours", ORIGIN), name, f"{tmp_path}/check")
    got = spark.table(name).where("window_end < 80")
    want = multi_window(kept, changing(), ["key"], agg, until=79)
    assert got.columns == want.columns and rows_of(got) == rows_of(want) and got.count() > 30


def test_ticks_salts_and_no_keys(spark, parts, tmp_path):
    path, kept = parts
    for name, keys, more in (("ticks", ["key"], {"mode": "ticks", "salts": 3}), ("whole", [], {"salts": 2})):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
        run(windows_in_state(stream, "ts", "(5,3)(20,1)", keys, A.minmax("value"), 3600, "2 hours", ORIGIN, **more), name, f"{tmp_path}/{name}")
        assert rows_of(spark.table(name).where("window_end < 80")) == rows_of(multi_window(kept, "(5,3)(20,1)", keys, A.minmax("value"), until=79)), name
    with pytest.raises(ValueError):
        windows_in_state(kept, "ts", "(5,3)", ["key"], A.count(), 3600, "0 seconds", mode="naive")
    with pytest.raises(ValueError):
        windows_in_state(kept, "ts", [], ["key"], A.count(), 3600, "0 seconds")


def test_pieces_make_up_the_window_and_are_few():
    for depth in (0, 3, 6):
        for begin in range(0, 40, 3):
            for end in range(begin + 1, begin + 130, 7):
                some = pieces(begin, end, depth)
                assert sorted(t for up, n in some for t in range(n << up, (n + 1) << up)) == list(range(begin, end))
                assert depth < 6 or len(some) <= 2 * depth + 2


def test_merges_grow_with_the_logarithm(spark):
    """Rows that are handed to windows, counted: as many a window as it is long by ticks, a few by the tree."""
    rows = spark.range(1200).selectExpr(f"timestamp_seconds({ORIGIN} + id * 60) AS ts", "1 AS key", "id AS value")
    made = {}
    for w in (32, 256):
        registry = Registry.of([(w, 8)])
        closed = ticks(rows, "ts", ["key"], A.count(), 60, "0 seconds", ORIGIN, 0, 1)
        leaves = closed.withColumn("_up", F.lit(0)).withColumnRenamed("_tick", "_node")
        made["ticks", w] = handed_out(leaves, registry, 0).count()
        depth = w.bit_length() - 1
        tree = handed_out(nodes(closed, ["key"], A.count(), 60, ORIGIN, depth), registry, depth)
        made["tree", w] = tree.count()
        most = tree.groupBy("window_end").count().agg(F.max("count")).first()[0]
        assert most <= 2 * (w // 8).bit_length()  # ends are multiples of 8: no smaller nodes
        whole = tree.groupBy("window_end").agg(F.sum("_n").alias("n")).where("window_end <= 1200")
        assert {r["window_end"]: r["n"] for r in whole.collect()} == {e: min(e, w) for e in range(8, 1201, 8)}
    assert made["ticks", 256] > 6 * made["ticks", 32]
    assert made["tree", 256] < 2.6 * made["tree", 32] and made["tree", 256] < made["ticks", 256] / 16


def test_timescales_change_in_the_running_query(spark, rocksdb, tmp_path):
    """Signals come while the query runs; it is not restarted."""
    r = random.Random(4)
    rows = [(DAY + dt.timedelta(minutes=17 * k), r.choice([0, 1, 2, None]), r.choice([3, 8, None])) for k in range(150)]
    (tmp_path / "events").mkdir()
    (tmp_path / "signals").mkdir()
    events = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/events")
    told = spark.readStream.schema(signals.SCHEMA).parquet(f"{tmp_path}/signals")
    out = windows_in_state(events, "ts", "(5,3)", ["key"], A.minmax("value"), 3600, "1 hour", ORIGIN, signals=told, largest=12, buckets=3)
    query = out.writeStream.outputMode("append").format("memory").queryName("changing").option("checkpointLocation", f"{tmp_path}/check").start()
    ident = query.id

    def send(some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        query.processAllAvailable()

    try:
        send(rows[:30])
        signals.send(spark, f"{tmp_path}/signals", 6, 4, "addition", 9)
        send(rows[30:60])
        signals.send(spark, f"{tmp_path}/signals", 5, 3, "deletion", 21)
        signals.send(spark, f"{tmp_path}/signals", 12, 5, "addition", 19)
        signals.send(spark, f"{tmp_path}/signals", 9, 9, "deletion", 20)
        send(rows[60:100])
        signals.send(spark, f"{tmp_path}/signals", 6, 4, "deletion", 33)
        send(rows[100:])
        send([(DAY + dt.timedelta(hours=90), 0, 5)])
        send([(DAY + dt.timedelta(hours=91), 0, 5)])
        assert query.isActive and query.id == ident
    finally:
        query.stop()
    kept = spark.createDataFrame(rows, SCHEMA).withColumn("tick", tick_of("ts", "2024-01-01", 3600))
    registry = Registry.of("(5,3)").apply([(6, 4, 1, 9), (12, 5, 1, 19), (5, 3, 2, 21), (6, 4, 2, 33)])
    got = spark.table("changing").where("window_end < 80")
    assert rows_of(got) == rows_of(multi_window(kept, registry, ["key"], A.minmax("value"), until=79)) and got.count() > 40
    with pytest.raises(ValueError):
        windows_in_state(events, "ts", "(5,3)", ["key"], A.count(), 3600, "1 hour", ORIGIN, signals=told)


def test_one_hot_key_spreads_over_all_tasks(spark, tmp_path):
    """What reaches a key's state from a batch is a row for each task and tick, however many records there are."""
    rows = [(DAY + dt.timedelta(seconds=k), 1, k) for k in range(20_000)] + [(DAY + dt.timedelta(hours=90), 1, 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    out = windows_in_state(stream, "ts", "(3,1)", ["key"], A.total("value"), 3600, "0 seconds", ORIGIN)
    query = run(out, "hot", f"{tmp_path}/check")
    updated = [op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]]
    assert 0 < max(updated) < 20  # ticks, nodes and windows, not records
    assert spark.table("hot").agg(F.sum("total")).first()[0] == 3 * sum(range(20_000))
    spread = windows_in_state(stream, "ts", "(3,1)", ["key"], A.fold(F.col("value"), F.lit(0).cast("long"), lambda a, b: a + b, "total"), 3600, "0 seconds", ORIGIN)
    query = run(spread, "hot_fold", f"{tmp_path}/check2")
    assert rows_of(spark.table("hot_fold")) == rows_of(spark.table("hot"))
    first = max(op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"])
    assert first > 20  # dealt to a state for each salt


def test_windows_of_a_stopped_source_fire_by_the_clock(spark, tmp_path):
    """The source says nothing any more; beats go on. A beat is no record."""
    rows = [(DAY + dt.timedelta(minutes=25 * k), k % 2, k) for k in range(24)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/events")
    (tmp_path / "beats").mkdir()
    events = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/events")
    beats = spark.readStream.schema("at timestamp").parquet(f"{tmp_path}/beats")
    out = windows_in_state(events, "ts", "(3,1)(5,2)", ["key"], A.count(), 3600, "1 hour", ORIGIN, beats=beats)
    query = out.writeStream.outputMode("append").format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/check").start()
    kept = spark.createDataFrame(rows, SCHEMA).withColumn("tick", tick_of("ts", "2024-01-01", 3600))
    try:
        query.processAllAvailable()
        before = spark.table("idle").count()
        for hour in (12, 18):
            spark.createDataFrame([(DAY + dt.timedelta(hours=hour),)], "at timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/beats")
            query.processAllAvailable()
        got = rows_of(spark.table("idle"))
    finally:
        query.stop()
    want = rows_of(multi_window(kept, "(3,1)(5,2)", ["key"], A.count(), until=17))
    assert got == want and before < len(want)
