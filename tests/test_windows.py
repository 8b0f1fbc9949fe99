import datetime as dt
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewheel.functions import aggregates as A
from tidewheel.metrics import Times, executor_memory, merge_counts, observed
from tidewheel.operators import countwin, dataflow, postops, windows
from tidewheel.operators.windows import multi_window, tick_of
from tidewheel.plans.timescale import Registry
from tidewheel.sources import generators, signals, text
from tidewheel.streaming.state import windows_in_state
from tidewheel.streaming.windows import WindowStream, live_windows, windows_by_time

MODES = ("naive", "slices", "active", "auto", "greedy", "dp", "adaptive", "grouped", "tree")
# Slices of the scenario, (start, {key: count}).
SCENARIO = [(0, {1: 10, 2: 15}), (2, {3: 5, 2: 15}), (3, {4: 10, 3: 15}), (4, {5: 10}), (6, {4: 10}), (8, {2: 10}), (9, {3: 10}), (10, {5: 10}), (12, {3: 10}), (14, {2: 10}), (15, {3: 10})]


def brute(rows, lives, until):
    """{(w, i, since, end, key): count} by the rule itself."""
    out = {}
    for x in lives:
        for e in range(x.since + x.scale.i, min(until, until if x.until is None else x.until) + 1, x.scale.i):
            for t, k in rows:
                if max(x.since, e - x.scale.w) <= t < e:
                    key = x.scale.w, x.scale.i, max(x.since, e - x.scale.w), e, k
                    out[key] = out.get(key, 0) + 1
    return out


def found(df):
    return {(r["w"], r["i"], r["window_start"], r["window_end"], r["key"]): r["n"] for r in df.collect()}


def stream_of(spark, rows):
    return spark.createDataFrame(rows, "tick long, key int")


@pytest.mark.parametrize("mode", MODES)
def test_scenario(spark, mode):
    rows = [(t, k) for t, some in SCENARIO for k, n in some.items() for _ in range(n)]
    got = found(multi_window(stream_of(spark, rows), "(4,2)(6,3)(10,4)", ["key"], A.count(), until=16, mode=mode))
    window = lambda w, i, e: {k[4]: n for k, n in got.items() if k[:2] == (w, i) and k[3] == e}
    assert window(4, 2, 2) == {1: 10, 2: 15}
    assert window(4, 2, 12) == {2: 10, 3: 10, 5: 10}
    assert window(6, 3, 9) == {2: 10, 3: 15, 4: 20, 5: 10}
    assert window(10, 4, 12) == {2: 25, 3: 30, 4: 20, 5: 20}
    assert window(10, 4, 16) == {2: 20, 3: 30, 4: 10, 5: 10}


@pytest.mark.parametrize("seed", range(2))
def test_modes_agree(spark, seed):
    r = random.Random(seed)
    scales = generators.random_timescales(3, (2, 15), (1, 6), seed, max_period=120)
    rows = [(r.randint(3, 40), r.randint(0, 4)) for _ in range(200)]
    df = stream_of(spark, rows).persist()
    for start in (0, 5):
        expect = brute([x for x in rows if x[0] >= start], Registry.of(scales, start).lives, 41)
        for mode in MODES:
            assert found(multi_window(df, scales, ["key"], A.count(), start=start, until=41, mode=mode)) == expect, (mode, start)


def test_windows_that_come_and_go(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 60), r.randint(0, 3)) for _ in range(300)]
    table = signals.signals(spark, [(6, 4, 1, 10), (12, 5, 1, 23), (5, 3, 2, 31), (6, 4, 2, 42), (6, 4, 1, 45)])
    for align in ("own", "grid"):
        registry = signals.registry_of(table, "(5,3)", align=align)
        for mode in ("naive", "slices", "active", "greedy", "dp", "grouped", "tree") if align == "own" else ("slices", "greedy", "tree"):
            assert found(multi_window(stream_of(spark, rows), registry, ["key"], A.count(), until=61, mode=mode)) == brute(rows, registry.lives, 61), (align, mode)


def test_active_slices_are_fewer_and_windows_end_inside_them(spark):
    rows = [(t, k) for t in range(240) for k in range(2)]
    df = stream_of(spark, rows)
    registry = Registry.of("(5,4)(7,6)(25,8)(51,12)")
    paired = windows.partials(df, registry, ["key"], A.count(), "tick").count()
    ends = df.select(windows.active_end(F.col("tick"), registry.lives).alias("end")).distinct()
    active = 2 * ends.count()
    assert active < 0.75 * paired
    cuts = {r["end"] for r in ends.collect()}
    assert {e for x in registry.lives for e in range(x.scale.i, 241, x.scale.i)} - cuts  # ends that are no cuts
    assert all(e - x.scale.w in cuts | {0} for x in registry.lives for e in range(x.scale.w + x.scale.i - x.scale.w % x.scale.i, 241, x.scale.i))
    for agg in (A.count(), A.fold(F.lit(1).cast("long"), F.lit(0).cast("long"), lambda a, b: a + b, "n")):
        assert found(multi_window(df, registry, ["key"], agg, until=240, mode="active")) == brute(rows, registry.lives, 240)


def test_the_mode_is_chosen_by_cost(spark, monkeypatch):
    costs = windows.mode_costs(Registry.of([(50 + 20 * k, 1 + k % 10) for k in range(24)]))
    assert costs["tree"] < costs["slices"] / 3
    few = windows.mode_costs(Registry.of("(5,4)(6,6)(24,6)(48,10)"))
    assert few["slices"] < few["tree"]
    df = spark.range(10).withColumnRenamed("id", "tick")
    assert windows.choose_mode(df, Registry.of("(5,4)")) == "naive"
    monkeypatch.setattr(windows, "SMALL", 0)
    assert windows.choose_mode(df, Registry.of("(5,4)")) == "slices" and windows.choose_mode(df, Registry.of("(5000,1)(300,2)")) == "tree"


def test_timescales_whose_period_is_out_of_reach(spark):
    scales = [(17, 7), (23, 11), (40, 13), (41, 19), (60, 23)]
    r = random.Random(13)
    rows = [(r.randint(0, 90), r.randint(0, 2)) for _ in range(200)]
    expect = brute(rows, Registry.of(scales).lives, 91)
    for mode in ("greedy", "dp", "grouped", "tree"):
        assert found(multi_window(stream_of(spark, rows), scales, ["key"], A.count(), until=91, mode=mode)) == expect, mode


def test_rows_are_gathered_some_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(windows, "GATHERED", 4)
    rows = [(t % 6, t % 2, t * 7 % 101) for t in range(300)]
    df = spark.createDataFrame(rows, "tick long, key int, v long").repartition(3)
    agg = A.fold(F.col("v"), F.lit(0).cast("long"), lambda a, b: a + b)
    got = {(x["window_end"], x["key"]): x["value"] for x in multi_window(df, "(2,2)", ["key"], agg, mode="slices").collect()}
    assert got == {(e, k): sum(v for t, q, v in rows if q == k and e - 2 <= t < e) for e in (2, 4, 6) for k in (0, 1)}


def test_distinct_values_of_nulls(spark):
    df = spark.createDataFrame([(0, 1, None), (0, 1, 3), (1, 1, 3), (2, 2, None)], "tick long, key int, v long")
    for mode in ("naive", "slices", "dp"):
        got = {(x["key"], x["window_end"]): (x["n"], x["fully_processed"]) for x in multi_window(df, "(2,2)(4,2)", ["key"], A.uniq("v", count_name="n"), until=4, mode=mode).where("w = 2").collect()}
        assert got == {(1, 2): (1, True), (2, 4): (0, True)}
        sets = {(x["key"], x["window_end"]): x["values"] for x in multi_window(df, "(2,2)", ["key"], A.uniq("v"), until=4, mode=mode).collect()}
        assert sets == {(1, 2): [3], (2, 4): []}


def test_merged_partials_equal_direct_aggregates(spark):
    r = random.Random(4)
    rows = [(r.randint(0, 20), r.randint(0, 2), r.choice([None, *range(-7, 8)]), r.randint(0, 9)) for _ in range(200)]
    df = spark.createDataFrame(rows, "tick long, key int, v long, u long").persist()
    big = lambda a, b: F.when(b > a, b).otherwise(a)
    for agg in (A.total("v"), A.avg("v"), A.avg_trunc("v"), A.linreg("u", "v"), A.minmax("v"), A.uniq("u"), A.uniq("u", count_name="c"), A.approx_uniq("u"), A.fold(F.col("u"), F.lit(-1).cast("long"), big)):
        naive, shared = (sorted(multi_window(df, "(4,2)(5,3)", ["key"], agg, mode=m).collect(), key=str) for m in ("naive", "slices"))
        assert len(naive) == len(shared)
        for a, b in zip(naive, shared):
            assert all(x == pytest.approx(y) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)


def test_truncated_mean_and_flat_regression(spark):
    df = spark.createDataFrame([(0, 1, -7), (0, 1, 0), (0, 2, 5)], "tick long, key int, v long")
    got = {r["key"]: r["mean"] for r in multi_window(df, "(1,1)", ["key"], A.avg_trunc("v")).collect()}
    assert got == {1: -3, 2: 5}
    flat = multi_window(df, "(1,1)", ["key"], A.linreg(F.lit(3), "v")).collect()
    assert {(r["slope"], r["intercept"]) for r in flat} == {(0.0, 0.0)}


def test_partial_slices(spark):
    rows = [(0, k) for k in (1, 2, 3, 1, 1)] + [(1, k) for k in (4, 5, 3)] + [(2, 1), (2, 1)] + [(3, k) for k in (4, 1, 1)]
    got = found(multi_window(stream_of(spark, rows), "(5,3)", ["key"], A.count(), until=6))
    assert {k[4]: n for k, n in got.items() if k[3] == 3} == {1: 5, 2: 1, 3: 2, 4: 1, 5: 1}
    assert {(k[2], k[3]) for k in got} == {(0, 3), (1, 6)}


def test_empty_and_null_input(spark):
    none = stream_of(spark, [])
    for mode in MODES:
        assert multi_window(none, "(4,2)", ["key"], A.count(), mode=mode).count() == 0
    rows = stream_of(spark, [(None, 1), (1, None), (1, None)])
    assert [(r["key"], r["n"]) for r in multi_window(rows, "(2,2)", ["key"], A.count()).collect()] == [(None, 2)]


def test_totals_top_keys_and_maps(spark):
    counts = multi_window(stream_of(spark, [(0, 1), (0, 2), (0, 2), (5, 1)]), "(2,2)", ["key"], A.count(), until=6).persist()
    assert [r["total"] for r in postops.totals(counts, "(2,2)", 0, 6).orderBy("window_end").collect()] == [3, 0, 1]
    top = postops.top_keys(counts, "key", 1).orderBy("window_end").collect()
    assert [(r["key"], r["n"], r["total"]) for r in top] == [(2, 2, 3), (1, 1, 1)]
    assert postops.as_maps(counts, "key").where("window_end = 2").first()["result"] == {1: 1, 2: 2}


def test_shown_rows_pass_on(spark, capsys):
    df = spark.createDataFrame([(1,), (2,)], "x long")
    assert df.transform(dataflow.logged("some", 1)).count() == 2
    assert "some:" in capsys.readouterr().out


def test_nested_windows_add_up(spark):
    rows = generators.zipf_words(spark, 4000, 50, per_tick=100).withColumnRenamed("word", "key")
    got = {(r["w"], r["window_end"], r["key"]): r["n"] for r in multi_window(rows, "(2,2)(4,4)(8,8)", ["key"], A.count(), until=40).collect()}
    keys = {k for _, _, k in got}
    for e in range(8, 41, 8):
        for k in keys:
            whole = got.get((8, e, k), 0)
            assert whole == sum(got.get((4, x, k), 0) for x in (e - 4, e)) == sum(got.get((2, x, k), 0) for x in (e - 6, e - 4, e - 2, e))


def test_dataflow(spark):
    df = spark.createDataFrame([(x,) for x in "alpha bravo charlie delta application echo ally foxtrot".split()] + [(None,)], "v string")
    kept = df.transform(dataflow.drop_where(F.col("v").startswith("a"))).collect()
    assert [r["v"] for r in kept] == ["bravo", "charlie", "delta", "echo", "foxtrot", None]
    lines = spark.createDataFrame([("a b c d e f g",), ("a b  ",), (" a  b",), ("",), ("   ",), (None,), ("the",)], "line string")
    got = {}
    for r in lines.transform(dataflow.split_words("line")).collect():
        got.setdefault(r["line"], []).append(r["word"])
    assert got == {"a b c d e f g": list("abcdefg"), "a b  ": ["a", "b"], " a  b": ["", "a", "", "b"], "": [""], "the": ["the"]}
    assert lines.transform(dataflow.split_then_filter("line", ["a", "the"])).where("word in ('a', 'the')").count() == 0
    assert lines.transform(dataflow.filter_then_split("line", ["the"])).where("word = 'a'").count() == 3
    assert [r["x"] for r in df.limit(2).transform(dataflow.map_rows(x=F.upper("v"))).transform(dataflow.dispatch(2)).orderBy("x").collect()] == ["ALPHA", "BRAVO"]


def test_count_ticks(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [(k, day + dt.timedelta(seconds=(k * 37) % 900)) for k in range(250)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp")
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r["event_id"]: r["tick"] for r in countwin.count_ticks(df, "ts", "event_id", 100).collect()}
    assert got == {r[0]: k // 100 for k, r in enumerate(order)}
    # A third of all rows at one time, and some without one: cut by the tie.
    rows += [(1000 + k, day) for k in range(90)] + [(2000 + k, None) for k in range(80)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, ts timestamp")
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or day, r[0]))
    for parts in (1, 7, 40):
        got = {r["event_id"]: r["position"] for r in countwin.positions(df, "ts", "event_id", parts=parts).collect()}
        assert got == {r[0]: k for k, r in enumerate(order)}, parts
    rows = rows[:250]
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or day, r[0]))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp")
    got = {r["event_id"]: r["tick"] for r in countwin.rate_ticks(df, "ts", "event_id", [10, 0, 200]).collect()}
    assert got == {r[0]: 0 if k < 10 else 2 if k < 210 else 3 for k, r in enumerate(order)}


def test_positions_of_files(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    for name, rows in (("apart", [(k, day + dt.timedelta(seconds=(k * 37) % 901)) for k in range(901)]), ("hot", [(k, day + dt.timedelta(days=(k * k) % 5)) for k in range(900)])):
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/{name}")
        order = {k: p for p, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
        for parts in (4, 50, 200):
            placed = countwin.positions(spark.read.parquet(f"{tmp_path}/{name}"), "ts", "event_id", parts=parts)
            assert {r["event_id"]: r["position"] for r in placed.collect()} == order, (name, parts)
    # The first relation that a session reads: there a filter of ranges by ts reached their counts.
    code = f"""if True:
        from pyspark.sql import SparkSession
        from tidewheel.operators import countwin
        session = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        placed = countwin.count_ticks(session.read.parquet("{tmp_path}/apart"), "ts", "event_id", 100)
        print(sorted((r["tick"], r["count"]) for r in placed.groupBy("tick").count().collect()))"""
    ran = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert ran.stdout.split("\n")[-2:] == [str([(k, 100) for k in range(9)] + [(9, 1)]), ""], ran.stderr[-2000:]


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("x|y|one\nx|y|two|z\nx\n")
    assert [r["word"] for r in text.separated(spark, str(tmp_path / "a.log")).collect()] == ["one", "two", None]
    assert text.lines(spark, str(tmp_path / "a.log")).count() == 3
    assert text.lines(spark, str(tmp_path / "a.log"), skip_first=True).count() == 2
    counts = multi_window(stream_of(spark, [(0, 1), (3, 1)]), "(2,2)", ["key"], A.count(), until=4)
    text.write_by_timescale(counts, f"{tmp_path}/out")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").select(*counts.columns).collect())) == sorted(map(str, counts.collect()))
    text.write_totals(postops.totals(counts, "(2,2)", 0, 4).withColumn("deps", F.lit(3)), f"{tmp_path}/with-deps", deps="deps")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/with-deps").collect()) == ["2\t1\t3", "4\t1\t3"]
    text.write_totals(postops.totals(counts, "(2,2)", 0, 4), f"{tmp_path}/totals")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/totals").collect()) == ["2\t1", "4\t1"]
    signals.main(["--path", f"{tmp_path}/signals", "--w", "5", "--i", "3", "--at", "7"])
    assert signals.registry_of(spark.read.parquet(f"{tmp_path}/signals")).lives[0].since == 7


def test_generators_and_metrics(spark):
    words = generators.zipf_words(spark, 5000, 20, seed=1)
    most = words.groupBy("word").count().orderBy(F.desc("count")).first()
    assert most["word"] == "w0" and words.select("word").distinct().count() <= 20
    assert generators.random_words(spark.range(5)).where(F.length("word") == 4).count() == 5
    df, seen = observed(spark.range(7).toDF("x"))
    df.collect()
    assert seen.get["rows"] == 7
    times = Times()
    with times.measure("partial"):
        got = merge_counts(stream_of(spark, [(t, t % 2) for t in range(12)]), "(4,2)(5,3)", ["key"], A.count(), "tick", 12)
    assert got["records"] == 12 and times.seconds["partial"] > 0


def test_counts_are_those_of_the_execution(spark):
    """Against a hand count: slices with records, slices of each window, windows with records."""
    rows = [(t, t % 2) for t in range(30) if not 9 <= t < 14] * 2
    scales = [(4, 2), (5, 3)]
    cuts = sorted({e for w, i in scales for k in range(0, 40, i) for e in (k, k + (i - w % i) % i)})
    cut = {(t, k): next(c for c in cuts if c > t) for t, k in rows}
    slices = {(c, k) for (t, k), c in cut.items()}
    spans = [(e - w, e) for w, i in scales for e in range(i, 31, i)]
    handed = sum(a < c <= z for a, z in spans for c, _ in slices)
    windows_made = len({(n, k) for n, (a, z) in enumerate(spans) for t, k in rows if a <= t < z})
    df = stream_of(spark, rows).repartition(3)
    got = merge_counts(df, scales, ["key"], A.count(), "tick", 30)
    assert got == {"records": len(rows), "slices": len(slices), "handed": handed, "windows": windows_made}
    naive = merge_counts(df, scales, ["key"], A.count(), "tick", 30, "naive")
    assert naive == {"records": len(rows), "handed": sum(a <= t < z for a, z in spans for t, _ in rows), "windows": windows_made}
    tree = merge_counts(df, scales, ["key"], A.count(), "tick", 30, "tree")
    assert tree["slices"] == len(set(rows)) and tree["windows"] == windows_made and tree["handed"] < handed * 2
    active = merge_counts(df, "(5,4)(7,6)(25,8)", ["key"], A.count(), "tick", 30, "active")
    assert active["slices"] < merge_counts(df, "(5,4)(7,6)(25,8)", ["key"], A.count(), "tick", 30)["slices"]
    held = spark.range(50_000).persist()
    held.count()
    assert sum(x["used"] for x in executor_memory(spark).values()) > 0 and all(x["total"] > x["used"] for x in executor_memory(spark).values())
    held.unpersist()


def _events(spark, tmp_path, parts=4):
    day = dt.datetime(2024, 1, 1)
    r = random.Random(6)
    rows = sorted((day + dt.timedelta(seconds=r.randint(0, 39 * 3600)), r.randint(0, 2)) for _ in range(200))
    step = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], "ts timestamp, key int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return rows, spark.readStream.schema("ts timestamp, key int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_stream_equals_batch(spark, tmp_path):
    rows, events = _events(spark, tmp_path)
    ticked = spark.createDataFrame(rows, "ts timestamp, key int").withColumn("tick", tick_of("ts", "2024-01-01", 3600))
    batch = found(multi_window(ticked, "(5,3)(6,4)", ["key"], A.count(), until=40))
    query = live_windows(events, "ts", "(5,3)(6,4)", ["key"], A.count(), 3600, "2024-01-01", 40).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    query.awaitTermination()
    assert found(spark.table("live")) == batch
    origin = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    out = windows_by_time(events, "ts", "(5,3)", ["key"], A.count(), 3600, "0 seconds", origin)
    query = out.writeStream.outputMode("append").format("memory").queryName("appended").trigger(availableNow=True).start()
    query.awaitTermination()
    got = found(spark.table("appended"))
    assert got and got.items() <= batch.items()


def test_append_stream_leaves_out_what_is_before_the_origin(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    early = [(day - dt.timedelta(hours=k, minutes=5), 0) for k in range(6)]
    some = [(day + dt.timedelta(minutes=37 * k), k % 3) for k in range(60)]
    late = [(day + dt.timedelta(hours=3), 9), (day + dt.timedelta(hours=90), 0)]  # one behind the watermark, and one that moves it
    for k, part in enumerate((early, some[:30], some[30:] + some[30:35], late[1:], late)):
        spark.createDataFrame(part, "ts timestamp, key int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema("ts timestamp, key int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    origin = int(day.replace(tzinfo=dt.timezone.utc).timestamp())
    query = windows_by_time(stream, "ts", "(5,3)", ["key"], A.count(), 3600, "1 hour", origin).writeStream.outputMode("append").format("memory").queryName("early").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = spark.createDataFrame([*some, *some[30:35]], "ts timestamp, key int").withColumn("tick", tick_of("ts", "2024-01-01", 3600))
    assert found(spark.table("early")) == found(multi_window(kept, "(5,3)", ["key"], A.count(), until=89))


def test_window_stream_with_changing_timescales(spark, tmp_path):
    rows, events = _events(spark, tmp_path)
    signals.send(spark, f"{tmp_path}/signals", 6, 4, "addition", 9)
    signals.send(spark, f"{tmp_path}/signals", 5, 3, "deletion", 21)
    sink = WindowStream(f"{tmp_path}/state", "(5,3)", ["key"], A.count(), signals=f"{tmp_path}/signals", late=50)
    query = events.withColumn("tick", tick_of("ts", "2024-01-01", 3600)).writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    sink.flush(spark, 100, 40)
    sink.flush(spark, 100, 40)  # again, as after a failure
    registry = Registry.of("(5,3)").apply([(6, 4, 1, 9), (5, 3, 2, 21)])
    ticks = [((t - dt.datetime(2024, 1, 1)) // dt.timedelta(hours=1), k) for t, k in rows]
    assert found(sink.results(spark)) == brute(ticks, registry.lives, 40)
    assert sink.clean(spark, 101) >= 1 and sink.clean(spark, 101) == 0 and found(sink.results(spark)) == brute(ticks, registry.lives, 40)


@pytest.mark.parametrize("select", ["greedy", "dp"])
def test_window_stream_plans_each_batch(spark, tmp_path, select):
    """Windows of a batch from each other, with timescales that come and go, gaps, repeated batches and a null key."""
    r = random.Random(4)
    rows = [(t, r.choice([0, 1, None])) for t in [*range(40), *range(90, 130)] for _ in range(r.randint(0, 3))]
    signals.send(spark, f"{tmp_path}/signals", 6, 4, "addition", 9)
    signals.send(spark, f"{tmp_path}/signals", 12, 2, "addition", 33)
    signals.send(spark, f"{tmp_path}/signals", 5, 3, "deletion", 100)
    sink = WindowStream(f"{tmp_path}/state", "(5,3)(10,5)", ["key"], A.count(), signals=f"{tmp_path}/signals", late=3, select=select)
    parts = [rows[:30], rows[30:70], [], rows[70:]]
    for k, part in enumerate(parts):
        for _ in range(1 + (k == 1)):
            sink(spark.createDataFrame(part, "tick long, key int"), k)
    sink.flush(spark, len(parts), 150)
    registry = Registry.of("(5,3)(10,5)").apply([(6, 4, 1, 9), (12, 2, 1, 33), (5, 3, 2, 100)])
    got, want = sink.results(spark), multi_window(spark.createDataFrame(rows, "tick long, key int"), registry, ["key"], A.count(), until=150, mode="naive")
    cells = lambda df: Counter(map(tuple, df.select("w", "i", "window_start", "window_end", "key", "n", "fully_processed").collect()))
    assert cells(got) == cells(want) and sink.selected == select and got.count() > 100
    assert len(list((tmp_path / "state" / "closed").glob("batch=*"))) <= 3


def test_window_stream_goes_by_measured_seconds(spark, tmp_path, monkeypatch):
    """dp while planning takes up to a twentieth of the seconds of earlier batches; slices where a plan would be too large."""
    now, steps = [0.0], iter([1, 10, 0.1, 30, 1, 1, 5, 5])  # planning, making windows, planning, ...

    def clock():
        clock.calls += 1
        if clock.calls % 3 != 1:  # three looks a batch: before planning, after it, after writing
            now[0] += next(steps)
        return now[0]

    clock.calls = 0
    sink = WindowStream(f"{tmp_path}/state", "(4,2)(5,3)(12,3)", ["key"], A.count(), select="adaptive", clock=clock)
    taken = []
    for k in range(3):
        sink(spark.createDataFrame([(t, 0) for t in range(20 * k, 20 * k + 20)], "tick long, key int"), k)
        taken.append((sink.selected, round(sink.planning_s, 6), round(sink.final_s, 6)))
    assert taken == [("dp", 1, 10), ("greedy", 1.1, 40), ("dp", 2.1, 41)]
    monkeypatch.setattr("tidewheel.streaming.windows.MOST_EDGES", 3)
    sink(spark.createDataFrame([(t, 0) for t in range(60, 80)], "tick long, key int"), 3)
    assert sink.selected == "slices"
    want = multi_window(spark.createDataFrame([(t, 0) for t in range(80)], "tick long, key int"), "(4,2)(5,3)(12,3)", ["key"], A.count(), until=79, mode="naive")
    assert found(sink.results(spark)) == found(want)


def test_windows_in_state_equal_batch(spark, tmp_path):
    """Early, late and repeated records, null keys and values, timescales that come and go."""
    day = dt.datetime(2024, 1, 1)
    r = random.Random(8)
    early = [(day - dt.timedelta(hours=k, minutes=5), 0, 1) for k in range(6)]
    some = [(day + dt.timedelta(minutes=31 * k), r.choice([0, 1, None]), r.choice([3, 2**53 + 1, None])) for k in range(60)]
    late = [(day + dt.timedelta(hours=3), 7, 1)]
    after = [(day + dt.timedelta(hours=90), 0, 5)]
    schema = "ts timestamp, key int, value long"
    for k, part in enumerate((early, some[:30], some[28:30] + some[30:], after, late)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    kept = spark.createDataFrame([*some, *some[28:30]], schema).withColumn("tick", tick_of("ts", "2024-01-01", 3600))
    origin = int(day.replace(tzinfo=dt.timezone.utc).timestamp())
    registry = lambda: Registry.of("(5,3)(7,2)").apply([(6, 4, 1, 9), (5, 3, 2, 21)])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, agg in (("counted", A.count()), ("summed", A.total("value", "n"))):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
            out = windows_in_state(stream, "ts", registry(), ["key"], agg, 3600, "2 hours", origin)
            query = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
            query.awaitTermination()
            rows = spark.table(name).where("window_end < 80")
            assert rows.count() == len(found(rows)) and found(rows) == found(multi_window(kept, registry(), ["key"], agg, until=79)), name
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
