"""Registered queries over tables that reach beyond the sizes of the sample tables."""

import datetime as dt

import pytest

from tidewheel.queries import QUERIES


def ends(scales, t, since=0):
    """(w, i, end) of every window that holds tick t."""
    return [(w, i, e) for w, i in scales for e in range(t + 1, t + w + 1) if (e - since) % i == 0 and e > since]


def test_linreg_takes_line_items_of_all_days(spark, tmp_path):
    days = [0, 1097, 2699, 2700, 3000, 3595, 5000]
    rows = [(dt.date(1992, 1, 1) + dt.timedelta(days=d), "A", float(x), 10.0 * d + 2.0 * x) for d in days for x in (1, 2)]
    spark.createDataFrame(rows, "l_shipdate date, l_returnflag string, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["w"], r["i"], r["window_end"]): (r["slope"], r["intercept"]) for r in QUERIES["mts_linreg"](spark, str(tmp_path)).collect()}
    held = {}
    for d in days:
        for key in ends([(30, 30), (90, 30), (100, 60)], d):
            held.setdefault(key, []).append(d)
    assert got.keys() == held.keys()
    for key, some in held.items():
        assert got[key] == pytest.approx((2.0, 10.0 * sum(some) / len(some))), key


def test_rates_go_on_for_all_events(spark, tmp_path):
    n, rates = 17_000, [50, 150, 100, 300, 200]
    spark.range(n).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "'view' AS event_type").write.parquet(f"{tmp_path}/events.parquet")
    expect, left, t = {}, n, 0
    while left:
        some = min(left, rates[t % 5])
        for key in ends([(5, 2), (10, 5)], t):
            expect[key] = expect.get(key, 0) + some
        left, t = left - some, t + 1
    assert t > 100
    assert {(r["w"], r["i"], r["window_end"]): r["n"] for r in QUERIES["mts_rate_based"](spark, str(tmp_path)).collect()} == expect


def _talk(spark, path):
    """A word said once in each of some conversations; their ticks."""
    ids = [0, 55, 150, 215, 399, 400, 401, 780, 999, 20_003]
    spark.createDataFrame([(k, 0, "user", "hello the") for k in ids], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return [k // 10 for k in ids]


def test_words_of_all_conversations(spark, tmp_path):
    expect = {}
    for t in _talk(spark, tmp_path):
        for key in ends([(4, 2), (5, 3)], t):
            expect[key] = expect.get(key, 0) + 1
    assert {(r["w"], r["i"], r["window_end"]): r["n"] for r in QUERIES["word_count_windows"](spark, str(tmp_path)).collect()} == expect


def test_open_timescale_counts_words_of_all_conversations(spark, tmp_path):
    expect = {}
    for t in _talk(spark, tmp_path):
        open_ones = ends([(5, 3)], t, since=6) if t >= 6 else []
        for key in [k for k in ends([(4, 2)], t) if k[2] <= 20] + open_ones:
            expect[key] = expect.get(key, 0) + 1
    assert {(r["w"], r["i"], r["window_end"]): r["n"] for r in QUERIES["word_count_dynamic"](spark, str(tmp_path)).collect()} == expect


def test_totals_are_over_all_events(spark, tmp_path):
    day, scales = dt.datetime(2024, 1, 1), [(5, 4), (6, 6), (24, 6), (48, 10)]
    rows = [(k, day + dt.timedelta(hours=7 * k % 720), 5 * k, ["view", "purchase", "click"][k % 3]) for k in range(150) if not 200 < 7 * k % 720 < 300]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    last = max(7 * k % 720 for k, *_ in rows) + 1  # windows end with the table, here before and below after hour 720
    expect = {(w, i, e): 0 for w, i in scales for e in range(i, last + 1, i)}
    for k, *_ in rows:
        for key in ends(scales, 7 * k % 720):
            if key in expect:
                expect[key] += 1
    assert {(r["w"], r["i"], r["window_end"]): r["total"] for r in QUERIES["mts_totals"](spark, str(tmp_path)).collect()} == expect
    assert 0 in expect.values()


def test_events_after_a_month_are_in_windows(spark, tmp_path):
    """The end comes from the table: nothing is cut at the 30 days of the sample tables."""
    day, scales = dt.datetime(2024, 1, 1), [(5, 4), (6, 6), (24, 6), (48, 10)]
    hours = [0, 719, 720, 733, 1500]
    rows = [(k, day + dt.timedelta(hours=h), k, "view", 1.0) for k, h in enumerate(hours)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    held = {}
    for h in hours:
        for key in ends(scales, h):
            held[key] = held.get(key, 0) + 1
    for name in ("mts_count_shared", "mts_count_auto", "mts_tree", "sink_by_timescale"):
        assert {(r["w"], r["i"], r["window_end"]): r["n"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == held, name
    totals = {(r["w"], r["i"], r["window_end"]): r["total"] for r in QUERIES["mts_totals"](spark, str(tmp_path)).collect()}
    assert totals == {(w, i, e): held.get((w, i, e), 0) for w, i in scales for e in range(i, 1502, i)}
