import random
import time

import pytest

from tidewheel.functions import aggregates as A
from tidewheel.operators import windows
from tidewheel.operators.windows import multi_window
from tidewheel.plans.epochs import EpochPlan, TooLarge, period_groups
from tidewheel.plans.horizon import HorizonPlan
from tidewheel.plans.timescale import Live, Registry


def changing(r, until=500):
    registry = Registry(0)
    for _ in range(r.randint(1, 4)):
        i = r.randint(1, 6)
        registry.add((r.randint(i, 20), i), 0)
    for _ in range(r.randint(0, 4)):
        i = r.randint(1, 6)
        registry.add((r.randint(i, 20), i), r.randint(1, 400))
        if r.random() < 0.5:
            k = r.choice([k for k, x in enumerate(registry.lives) if x.until is None])
            x = registry.lives[k]
            registry.lives[k] = Live(x.scale, x.since, r.randint(x.since + 1, until))
    return registry


def test_every_window_has_the_children_of_the_plan_over_absolute_time():
    r = random.Random(1)
    repeated = 0
    for _ in range(60):
        registry, select, most = changing(r), r.choice(["slices", "greedy", "dp"]), r.choice([None, 2, 3])
        plan = EpochPlan(registry, 700, select, most, most_period=r.choice([None, 1, 12]))
        assert sorted(k for some in plan.groups for k in some) == list(range(len(registry.lives)))
        for numbers in plan.groups:
            whole = HorizonPlan(Registry(0, [registry.lives[k] for k in numbers]), 700, select, most)
            for k, end in r.sample(sorted(whole.spans), min(60, len(whole.spans))):
                assert plan.children(numbers[k], end) == [(numbers[c] if c >= 0 else -1, e) for c, _, e in whole.spans[k, end].children]
            repeated += len(whole.spans)
        repeated -= plan.planned
    assert repeated > 10_000  # windows that no row of the plan was made for


@pytest.mark.parametrize("select", ["greedy", "dp", "adaptive"])
def test_ten_years_of_minutes(select):
    signals = [(24, 6, 1, 100), (48, 10, 1, 205), (24, 6, 2, 400_000), (6, 6, 2, 300), (24, 6, 1, 500_000)]
    registry, until = Registry.of("(5,4)(6,6)").apply(signals), 10 * 365 * 1440
    began = time.perf_counter()
    plan = EpochPlan(registry, until, select)
    assert time.perf_counter() - began < 10 and len(plan.pattern_rows()) < 10_000
    longer = EpochPlan(registry, 2**62, select)
    assert len(longer.pattern_rows()) == len(plan.pattern_rows()) or select == "adaptive"


@pytest.mark.parametrize("select", ["greedy", "dp"])
def test_a_hundred_timescales_with_changes(select):
    r = random.Random(7)
    registry = Registry(0)
    for k in range(110):
        i = r.randint(1, 100)
        registry.add((r.randint(200, 1200), i), max(0, k - 99) * 100_000)
    began = time.perf_counter()
    plan = EpochPlan(registry, 5_256_000, select, 3, most_edges=2_000_000)
    assert time.perf_counter() - began < 20 and plan.planned < 20_000


def test_a_change_is_planned_in_its_own_group_only():
    base = [(12, 4), (24, 6), (21, 7), (35, 35)]
    one = EpochPlan(Registry.of(base), 10_000, most_period=12)
    other = Registry.of(base)
    other.add((14, 7), 5_000)
    two = EpochPlan(other, 10_000, most_period=35)
    groups = period_groups(other.lives, 35)
    assert [g for g in groups if 4 in g] == [[2, 3, 4]]
    touched = [s for s in two.segments if s.low >= 5_000 - 1]
    assert {s.group for s in touched} == {groups.index([2, 3, 4])}
    assert two.planned - one.planned < 60


def test_adaptive_goes_by_the_clock():
    ticks = iter(range(10**6))
    slow = EpochPlan(Registry.of("(4,2)(5,3)(12,3)(30,5)"), 600, "adaptive", threshold=0.5, budget_s=20, clock=lambda: next(ticks))
    dp, greedy = (EpochPlan(Registry.of("(4,2)(5,3)(12,3)(30,5)"), 600, s) for s in ("dp", "greedy"))
    fast = EpochPlan(Registry.of("(4,2)(5,3)(12,3)(30,5)"), 600, "adaptive", clock=lambda: 0)
    assert fast.pattern_rows() == dp.pattern_rows()
    assert dp.edges <= slow.edges <= greedy.edges


def found(df):
    return sorted((r["w"], r["i"], r["window_start"], r["window_end"], r["key"], r["n"]) for r in df.collect())


@pytest.mark.parametrize("mode", ["greedy", "dp"])
def test_sparse_records_over_a_long_time(spark, mode):
    r = random.Random(5)
    registry = Registry.of("(5,4)(6,6)(50,7)").apply([(24, 6, 1, 100), (48, 10, 1, 20_005), (24, 6, 2, 40_000), (6, 6, 2, 300), (24, 6, 1, 70_001)])
    rows = [(t + r.randint(0, 60), r.randint(0, 2)) for t in (0, 90, 290, 9_999, 19_990, 20_040, 39_980, 69_990, 99_000) for _ in range(40)]
    df = spark.createDataFrame(rows, "tick long, key int").persist()
    want = found(multi_window(df, registry, ["key"], A.count(), until=100_000, mode="slices"))
    assert found(multi_window(df, registry, ["key"], A.count(), until=100_000, mode=mode)) == want
    assert found(multi_window(df, registry, ["key"], A.count(), until=2**62, mode=mode)) == found(multi_window(df, registry, ["key"], A.count(), until=2**62, mode="naive"))


def test_no_end_and_plans_that_are_too_large(spark, monkeypatch):
    df = spark.createDataFrame([(3, 1), (900, 2)], "tick long, key int")
    want = found(multi_window(df, "(40,7)(9,2)", ["key"], A.count(), until=2**62, mode="naive"))
    assert len(want) > 10
    assert found(multi_window(df, "(40,7)(9,2)", ["key"], A.count(), until=2**62, mode="tree")) == want
    with pytest.raises(TooLarge):
        EpochPlan(Registry.of([(3_000_000, 1)]), 10**7)
    with pytest.raises(TooLarge):
        EpochPlan(Registry.of("(400,1)"), 10**4, "slices", most_edges=5_000)
    monkeypatch.setattr(windows, "EpochPlan", lambda *a: (_ for _ in ()).throw(TooLarge()))
    assert found(multi_window(df, "(40,7)(9,2)", ["key"], A.count(), until=2**62, mode="dp")) == want
