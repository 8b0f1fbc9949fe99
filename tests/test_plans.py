import random
import time

import pytest

from tidewheel.plans.horizon import HorizonPlan
from tidewheel.plans.sharing import Options, SharePlan, cost_groups, group_cost
from tidewheel.plans.slices import SlicePlan, next_edge, period
from tidewheel.plans.timescale import Live, Registry, Timescale, format_timescales, parse_timescales
from tidewheel.sources.generators import random_timescales


def test_parser():
    assert [(t.w, t.i) for t in parse_timescales("(30,2)(40,4)(50,6)(60,7)")] == [(30, 2), (40, 4), (50, 6), (60, 7)]
    assert format_timescales(parse_timescales("(10,2)(5,1)")) == "(5,1)(10,2)"
    assert format_timescales(parse_timescales("(10,2)(5,1)", sort=False)) == "(10,2)(5,1)"
    for bad in ("23, 45, 15, 12", "", "(0,1)", "(3,4)", "(3,)", "(4,2)x"):
        with pytest.raises(ValueError):
            parse_timescales(bad)


@pytest.mark.parametrize(
    ("scales", "length", "edges"),
    [("(4,2)(6,3)(10,4)", 12, [2, 3, 4, 6, 8, 9, 10, 12]), ("(4,2)(5,3)(6,3)", 6, [1, 2, 3, 4, 6]), ("(4,2)(5,3)(8,4)", 12, [1, 2, 3, 4, 6, 7, 8, 9, 10, 12]), ("(5,3)", 6, [1, 3, 4, 6])],
)
def test_edges(scales, length, edges):
    plan = SlicePlan(scales)
    assert (plan.period, plan.edges) == (length, edges)
    assert plan.upto(2 * length) == edges + [e + length for e in edges]
    assert [plan.begin(e) for e in edges] == [0, *edges[:-1]]


def test_edges_without_a_period():
    assert (period("(7,3)(10,5)(20,8)"), len(SlicePlan("(7,3)(10,5)(20,8)").edges)) == (120, 96)
    for seed in range(40):
        scales = random_timescales(3, (2, 20), (1, 8), seed)
        plan = SlicePlan(scales)
        assert all(plan.next(t) == min(next_edge(t, x) for x in scales) for t in range(80))


def test_active_slices_cut_where_windows_begin():
    plan = SlicePlan("(5,3)", "active")
    assert plan.edges == [1, 4, 6] and plan.active == [3]


def test_due_windows():
    registry = Registry.of("(4,2)(5,3)(8,4)")
    due = {t: [t - x.scale.w for x in registry.due(t)] for t in range(1, 13)}
    assert {t: v for t, v in due.items() if v} == {2: [-2], 3: [-2], 4: [0, -4], 6: [2, 1], 8: [4, 0], 9: [4], 10: [6], 12: [8, 7, 4]}


def test_registry():
    r = Registry(0)
    r.add((5, 3), 7)
    assert r.add((6, 4), 10, "grid").since == 8
    r.remove((5, 3), 13)
    assert [x.scale.w for t in (10, 13, 16) for x in r.due(t)] == [5, 5, 6]
    with pytest.raises(KeyError):
        r.remove((5, 3), 14)


# Edges, due windows, a plan and groups of these timescales.
def test_greedy_plan():
    plan = SharePlan("(4,2)(5,3)(6,3)", select="greedy")
    scale = {w: k for k, w in enumerate((4, 5, 6))}
    node = lambda w, e: plan.nodes[scale[w], e % 6]
    assert node(6, 3).children == [(-1, -3, -2), (1, -2, 3)] and node(6, 3).ref_cnt == 0
    assert node(6, 6).children == [(0, 0, 4), (-1, 4, 6)]
    assert node(5, 3).children == [(0, -2, 2), (-1, 2, 3)] and node(5, 3).ref_cnt == 1
    assert node(5, 6).children == [(-1, 1, 2), (0, 2, 6)] and node(5, 6).ref_cnt == 0
    assert [c[0] for c in node(4, 2).children] == [-1] * 3 and [node(4, e).ref_cnt for e in (2, 4, 6)] == [1, 1, 1]
    assert plan.slice_refs() == {1: 2, 2: 3, 3: 3, 4: 3, 6: 3}


def test_groups():
    groups = cost_groups("(4,2)(8,4)(10,5)(16,4)")
    assert [[(t.w, t.i) for t in g] for g in groups] == [[(4, 2)], [(8, 4), (16, 4)], [(10, 5)]]
    assert [round(group_cost(g), 3) for g in groups] == [1.5, 1.75, 0.6]


def test_every_plan_covers_its_windows():
    for seed in range(25):
        scales = random_timescales(4, (2, 24), (1, 6), seed, max_period=200)
        fewest = {}
        for o in (Options("slices"), Options("greedy"), Options("dp"), Options("dp", tradeoff=2), Options("adaptive", threshold=0), Options("dp", prune="enclosing", reuse=0.5), Options("greedy", prune="gap", gap=5), Options("dp", prune="cost", reuse=0.5), Options("dp", cache=0.5, seed=seed), Options("dp", cache=0)):
            plan = SharePlan(scales, o)
            for n in plan.nodes.values():
                at = n.begin
                for k, a, z in n.children:
                    assert a == at and z <= n.end and (k < 0 or z - a == scales[k].w and z % scales[k].i == 0)
                    at = z
                assert at == n.end
            fewest.setdefault(o.select, plan.cost()["merges_per_tick"])
        assert fewest["dp"] <= fewest["greedy"] and fewest["dp"] <= fewest["slices"]


def test_options_are_checked():
    for bad in ({"select": "best"}, {"prune": "some"}, {"cache": 1.5}):
        with pytest.raises(ValueError):
            SharePlan("(4,2)", **bad)
    assert SharePlan([Timescale(4, 2)], cache=0.0, select="dp").cost()["stored_windows"] == 0


def test_pruned_windows_are_not_shared():
    full, none = SharePlan("(4,2)(8,4)(16,4)", select="dp"), SharePlan("(4,2)(8,4)(16,4)", select="dp", prune="cost", reuse=0.0)
    assert full.cost()["stored_windows"] > 0 and none.cost()["stored_windows"] == 0


def test_horizon_plans_cover_windows_of_lives_that_come_and_go():
    r = random.Random(4)
    for seed in range(15):
        registry = Registry.of(random_timescales(3, (2, 20), (1, 7), seed))
        for _ in range(4):
            i = r.randint(1, 7)
            live = registry.add((r.randint(i, 25), i), r.randint(0, 60), r.choice(["own", "grid"]))
            if r.random() < 0.5:
                registry.remove(live.scale, live.since + r.randint(0, 40))
        counts = {}
        for select in ("slices", "greedy", "dp"):
            plan = HorizonPlan(registry, 120, select)
            order = {(x[0], x[2]): k for k, x in enumerate(plan.due(plan.lives[0].since, 120))}
            assert set(plan.spans) == {(k, e) for k, x in enumerate(registry.lives) for e in range(x.since + x.scale.i, min(120, 120 if x.until is None else x.until) + 1, x.scale.i)}
            for (life, end), s in plan.spans.items():
                at = s.begin
                for k, a, z in s.children:
                    assert a == at and z <= end and (k < 0 or (plan.spans[k, z].begin == a and order[k, z] < order[life, end]))
                    at = z
                assert at == end and s.begin == max(registry.lives[life].since, end - registry.lives[life].scale.w)
            counts[select] = plan.merges()
            step = HorizonPlan(registry, 0, select)
            for t in (7, 60, 61, 120):
                step.extend(t)
            assert step.node_rows() == plan.node_rows() and step.edge_rows() == plan.edge_rows()
            flat = HorizonPlan(registry, 120, select, most_levels=2)
            assert flat.levels <= 2 and set(flat.spans) == set(plan.spans)
        assert counts["dp"] <= counts["greedy"] and counts["dp"] <= counts["slices"]


def test_horizon_plan_equals_the_periodic_one_in_the_steady_state():
    scales = parse_timescales("(4,2)(5,3)(6,3)")
    plan, periodic = HorizonPlan(Registry.of(scales), 60, "dp"), SharePlan(scales, select="dp")
    tail = [s for s in plan.spans.values() if 30 < s.end <= 30 + periodic.period]
    assert sum(len(s.children) for s in tail) == sum(len(n.children) for n in periodic.nodes.values())


def test_a_hundred_timescales_are_planned_in_seconds():
    r = random.Random(1)
    scales = [(r.randint(200, 1200), r.randint(1, 100)) for _ in range(100)]
    began = time.perf_counter()
    plan = HorizonPlan(Registry.of(scales), 2400)
    assert time.perf_counter() - began < 10 and plan.merges() < HorizonPlan(Registry.of(scales), 2400, "slices").merges() / 4
    kept = len(plan.spans)
    plan.drop_before(1200)
    assert len(plan.spans) < kept and plan.extend(2500).until == 2500


def test_subscriptions_end_their_own_life():
    registry = Registry.of("(5,3)")
    first, second = registry.subscribe((6, 4), 2), registry.subscribe((6, 4), 7)
    second.unsubscribe(20)
    assert registry.lives == [Live(Timescale(5, 3)), Live(Timescale(6, 4), 2), Live(Timescale(6, 4), 7, 20)]
    assert second.unsubscribe(30).until == 20 and first.unsubscribe(9).until == 9
    with pytest.raises(ValueError):
        registry.subscribe((4, 2), 10).unsubscribe(5)
    assert [x.until for x in registry.lives] == [None, 9, 20, None]
