"""Sharing plans whose size does not follow the time span: a periodic plan for each stretch between two changes.

From the largest window after a change on, what each window is merged from repeats with the least common multiple of the
intervals. So the windows right after a change, which reach across it, are planned one by one (the splice), then one
period, which stands for all that follow up to the next change. Timescales whose common period is long are dealt to groups
of short ones; a group has slices of its own, and a change concerns its own group only."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from tidewheel.plans.horizon import HorizonPlan, Span
from tidewheel.plans.timescale import Live, Registry


class TooLarge(Exception):
    """The plan would have more edges than its limit."""


@dataclass
class Segment:
    """Windows of a group that fire in (low, high]. rows: (level, child's life or -1 for a slice, phase, parent's life, delta):
    a child that ends at `at` serves the parent that ends at at + delta, where (at - low + reach) mod `mod` is the phase."""

    group: int
    low: int
    high: int
    mod: int
    reach: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def phase(self, at: int) -> int:
        return (at - self.low + self.reach) % self.mod


def period_groups(lives: list[Live], most: int | None = None) -> list[list[int]]:
    """Numbers of lives in groups whose intervals have a common multiple of at most `most` (default: the largest interval, or
    128); a life joins the group whose period it lengthens least. Larger intervals come first."""
    most = max(128, *(x.scale.i for x in lives)) if most is None else most
    groups: list[tuple[int, list[int]]] = []
    for k in sorted(range(len(lives)), key=lambda k: (-lives[k].scale.i, k)):
        i = lives[k].scale.i
        fits = [(math.lcm(p, i) / p, n) for n, (p, _) in enumerate(groups) if math.lcm(p, i) <= most or math.lcm(p, i) == p]
        if fits:
            _, n = min(fits)
            groups[n] = math.lcm(groups[n][0], i), [*groups[n][1], k]
        else:
            groups.append((i, [k]))
    return [sorted(some) for _, some in groups]


class EpochPlan:
    """Which slices and earlier windows each window of a registry's lives is merged from, up to `until` (which may be any number).

    select: "slices", "greedy", "dp" or "adaptive" (dp while planning has taken less than threshold * budget_s seconds by
    `clock`). most_levels: windows of that level are not shared. most_edges: TooLarge is raised beyond. The numbers of
    lives are those of the registry; segments hold the plan."""

    def __init__(self, registry: Registry, until: int, select: str = "greedy", most_levels: int | None = None, most_edges: int = 1_000_000, most_period: int | None = None, threshold: float = 0.05, budget_s: float = 20.0, clock: Callable[[], float] = time.perf_counter):
        if select not in ("slices", "greedy", "dp", "adaptive"):
            raise ValueError(f"select is slices, greedy, dp or adaptive, not {select!r}")
        self.lives, self.until, self.most_levels, self.most_edges = registry.lives, until, most_levels, most_edges
        self.select, self.clock, self.dp_until = select, clock, clock() + threshold * budget_s
        self.groups = period_groups(self.lives, most_period) if self.lives else []
        self.segments: list[Segment] = []
        self.planned = 0  # windows that were planned one by one
        self.edges = 0
        for g, numbers in enumerate(self.groups):
            self._plan(g, numbers)

    def _select(self) -> str:
        if self.select != "adaptive":
            return self.select
        return "dp" if self.clock() < self.dp_until else "greedy"

    def _extend(self, plan: HorizonPlan, numbers: list[int], segment: Segment, low: int, high: int) -> None:
        """Plans the windows that fire in (low, high] and adds their rows to the segment."""
        step = max(1, min((x.scale.i for x in plan.lives), default=1))
        for at in range(low, high, step):  # some windows at a time: the limit counts, and the clock
            plan.select = self._select()
            upto = min(high, at + step)
            before = len(plan.spans)
            plan.extend(upto)
            for span in list(plan.spans.values())[before:]:
                self.planned += 1
                self.edges += len(span.children)
                segment.rows += [(span.level, numbers[k] if k >= 0 else -1, segment.phase(e), numbers[span.life], span.end - e) for k, _, e in span.children]
            if self.edges > self.most_edges:
                raise TooLarge(f"more than {self.most_edges} edges")

    def _plan(self, g: int, numbers: list[int]) -> None:
        lives = [self.lives[k] for k in numbers]
        widest = max(x.scale.w for x in lives)
        low = min(x.since for x in lives)
        plan = HorizonPlan(Registry(low, lives), low, "slices", self.most_levels)
        if widest > self.most_edges:
            # A window may have as many slices as ticks: look before planning one.
            some = max(x.scale.w / min(y.scale.i for y in lives) for x in lives)
            if some > self.most_edges:
                raise TooLarge("a window has too many slices")
        changes = sorted({c for x in lives for c in (x.since, x.until) if c is not None and low <= c < self.until})
        for a, b in zip(changes, [*changes[1:], self.until]):
            active = [k for k, x in enumerate(lives) if x.since <= a and (x.until is None or x.until > a)]
            if active:
                period = math.lcm(*(lives[k].scale.i for k in active))
                steady = a + max(lives[k].scale.w for k in active)
                if b - steady > 2 * period:
                    self._steady(plan, g, numbers, a, steady, b, period, widest, active)
                else:
                    segment = Segment(g, a, b, b - a + widest + 1, widest)
                    self._extend(plan, numbers, segment, a, b)
                    self.segments.append(segment)
            plan.until = b
            plan.drop_before(b - widest)

    def _steady(self, plan: HorizonPlan, g: int, numbers: list[int], a: int, steady: int, b: int, period: int, widest: int, active: list[int]) -> None:
        splice = Segment(g, a, steady, steady - a + widest + 1, widest)
        self._extend(plan, numbers, splice, a, steady)
        repeated = Segment(g, steady, b, period, widest)
        self._extend(plan, numbers, repeated, steady, steady + period)
        self.segments += [splice, repeated]
        # What windows after the next change may be merged from, as it stands one or more periods before.
        first = max(steady + period, b - widest)
        for k in active:
            x = plan.lives[k]
            for end in range(x.since + ((first - x.since) // x.scale.i + 1) * x.scale.i, b + 1, x.scale.i):
                turn = -(-(end - steady - period) // period) * period
                model = plan.spans[k, end - turn]
                plan.know(Span(k, end - x.scale.w, end, [], 0, model.level))

    @property
    def levels(self) -> int:
        return max((r[0] for s in self.segments for r in s.rows), default=0)

    def segment_rows(self) -> list[tuple[int, int, int, int, int, int]]:
        """(segment, group, low, high, mod, reach)."""
        return [(n, s.group, s.low, s.high, s.mod, s.reach) for n, s in enumerate(self.segments)]

    def pattern_rows(self) -> list[tuple[int, int, int, int, int, int]]:
        """(segment, level, child, phase, parent, delta)."""
        return [(n, *r) for n, s in enumerate(self.segments) for r in s.rows]

    def children(self, life: int, end: int) -> list[tuple[int, int]]:
        """(child's life or -1, its end) of one window, in order of time: what the plan says, written out."""
        out = []
        for s in self.segments:
            if life in self.groups[s.group] and s.low < end <= s.high:
                out += [(c, end - delta) for _, c, phase, parent, delta in s.rows if parent == life and s.phase(end - delta) == phase]
        return sorted(out, key=lambda x: x[1])
