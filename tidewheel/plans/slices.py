"""Slices: the coarsest cuts of the tick axis that serve every window of a set of timescales."""

from __future__ import annotations

import math
from bisect import bisect_right

from tidewheel.plans.timescale import Timescale, as_timescales


def period(timescales) -> int:
    """Least common multiple of the intervals, rounded up to a multiple that reaches the largest window."""
    scales = as_timescales(timescales)
    lcm = math.lcm(*(t.i for t in scales))
    return lcm * max(1, -(-max(t.w for t in scales) // lcm))


def next_edge(t: int, scale: Timescale) -> int:
    """The first edge after tick t of one timescale registered at 0."""
    c = t % scale.i
    return t - c + (scale.turn if scale.turn and c < scale.turn else scale.i)


class SlicePlan:
    """Edges of one period, (0, period]. mode "paired" cuts wherever a window begins or ends; mode "active" cuts only where
    one begins, and the other edges are points at which windows read the open slice."""

    def __init__(self, timescales, mode: str = "paired"):
        if mode not in ("paired", "active"):
            raise ValueError(f"mode is paired or active, not {mode!r}")
        self.scales, self.mode = as_timescales(timescales), mode
        self.period = period(self.scales)
        begins = {k + t.turn for t in self.scales for k in range(0, self.period + 1, t.i)} - {0}
        ends = {k for t in self.scales for k in range(t.i, self.period + 1, t.i)}
        begins = {e for e in begins if e <= self.period} | {self.period}
        self.edges = sorted(begins | ends if mode == "paired" else begins)
        self.active = sorted(ends - begins) if mode == "active" else []

    def next(self, t: int) -> int:
        """The end of the slice that holds tick t."""
        c = t % self.period
        return t - c + self.edges[bisect_right(self.edges, c)]

    def begin(self, end: int) -> int:
        """Where the slice that ends at `end` begins."""
        c = (end - 1) % self.period
        k = bisect_right(self.edges, c)
        return end - 1 - c + (self.edges[k - 1] if k else 0)

    def upto(self, t: int) -> list[int]:
        out, at = [], 0
        while (at := self.next(at)) <= t:
            out.append(at)
        return out

    @property
    def per_tick(self) -> float:
        return len(self.edges) / self.period
