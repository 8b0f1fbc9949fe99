"""Timescales: windows of w ticks that fire every i ticks, and the registry of those that are live."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

_PAIR = re.compile(r"\(\s*(\d+)\s*,\s*(\d+)\s*\)")


@dataclass(frozen=True)
class Timescale:
    """Registered at s, it fires at s + k*i for k >= 1 and covers the w ticks before."""

    w: int
    i: int

    def __post_init__(self):
        if self.w <= 0 or self.i <= 0 or self.w < self.i:
            raise ValueError(f"a timescale needs w >= i > 0, not ({self.w},{self.i})")

    def __str__(self) -> str:
        return f"({self.w},{self.i})"

    @property
    def turn(self) -> int:
        """Ticks after a firing at which the next windows that don't begin at a firing begin; 0 if w is a multiple of i."""
        return (self.i - self.w % self.i) % self.i


def parse_timescales(text: str, sort: bool = True) -> list[Timescale]:
    """'(30,2)(60,5)' as timescales, by window and then interval unless sort is off."""
    if not text.strip() or _PAIR.sub("", text).strip():
        raise ValueError(f"not a list of timescales: {text!r}")
    found = [Timescale(int(w), int(i)) for w, i in _PAIR.findall(text)]
    return sorted(found, key=lambda t: (t.w, t.i)) if sort else found


def format_timescales(timescales: Iterable[Timescale]) -> str:
    return "".join(map(str, timescales))


def as_timescales(given: str | Iterable[Timescale | tuple[int, int]]) -> list[Timescale]:
    if isinstance(given, str):
        return parse_timescales(given)
    return [t if isinstance(t, Timescale) else Timescale(*t) for t in given]


@dataclass(frozen=True)
class Live:
    """A timescale's life: fires after `since`, up to and with `until` (None: no end), over data from `since` on."""

    scale: Timescale
    since: int = 0
    until: int | None = None


@dataclass
class Registry:
    """Timescales that come and go. Adding the same one again makes a life of its own."""

    start: int = 0
    lives: list[Live] = field(default_factory=list)

    @classmethod
    def of(cls, timescales, start: int = 0) -> Registry:
        if isinstance(timescales, Registry):
            return timescales
        return cls(start, [Live(t, start) for t in as_timescales(timescales)])

    def add(self, scale: Timescale | tuple[int, int], at: int, align: str = "own") -> Live:
        """align "own": firings count from `at`; "grid": from the last multiple of the interval since the registry's start."""
        scale = as_timescales([scale])[0]
        if align not in ("own", "grid"):
            raise ValueError(f"align is own or grid, not {align!r}")
        live = Live(scale, at if align == "own" else at - (at - self.start) % scale.i)
        self.lives.append(live)
        return live

    def remove(self, scale: Timescale | tuple[int, int], at: int) -> Live:
        """Ends the oldest open life of the timescale; the firing at `at` itself still happens."""
        scale = as_timescales([scale])[0]
        for k, live in enumerate(self.lives):
            if live.scale == scale and live.until is None and live.since <= at:
                self.lives[k] = Live(scale, live.since, at)
                return self.lives[k]
        raise KeyError(f"no live timescale {scale} at {at}")

    def subscribe(self, scale: Timescale | tuple[int, int], at: int, align: str = "own") -> Subscription:
        """Adds the timescale and returns what ends just this life of it."""
        return Subscription(self, self.add(scale, at, align))

    def apply(self, signals: Iterable[tuple[int, int, int, int]], align: str = "own") -> Registry:
        """Signals (window, interval, type, start_time), type 1 to add and 2 to remove, by time."""
        for w, i, kind, at in sorted(signals, key=lambda s: s[3]):
            if kind == 1:
                self.add((w, i), at, align)
            elif kind == 2:
                self.remove((w, i), at)
            else:
                raise ValueError(f"signal type {kind} is neither 1 nor 2")
        return self

    def due(self, t: int) -> list[Live]:
        """Lives that fire at t, smaller windows first."""
        some = [x for x in self.lives if t > x.since and (t - x.since) % x.scale.i == 0 and (x.until is None or t <= x.until)]
        return sorted(some, key=lambda x: (x.scale.w, x.scale.i))


@dataclass
class Subscription:
    """One life of a timescale in a registry, for those who asked for it."""

    registry: Registry
    live: Live

    def unsubscribe(self, at: int) -> Live:
        """Ends the life, whatever other lives its timescale has; the firing at `at` itself still happens. What has ended stays as it
        ended. ValueError before its start."""
        if self.live.until is None:
            if at < self.live.since:
                raise ValueError(f"{self.live.scale} starts at {self.live.since}, after {at}")
            k = self.registry.lives.index(self.live)
            self.live = self.registry.lives[k] = Live(self.live.scale, self.live.since, at)
        return self.live
