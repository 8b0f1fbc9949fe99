"""Keyed aggregates as three sets of column expressions: from rows to buffers, from buffers to a buffer, from a buffer to results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """partial and merge: buffer name -> aggregate expression (merge reads the buffers); final: result name -> expression.

    All are commutative and associative. invertible: a buffer can be taken out of another again by subtraction."""

    partial: dict[str, Column]
    merge: dict[str, Column]
    final: dict[str, Column]
    invertible: bool = False
    #: Whether partial and merge gather rows: then only so many at a time are given to them.
    gathers: bool = False
    #: For aggregates of distinct values: the value, and results by name from the distinct values in _value.
    value: Column | None = None
    by_value: dict[str, Column] = field(default_factory=dict)

    def partials(self) -> list[Column]:
        return [c.alias(n) for n, c in self.partial.items()]

    def merges(self) -> list[Column]:
        return [c.alias(n) for n, c in self.merge.items()]

    def gathered(self) -> list[Column]:
        return [c.alias(n) for n, c in self.by_value.items()]

    def finals(self) -> list[Column]:
        return [c.alias(n) for n, c in self.final.items()]


def _sums(partial: dict[str, Column], final: dict[str, Column]) -> Aggregate:
    return Aggregate(partial, {n: F.sum(n) for n in partial}, final, invertible=True)


def count(name: str = "n") -> Aggregate:
    return _sums({"_n": F.count("*")}, {name: F.col("_n")})


def total(value, name: str = "total") -> Aggregate:
    return _sums({"_s": F.sum(value)}, {name: F.col("_s")})


def avg(value, name: str = "mean") -> Aggregate:
    """Exact mean of the values that aren't null, in double."""
    return _sums({"_s": F.sum(value), "_n": F.count(value)}, {name: F.col("_s") / F.col("_n")})


def avg_trunc(value, name: str = "mean") -> Aggregate:
    """Mean of whole numbers, cut toward zero."""
    whole = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(None)).cast("long")
    cut = F.when(F.col("_n") > 0, F.expr("_s div _n"))
    return _sums({"_s": F.sum(whole), "_n": F.count(whole)}, {name: cut})


def linreg(x, y, slope: str = "slope", intercept: str = "intercept") -> Aggregate:
    """Least squares of y on x, over rows where both are known; (0, 0) where x does not vary."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = (F.when(both, c.cast("double")) for c in (x, y))
    bottom = F.col("_n") * F.col("_xx") - F.col("_x") * F.col("_x")
    level = F.coalesce(bottom, F.lit(0.0)) == 0

    def ratio(top: Column) -> Column:
        return F.when(level, F.lit(0.0)).otherwise(top / bottom)

    final = {slope: ratio(F.col("_n") * F.col("_xy") - F.col("_x") * F.col("_y")), intercept: ratio(F.col("_xx") * F.col("_y") - F.col("_xy") * F.col("_x"))}
    return _sums({"_x": F.sum(x), "_y": F.sum(y), "_xy": F.sum(x * y), "_xx": F.sum(x * x), "_n": F.count(x)}, final)


def minmax(value, low: str = "low", high: str = "high") -> Aggregate:
    return Aggregate({"_lo": F.min(value), "_hi": F.max(value)}, {"_lo": F.min("_lo"), "_hi": F.max("_hi")}, {low: F.col("_lo"), high: F.col("_hi")})


def presence() -> Aggregate:
    """That there are records, and nothing of them."""
    return Aggregate({"_any": F.max(F.lit(True))}, {"_any": F.max("_any")}, {})


def uniq(value, name: str = "values", count_name: str | None = None) -> Aggregate:
    """The distinct values that aren't null, sorted, or their number.

    Windows group by the value as well first, so that a number needs no set; a set that is asked for is a result's size.
    Streams, which keep buffers, keep sets in them."""
    value = F.col(value) if isinstance(value, str) else value
    merged = F.array_distinct(F.flatten(F.collect_list("_set")))
    final = {count_name: F.size("_set").cast("long")} if count_name else {name: F.array_sort("_set")}
    by_value = {count_name: F.count("_value")} if count_name else {name: F.array_sort(F.collect_list("_value"))}
    return Aggregate({"_set": F.collect_set(value)}, {"_set": merged}, final, value=value, by_value=by_value)


def approx_uniq(value, name: str = "n_values", lg: int = 12) -> Aggregate:
    """About how many distinct values there are, by sketches of a fixed size."""
    return Aggregate({"_hll": F.hll_sketch_agg(value, lg)}, {"_hll": F.hll_union_agg("_hll")}, {name: F.hll_sketch_estimate("_hll")})


def fold(value: Column, zero: Column, step: Callable[[Column, Column], Column], name: str = "value") -> Aggregate:
    """Any commutative and associative step on values of zero's type, which must be neutral. Rows are gathered some at a time."""
    merged = F.aggregate(F.collect_list("_v"), zero, step)
    return Aggregate({"_v": F.aggregate(F.collect_list(value), zero, step)}, {"_v": merged}, {name: F.col("_v")}, gathers=True)
