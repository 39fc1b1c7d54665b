"""Numeric helpers that every operator shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite; never null itself."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INFINITY))


def all_finite(*columns: Column | str) -> Column:
    out = is_finite(columns[0])
    for c in columns[1:]:
        out = out & is_finite(c)
    return out


def clamp(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def divide_float32(a: Column | str, b: float | Column) -> Column:
    """Single-precision quotient: the double quotient of two singles rounds to it exactly."""
    b = F.lit(b) if not isinstance(b, Column) else b
    return (col(a).cast("float").cast("double") / b.cast("float").cast("double")).cast("float")


def sorted_values(values: Column | str) -> Column:
    return F.array_sort(F.collect_list(col(values)))


def nearest_rank(values: Column, p: float) -> Column:
    """Element ``round((n - 1) * p)`` of the sorted values, half up (0-based)."""
    ordered = sorted_values(values)
    return F.element_at(ordered, (F.floor((F.size(ordered) - 1) * F.lit(p) + 0.5) + 1).cast("int"))


def upper_median(values: Column) -> Column:
    """Element ``n // 2`` of the sorted values (0-based)."""
    ordered = sorted_values(values)
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def middle_median(values: Column) -> Column:
    """The middle value, or the mean of the two middle ones."""
    ordered = sorted_values(values)
    n = F.size(ordered)
    return (F.element_at(ordered, (F.floor((n + 1) / 2)).cast("int")) + F.element_at(ordered, (F.floor(n / 2) + 1).cast("int"))) / 2


def hash_uniform(*key: Column | str) -> Column:
    """A repeatable uniform number in (0, 1) for a key; partitioning does not matter."""
    h = F.shiftrightunsigned(F.xxhash64(*[col(k) for k in key]), 11)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 53))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: large expressions that name it often stay small."""
    return F.transform(F.array(value), use)[0]
