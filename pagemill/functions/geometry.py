"""Boxes as four columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", suffix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def _positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def area(b: Box) -> Column:
    return _positive(b[2] - b[0]) * _positive(b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    return _positive(F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * _positive(F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def iou(a: Box, b: Box) -> Column:
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when((i <= 0) | (u <= 0), 0.0).otherwise(i / u)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def scale(values: Column, width: Column, height: Column) -> Column:
    """A box on the 0-999 grid in pixels, clamped; null if not finite or empty."""
    side = lambda i, full: F.least(F.greatest(F.element_at(values, i) / 999.0 * full, F.lit(0.0)), full.cast("double"))
    out = F.array(side(1, width), side(2, height), side(3, width), side(4, height))
    good = (F.size(values) == 4) & F.forall(values, finite)
    return F.when(good & (F.element_at(out, 3) > F.element_at(out, 1)) & (F.element_at(out, 4) > F.element_at(out, 2)), out)


def shrink(b: Box, by: int = 2, least: int = 24) -> Column:
    """The box drawn smaller on all sides, null if a side falls under ``least``."""
    x1, y1, x2, y2 = b[0] + by, b[1] + by, b[2] - by, b[3] - by
    return F.when((x2 - x1 >= least) & (y2 - y1 >= least), F.array(x1, y1, x2, y2))


def nearby(a: Box, b: Box, distance: float) -> Column:
    gap = lambda lo1, hi1, lo2, hi2: F.greatest(lo2 - hi1, lo1 - hi2, F.lit(0.0))
    return (gap(a[0], a[2], b[0], b[2]) <= distance) & (gap(a[1], a[3], b[1], b[3]) <= distance)


def parse_boxes(c: Column) -> Column:
    """Boxes in brackets, or one bare list; only groups of exactly four numbers count."""
    numbers = lambda g: F.transform(F.filter(F.split(g, ","), lambda v: F.trim(v) != ""), lambda v: F.try_cast(F.trim(v), "double") if hasattr(F, "try_cast") else v.try_cast("double"))
    groups = F.when(c.contains("["), F.regexp_extract_all(c, F.lit(r"\[([^\[\]]*)\]"), F.lit(1))).otherwise(F.array(c))
    return F.filter(F.transform(groups, numbers), lambda b: (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull()))
