"""Rectangles as four columns; all helpers take (x0, y0, x1, y1) tuples of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(alias: str = "") -> Box:
    dot = f"{alias}." if alias else ""
    return tuple(F.col(f"{dot}{c}") for c in ("x0", "y0", "x1", "y1"))


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    return F.abs(width(b) * height(b))


def common_width(a: Box, b: Box) -> Column:
    """Negative where the two are apart."""
    return F.least(a[2], b[2]) - F.greatest(a[0], b[0])


def common_area(a: Box, b: Box) -> Column:
    tall = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), common_width(a, b)) * F.greatest(F.lit(0.0), tall)


def share_inside(a: Box, b: Box) -> Column:
    """The part of a's area that lies in b; 0 for an empty a."""
    return F.when(area(a) > 0, common_area(a, b) / area(a)).otherwise(F.lit(0.0))


def meets(a: Box, b: Box) -> Column:
    return (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))


def close(a: Box, b: Box, slack: float) -> Column:
    return (a[2] + slack >= b[0]) & (b[2] + slack >= a[0]) & (a[3] + slack >= b[1]) & (b[3] + slack >= a[1])


def union_of(a: Box, b: Box) -> Box:
    return F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3])


def clipped(b: Box, w: Column, h: Column) -> Box:
    return F.greatest(b[0], F.lit(0.0)), F.greatest(b[1], F.lit(0.0)), F.least(b[2], w), F.least(b[3], h)
