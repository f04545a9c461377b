"""Boxes (left, top, right, bottom; points from the top left) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(name: str) -> tuple[Column, Column, Column, Column]:
    """The columns of a box struct with fields l, t, r, b."""
    return tuple(F.col(f"{name}.{k}") for k in "ltrb")


def area(a) -> Column:
    l, t, r, b = a
    return F.greatest(r - l, F.lit(0.0)) * F.greatest(b - t, F.lit(0.0))


def overlap_area(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_ratio(a, b) -> Column:
    """The share of a that b covers."""
    return F.when(area(a) > 0, overlap_area(a, b) / area(a)).otherwise(0.0)


def iou(a, b) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def from_pixels(value: Column, scale: float) -> Column:
    return value / scale if scale > 0 else value


def quad_box(points: Column) -> Column:
    """The box around an array of (x, y)."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("l"), F.array_min(y).alias("t"), F.array_max(x).alias("r"), F.array_max(y).alias("b"))


def top_left(l: Column, t: Column, r: Column, b: Column, page_height: Column) -> Column:
    """A box with its origin at the bottom left as one from the top left, to a tenth of a point."""
    one = lambda c: F.bround(c, 1)
    return F.struct(one(l).alias("l"), one(page_height - t).alias("t"), one(r).alias("r"), one(page_height - b).alias("b"))


def line_of(top: Column, tolerance: float) -> Column:
    """The number of the text line that a height lies on."""
    return F.bround(top / tolerance, 0)
