"""Box geometry as column expressions. A box is a struct of doubles x0, y0, x1, y1.

A null box gives null; inverted boxes have width and height 0. All of it stays in
generated code: no Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
#: The parts of the page at which left ends and right begins; the same for top and bottom.
FIRST_THIRD, SECOND_THIRD = 0.33, 0.66


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), SIDES, strict=True)))


def complete(b: Column) -> Column:
    """Whether a box has all its sides; false for a null box."""
    return b["x0"].isNotNull() & b["y0"].isNotNull() & b["x1"].isNotNull() & b["y1"].isNotNull()


def width(b: Column) -> Column:
    return F.when(b["x1"] > b["x0"], b["x1"] - b["x0"]).when(b.isNotNull(), F.lit(0.0))


def height(b: Column) -> Column:
    return F.when(b["y1"] > b["y0"], b["y1"] - b["y0"]).when(b.isNotNull(), F.lit(0.0))


def area(b: Column) -> Column:
    return width(b) * height(b)


def cx(b: Column) -> Column:
    """Middle of the sides as they are, inverted or not."""
    return (b["x0"] + b["x1"]) / 2.0


def cy(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2.0


def union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def union_agg(b: Column) -> Column:
    """The box around all boxes of a group; null for none."""
    hull = F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))
    return F.when(F.count(b) > 0, hull)


def intersects(a: Column, b: Column) -> Column:
    """Boxes that only touch do not."""
    return (a["x1"] > b["x0"]) & (a["x0"] < b["x1"]) & (a["y1"] > b["y0"]) & (a["y0"] < b["y1"])


def intersection(a: Column, b: Column) -> Column:
    common = box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))
    return F.when(intersects(a, b), common)


def intersection_area(a: Column, b: Column) -> Column:
    """0 for boxes that don't intersect."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    zero = F.lit(0.0)
    return F.when(intersects(a, b), F.greatest(zero, w) * F.greatest(zero, h)).otherwise(zero)


def contains(a: Column, b: Column, tolerance: float = 0.0) -> Column:
    t = F.lit(float(tolerance))
    return (b["x0"] >= a["x0"] - t) & (b["y0"] >= a["y0"] - t) & (b["x1"] <= a["x1"] + t) & (b["y1"] <= a["y1"] + t)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of ``a`` that lies in ``b``; 0 for a box without area."""
    return F.when(area(a) > 0, intersection_area(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    common = intersection_area(a, b)
    total = area(a) + area(b) - common
    return F.when(total > 0, common / total).otherwise(F.lit(0.0))


def coarse_position(b: Column, page_width: Column, page_height: Column) -> Column:
    """``TOP_LEFT`` to ``BOTTOM_RIGHT`` by the middle of the box."""
    across = F.when(cx(b) < page_width * F.lit(FIRST_THIRD), "LEFT").when(cx(b) < page_width * F.lit(SECOND_THIRD), "CENTER").otherwise("RIGHT")
    down = F.when(cy(b) < page_height * F.lit(FIRST_THIRD), "TOP").when(cy(b) < page_height * F.lit(SECOND_THIRD), "MIDDLE").otherwise("BOTTOM")
    return F.concat(down, F.lit("_"), across)


def _per(value: Column, whole: Column) -> Column:
    return F.when(whole > 0, value / whole).otherwise(F.lit(0.0))


def normalized_position(b: Column, page_width: Column, page_height: Column) -> Column:
    return F.struct(_per(cx(b), page_width).alias("x"), _per(cy(b), page_height).alias("y"))


def normalized_size(b: Column, page_width: Column, page_height: Column) -> Column:
    return F.struct(_per(width(b), page_width).alias("w"), _per(height(b), page_height).alias("h"))


def page_area_ratio(b: Column, rect: Column) -> Column:
    """Area in parts of the page's, which counts as 1 at least; over 1 if the box passes the page."""
    return area(b) / F.greatest(F.lit(1.0), area(rect))


def scale(b: Column, zoom: float) -> Column:
    z = F.lit(float(zoom))
    return box(*(b[s] * z for s in SIDES))


def distance_squared(px: Column, py: Column, b: Column) -> Column:
    """From a point to the nearest point of a box."""
    dx = px - F.least(F.greatest(px, b["x0"]), b["x1"])
    dy = py - F.least(F.greatest(py, b["y0"]), b["y1"])
    return dx * dx + dy * dy
