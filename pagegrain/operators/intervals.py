"""Occupied intervals, gaps and candidate cuts of a set of boxes on one axis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrain.functions import geometry as g

#: The least gap that may be cut, in parts of the region's extent; and the weights of a cut's score.
MIN_GAP = {"vertical": 0.04, "horizontal": 0.03}
GAP_WEIGHT, BALANCE_WEIGHT = 0.7, 0.3
#: The axis across which a cut goes, and the sides of a box on it.
ALONG = {"vertical": ("x0", "x1"), "horizontal": ("y0", "y1")}

INTERVALS = "array<struct<s:double,e:double>>"


def occupied(boxes: Column, low: Column, high: Column, axis: str) -> Column:
    """Merged intervals of the boxes between ``low`` and ``high``; those that touch merge."""
    a, b = ALONG[axis]
    cut = F.transform(boxes, lambda x: F.struct(F.greatest(low, x[a]).alias("s"), F.least(high, x[b]).alias("e")))
    ordered = F.array_sort(F.filter(cut, lambda i: i["e"] > i["s"]))

    def merge(done: Column, i: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], i["e"]).alias("e")))
        return F.when(F.size(done) == 0, F.array(i)).when(i["s"] <= last["e"], F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), wider)).otherwise(F.concat(done, F.array(i)))

    return F.aggregate(ordered, F.array().cast(INTERVALS), merge)


def gaps(merged: Column, low: Column, high: Column) -> Column:
    """What the merged intervals leave free, both margins included; nothing if there are none."""
    starts = F.concat(F.array(low), F.transform(merged, lambda i: i["e"]))
    ends = F.concat(F.transform(merged, lambda i: i["s"]), F.array(high))
    free = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    return F.when(F.size(merged) > 0, F.filter(free, lambda i: i["e"] > i["s"])).otherwise(F.array().cast(INTERVALS))


def scored(boxes: Column, free: Column, extent: Column, axis: str) -> Column:
    """``s, e, first, second, score`` of each gap that is wide enough and has boxes on both sides.

    A box is before the cut if its middle is at or before the gap's.
    """
    middle = g.cx if axis == "vertical" else g.cy

    def judge(i: Column) -> Column:
        first = F.size(F.filter(boxes, lambda x: middle(x) <= (i["s"] + i["e"]) / 2.0))
        return F.struct(i["s"].alias("s"), i["e"].alias("e"), first.alias("first"), (F.size(boxes) - first).alias("second"))

    def score(i: Column) -> Column:
        balance = F.least(i["first"], i["second"]).cast("double") / F.greatest(i["first"], i["second"]).cast("double")
        value = (i["e"] - i["s"]) / extent * F.lit(GAP_WEIGHT) + balance * F.lit(BALANCE_WEIGHT)
        return F.struct(i["s"].alias("s"), i["e"].alias("e"), i["first"].alias("first"), i["second"].alias("second"), value.alias("score"))

    wide = F.filter(free, lambda i: (extent > 0) & ((i["e"] - i["s"]) / F.when(extent > 0, extent).otherwise(1.0) >= F.lit(MIN_GAP[axis])))
    return F.transform(F.filter(F.transform(wide, judge), lambda i: (i["first"] > 0) & (i["second"] > 0)), score)


def best_cut(vertical: Column, horizontal: Column) -> Column:
    """The cut of the highest score; of equal ones a vertical, of those the earliest. Null without any."""
    rank = lambda axis, order: lambda i: F.struct((-i["score"]).alias("k"), F.lit(order).alias("order"), i["s"].alias("s"), i["e"].alias("e"), F.lit(axis).alias("axis"), i["score"].alias("score"))
    return F.array_min(F.concat(F.transform(vertical, rank("vertical", 0)), F.transform(horizontal, rank("horizontal", 1))))


def in_region(b: Column, region: Column, share: float = 0.8) -> Column:
    """Whether so much of a box lies in the region; never for boxes without area."""
    return g.intersection_area(b, region) / F.greatest(g.area(b), F.lit(1e-6)) >= F.lit(share)
