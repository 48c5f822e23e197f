"""Layout trees by recursive cuts along white space.

Only boxes go to Python, a page's as four arrays; each page comes back as one
array of nodes in pre-order. All else about nodes is array functions of the page's
row, so building trees shuffles nothing. The step itself is also written as
expressions (``operators.intervals``); tests hold both against each other.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import geometry as g
from pagegrain.operators import intervals
from pagegrain.operators.atoms import ATOM_FIELDS, PAGE
from pagegrain.operators.intervals import BALANCE_WEIGHT, GAP_WEIGHT, MIN_GAP
from pagegrain.runtime import materialize, unnest

#: Levels that may be cut, the share of a box its region must hold, and the least extent of a region.
DEEPEST_CUT, HELD_SHARE, MIN_EXTENT = 12, 0.8, 1.0
#: Distances of middles, in parts of the page, that begin a new zone.
ZONE_GAP_X, ZONE_GAP_Y = 0.08, 0.07

ZONES = "struct<x_zone:int,x_zone_count:int,y_zone:int,y_zone_count:int>"
NODE = f"struct<path:string,parent_path:string,depth:int,ordinal:int,n_siblings:int,parent_layout:string,parent_fell_back:boolean,layout:string,atom_no:int,bbox:{g.BOX}>"


class PageBoxes:
    """The boxes of one page, side by side, in reading order.

    Pages hold few boxes, so plain lists are faster here than arrays; a cut takes
    sorting, not a look at every box for every gap, so large pages are no burden.
    """

    def __init__(self, sides: list[list[float]]):
        self.low, self.high = sides[:2], sides[2:]  # x, y
        self.middle = [[(a + b) / 2.0 for a, b in zip(self.low[k], self.high[k], strict=True)] for k in (0, 1)]
        self.area = [max(0.0, x1 - x0) * max(0.0, y1 - y0) for x0, y0, x1, y1 in zip(*sides, strict=True)]

    def best_cut(self, members: list[int], region: list[float]) -> tuple[int, float, float] | None:
        """Axis (0: left and right), begin and end of the best cut of a region, if there is one."""
        best: tuple[float, int, float, float] | None = None
        for axis, least in ((0, MIN_GAP["vertical"]), (1, MIN_GAP["horizontal"])):
            begin, end = region[axis], region[axis + 2]
            extent = max(0.0, end - begin)
            if extent <= 0:
                continue
            low, high = self.low[axis], self.high[axis]
            spans = [(s, e) for i in members if (e := min(end, high[i])) > (s := max(begin, low[i]))]
            if not spans:
                continue
            spans.sort()
            spans.append((end, end))
            middles: list[float] = []
            reach = begin
            for s, e in spans:
                if s > reach and (s - reach) / extent >= least:
                    middles = middles or sorted(map(self.middle[axis].__getitem__, members))
                    first = bisect_right(middles, (reach + s) / 2.0)
                    second = len(middles) - first
                    if first and second:
                        score = (s - reach) / extent * GAP_WEIGHT + min(first, second) / max(first, second) * BALANCE_WEIGHT
                        if best is None or score > best[0]:
                            best = score, axis, reach, s
                reach = max(reach, e)
        return best[1:] if best else None

    def held(self, members: list[int], region: list[float]) -> list[int]:
        """Members of which the region holds enough."""
        (x0, y0), (x1, y1) = self.low, self.high
        left, top, right, bottom = region
        out = []
        for i in members:
            if x1[i] > left and x0[i] < right and y1[i] > top and y0[i] < bottom:
                common = max(0.0, min(x1[i], right) - max(x0[i], left)) * max(0.0, min(y1[i], bottom) - max(y0[i], top))
                if common / max(self.area[i], 1e-6) >= HELD_SHARE:
                    out.append(i)
        return out


def cut_page(rect: list[float], sides: list[list[float]]) -> list[dict]:
    """The nodes of a page's tree in pre-order; ``sides`` has the lists x0, y0, x1, y1, boxes in reading order.

    A region with a cut whose two sides hold boxes becomes a group of two; any
    other of several boxes a vertical group of them all, and one box is a leaf.
    ``parent_fell_back`` marks the members of a group made without a cut, however many.
    """
    boxes = PageBoxes(sides)
    nodes: list[dict] = []
    if not sides[0]:
        return nodes
    # region, members, path, depth, ordinal, siblings, layout of the parent, whether the parent has no cut
    todo: list[tuple] = [(rect, list(range(len(sides[0]))), "0000", 0, 0, 1, None, False)]
    while todo:
        region, members, path, depth, ordinal, siblings, above, fell_back = todo.pop()
        node = {"path": path, "parent_path": path[:-5], "depth": depth, "ordinal": ordinal, "n_siblings": siblings, "parent_layout": above, "parent_fell_back": fell_back, "layout": None, "atom_no": None}
        nodes.append(node)
        if len(members) == 1:
            node["atom_no"] = members[0]
            continue
        halves = _halves(boxes, members, region) if depth <= DEEPEST_CUT else None
        if halves:
            node["layout"], parts = halves
        else:
            node["layout"], parts = "vertical", [(region, [i]) for i in members]
        for k in range(len(parts) - 1, -1, -1):
            todo.append((*parts[k], f"{path}.{k:04d}", depth + 1, k, len(parts), node["layout"], halves is None))
    _hulls(nodes, sides)
    return nodes


def _halves(boxes: PageBoxes, members: list[int], region: list[float]) -> tuple[str, list] | None:
    cut = boxes.best_cut(members, region)
    if cut is None:
        return None
    axis, start, end = cut
    before, behind = list(region), list(region)
    before[axis + 2], behind[axis] = start, end
    parts = []
    for part in (before, behind):
        if part[axis + 2] - part[axis] > MIN_EXTENT and (inside := boxes.held(members, part)):
            parts.append((part, inside))
    return ("vertical" if axis else "horizontal", parts) if len(parts) == 2 else None


def _hulls(nodes: list[dict], sides: list[list[float]]) -> None:
    """Boxes of the leaves, and of each group around its own."""
    hull: dict[str, list[float]] = {}
    for node in reversed(nodes):  # children come after their parent
        if node["atom_no"] is not None:
            hull[node["path"]] = [side[node["atom_no"]] for side in sides]
        b = hull[node["path"]]
        node["bbox"] = dict(zip(g.SIDES, b, strict=True))
        if node["depth"]:
            p = hull.get(node["parent_path"])
            hull[node["parent_path"]] = list(b) if p is None else [min(p[0], b[0]), min(p[1], b[1]), max(p[2], b[2]), max(p[3], b[3])]


def _trees(pages: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for rects, x0, y0, x1, y1 in pages:
        out = []
        for rect, *sides in zip(rects, x0, y0, x1, y1, strict=True):
            out.append(cut_page(rect.tolist(), [side.tolist() for side in sides]))
        yield pd.Series(out, dtype=object)


def tree_nodes(rect: Column, boxes: Column) -> Column:
    """The nodes of a page (array of NODE) from its rect and the boxes of its atoms in reading order."""
    side = lambda s: F.transform(boxes, lambda b: b[s])
    trees = F.pandas_udf(_trees, f"array<{NODE}>").asNondeterministic()  # else the planner may run it twice
    return trees(F.array(*(rect[s] for s in g.SIDES)), *(side(s) for s in g.SIDES))


def tree_by_levels(pages: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path, parent_path, depth, layout, atom_no``: the nodes of pages with ``rect`` and ``bs`` (boxes in reading order), without Python.

    The same trees as ``tree_nodes`` gives, cut level by level over all pages by the
    expressions of ``operators.intervals``: one stored table and one job a level, of
    which there are as many as the deepest tree has. For pages of boxes by the thousand
    it spreads a page's regions over tasks; for usual ones ``tree_nodes`` is faster, being one pass.
    """
    member = F.transform("bs", lambda b, i: F.struct(i.alias("no"), b.alias("b")))
    rows = pages.where(F.size("bs") > 0).select(*keys, F.lit("0000").alias("path"), F.lit(0).alias("depth"), F.col("rect").alias("r"), member.alias("ms"))
    levels = []
    while not levels or not levels[-1].where(F.size("kids") > 0).isEmpty():
        if levels:
            rows = unnest(levels[-1].where(F.size("kids") > 0), [*keys, "path", "depth"], "kids", "at", "k")
            rows = rows.select(*keys, F.concat("path", F.lit("."), F.lpad(F.col("at").cast("string"), 4, "0")).alias("path"), (F.col("depth") + 1).alias("depth"), "k.r", "k.ms")
        levels.append(materialize(_cut_level(rows, keys), "tree-level"))
    nodes = reduce(DataFrame.unionByName, levels)
    return nodes.select(*keys, "path", F.expr("left(path, greatest(length(path) - 5, 0))").alias("parent_path"), "depth", "layout", F.when(F.size("ms") == 1, F.get(F.col("ms"), F.lit(0))["no"]).alias("atom_no"))


def _cut_level(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``layout`` and ``kids`` (region and members of each child) to regions with members; one alone is a leaf."""
    rows = rows.withColumn("__bs", F.transform("ms", lambda m: m["b"]))
    for axis in ("vertical", "horizontal"):
        low, high = (F.col("r")[side] for side in intervals.ALONG[axis])
        rows = rows.withColumn("__merged", intervals.occupied(F.col("__bs"), low, high, axis)).withColumn("__free", intervals.gaps(F.col("__merged"), low, high))
        rows = rows.withColumn(f"__{axis}", intervals.scored(F.col("__bs"), F.col("__free"), high - low, axis))
    rows = rows.withColumn("__c", intervals.best_cut(F.col("__vertical"), F.col("__horizontal")))
    r, c = F.col("r"), F.col("__c")
    across = c["axis"] == "vertical"
    p = g.box(r["x0"], r["y0"], F.when(across, c["s"]).otherwise(r["x1"]), F.when(across, r["y1"]).otherwise(c["s"]))
    q = g.box(F.when(across, c["e"]).otherwise(r["x0"]), F.when(across, r["y0"]).otherwise(c["e"]), r["x1"], r["y1"])
    rows = rows.withColumn("__p", p).withColumn("__q", q)
    inside = lambda region: F.filter("ms", lambda m: intervals.in_region(m["b"], F.col(region), HELD_SHARE))
    rows = rows.withColumn("__mp", inside("__p")).withColumn("__mq", inside("__q"))
    extent = lambda region: F.when(across, F.col(region)["x1"] - F.col(region)["x0"]).otherwise(F.col(region)["y1"] - F.col(region)["y0"])
    valid = F.coalesce((F.col("depth") <= DEEPEST_CUT) & (extent("__p") > MIN_EXTENT) & (extent("__q") > MIN_EXTENT) & (F.size("__mp") > 0) & (F.size("__mq") > 0), F.lit(False))
    rows = rows.withColumn("__valid", valid & c.isNotNull())
    child = lambda region, members: F.struct(region.alias("r"), members.alias("ms"))
    halves = F.array(child(F.col("__p"), F.col("__mp")), child(F.col("__q"), F.col("__mq")))
    kids = F.when(F.col("__valid"), halves).otherwise(F.transform("ms", lambda m: child(r, F.array(m))))
    several = F.size("ms") > 1
    layout = F.when(several, F.when(F.col("__valid") & across, F.lit("horizontal")).otherwise(F.lit("vertical")))
    return rows.select(*keys, "path", "depth", "ms", layout.alias("layout"), F.when(several, kids).alias("kids"))


def relative_position(ordinal: Column, count: Column, layout: Column) -> Column:
    """A node's place among its siblings; null at the top, where there is no layout."""
    across = F.when(count <= 1, "CENTER").when(ordinal == 0, "LEFT").when(ordinal == count - 1, "RIGHT").otherwise("CENTER")
    down = F.when(count <= 1, "MIDDLE").when(ordinal == 0, "TOP").when(ordinal == count - 1, "BOTTOM").otherwise("MIDDLE")
    return F.when(layout == "horizontal", across).when(layout.isNotNull(), down)


def zone_breaks(values: Column, gap: float) -> Column:
    """Values at which a new zone begins: those at least ``gap`` above the one before."""
    ordered = F.array_sort(values)
    pairs = F.zip_with(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda v, u: F.struct(v.alias("v"), (v - u >= F.lit(gap)).alias("new")))
    return F.transform(F.filter(pairs, lambda p: p["new"]), lambda p: p["v"])


def zone(value: Column, breaks: Column) -> Column:
    """The zone of a value, from 0; one left of the page in the first zone counts as in the last."""
    at = F.size(F.filter(breaks, lambda b: b <= value))
    return F.when((at == 0) & (value < 0), F.size(breaks)).otherwise(at)


def dynamic_position(x: Column, y: Column, x_breaks: Column, y_breaks: Column) -> Column:
    return F.struct(zone(x, x_breaks).alias("x_zone"), (F.size(x_breaks) + 1).alias("x_zone_count"), zone(y, y_breaks).alias("y_zone"), (F.size(y_breaks) + 1).alias("y_zone_count"))


def flat_nodes(pages: DataFrame) -> DataFrame:
    """Adds ``nodes`` without groups: the atoms in reading order, each at the top."""
    paths = F.transform("atoms", lambda a, i: F.struct(
        F.lpad(i.cast("string"), 4, "0").alias("path"), F.lit("").alias("parent_path"), F.lit(0).alias("depth"), i.alias("ordinal"), F.size("atoms").alias("n_siblings"),
        F.lit(None).cast("string").alias("parent_layout"), F.lit(False).alias("parent_fell_back"), F.lit(None).cast("string").alias("layout"), i.alias("atom_no"), a["bbox"].alias("bbox")))
    return pages.withColumn("nodes", paths)


def grouped_nodes(pages: DataFrame) -> DataFrame:
    """Adds ``nodes`` of the layout tree. Boxes outside the page may be lost by a cut, as may those without area."""
    return pages.withColumn("nodes", tree_nodes(F.col("rect"), F.transform("atoms", lambda a: a["bbox"])))


def chunk_fields(n: Column, a: Column, index: Column, page: dict[str, Column], grouped: bool) -> list[Column]:
    """The columns of a chunk from its node, its atom (null for a group), its place in pre-order and its page's columns."""
    w, h, bbox = page["width"], page["height"], n["bbox"]
    middle = g.normalized_position(bbox, w, h)
    dynamic = dynamic_position(middle["x"], middle["y"], page["x_breaks"], page["y_breaks"]) if grouped else F.lit(None).cast(ZONES)
    debug = F.when(a.isNotNull(), F.struct(*(a[c].alias(c) for c in ATOM_FIELDS[6:]), F.lit(None).cast("string").alias("dropped_reason")))
    return [
        *(n[c].alias(c) for c in ("path", "parent_path", "depth", "ordinal")), index.alias("chunk_index"), F.coalesce(a["type"], F.lit("group")).alias("type"), n["layout"].alias("layout"), bbox.alias("bbox"),
        *(a[c].alias(c) for c in ("content", "content_raw", "content_tagged", "mime_type")), middle.alias("position_normalized"), g.normalized_size(bbox, w, h).alias("size_normalized"),
        g.coarse_position(bbox, w, h).alias("absolute_position_coarse"), dynamic.alias("absolute_position_dynamic"), relative_position(n["ordinal"], n["n_siblings"], n["parent_layout"]).alias("relative_position"), debug.alias("debug"),
    ]


def _paired(pages: DataFrame) -> DataFrame:
    """Adds ``__pairs`` (each node with its atom) and the zone breaks of the page."""
    middles = F.transform("nodes", lambda n: g.normalized_position(n["bbox"], F.col("width"), F.col("height")))
    pages = pages.withColumn("__m", middles)
    pages = pages.withColumn("x_breaks", zone_breaks(F.transform("__m", lambda m: m["x"]), ZONE_GAP_X)).withColumn("y_breaks", zone_breaks(F.transform("__m", lambda m: m["y"]), ZONE_GAP_Y))
    return pages.drop("__m").withColumn("__pairs", F.transform("nodes", lambda n: F.struct(n.alias("n"), F.get(F.col("atoms"), n["atom_no"]).alias("a"))))


_PAGE_COLUMNS = ["width", "height", "x_breaks", "y_breaks"]


def chunk_rows(pages: DataFrame, grouped: bool = True) -> DataFrame:
    """The node table of pages with ``nodes`` and ``atoms``: one row for each group and leaf.

    ``chunk_index`` is the place in pre-order. Without grouping no zones and no
    relative places are given.
    """
    rows = unnest(_paired(pages), [*PAGE, *_PAGE_COLUMNS], "__pairs", "chunk_index", "p").select(*PAGE, *_PAGE_COLUMNS, "chunk_index", "p.n", "p.a")
    return rows.select(*PAGE, *chunk_fields(F.col("n"), F.col("a"), F.col("chunk_index"), {c: F.col(c) for c in _PAGE_COLUMNS}, grouped))


def with_chunks(pages: DataFrame, grouped: bool = True) -> DataFrame:
    """Pages with their chunks in one array in pre-order, in place of ``nodes``; ``atoms`` stay for counting."""
    page = {c: F.col(c) for c in _PAGE_COLUMNS}
    chunks = F.transform("__pairs", lambda p, i: F.struct(*chunk_fields(p["n"], p["a"], i, page, grouped)))
    return _paired(pages).withColumn("chunks", chunks).select(*PAGE, "width", "height", "atoms", "chunks")
