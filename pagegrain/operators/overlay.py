"""Overlays of a page's chunks as SVG or PNG.

Labels are placed one after another, each where it hides least, which a page's
labels before it decide; this runs on a page's arrays in Python. Candidates,
texts and the SVG itself are expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import geometry as g
from pagegrain.functions import text as t
from pagegrain.functions.raster import Picture, colour
from pagegrain.operators.atoms import PAGE
from pagegrain.runtime import unnest

#: Label size without font metrics, padding, margins, and the costs of covering labels and boxes.
LABEL_MIN_WIDTH, LABEL_PER_SIGN, LABEL_HEIGHT = 20, 7, 14
PAD_X, PAD_Y = 4, 2
MIN_MARGIN, MARGIN_PER_ZOOM, GROUP_MARGIN = 6.0, 4.0, 1.8
COST_LABEL, COST_BOX, COST_DISTANCE = 1000.0, 300.0, 0.001

PLACE = f"array<struct<rect:{g.BOX},ax:double,ay:double>>"


def label_width(label: Column) -> Column:
    return F.greatest(F.lit(LABEL_MIN_WIDTH), F.length(label) * LABEL_PER_SIGN) + 2 * PAD_X


def candidates(b: Column, width: Column, is_group: Column, image_width: Column, image_height: Column, zoom: float = 2.0) -> Column:
    """Eight places for a label of this width about a scaled box, each with its anchor, moved into the image."""
    height = F.lit(float(LABEL_HEIGHT + 2 * PAD_Y))
    margin = F.lit(max(MIN_MARGIN, MARGIN_PER_ZOOM * zoom)) * F.when(is_group, F.lit(GROUP_MARGIN)).otherwise(F.lit(1.0))
    x0, y0, x1, y1 = (b[s] for s in g.SIDES)
    mx, my, w = g.cx(b), g.cy(b), width.cast("double")
    above, below = y0 - height - margin, y1 + margin
    middle = my - height / 2.0
    # fixed values: the eight places, in the order in which they are tried
    corners = [(x0, above, x0, y0), (x1 - w, above, x1, y0), (x1 + margin, middle, x1, my), (x0 - margin - w, middle, x0, my), (x0, below, x0, y1), (x1 - w, below, x1, y1), (mx - w / 2.0, above, mx, y0), (mx - w / 2.0, below, mx, y1)]
    places = []
    for left, top, ax, ay in corners:
        dx = F.when(left < 0, -left).when(left + w > image_width, image_width - (left + w)).otherwise(F.lit(0.0))
        dy = F.when(top < 0, -top).when(top + height > image_height, image_height - (top + height)).otherwise(F.lit(0.0))
        places.append(F.struct(g.box(left + dx, top + dy, left + w + dx, top + height + dy).alias("rect"), ax.alias("ax"), ay.alias("ay")))
    return F.array(*places)


def _hits(rects: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of ``others`` each of ``rects`` overlaps."""
    if not len(others):
        return np.zeros(len(rects), dtype=int)
    a, b = rects[:, None], others[None]
    return ((a[..., 2] > b[..., 0]) & (a[..., 0] < b[..., 2]) & (a[..., 3] > b[..., 1]) & (a[..., 1] < b[..., 3])).sum(axis=1)


def place_labels(boxes: np.ndarray, options: np.ndarray) -> list[int]:
    """For each box in drawing order the number of the chosen of its eight places.

    The first that overlaps neither a label nor a box; else the first that overlaps
    no label; else the cheapest, the first of equals.
    """
    taken: list[np.ndarray] = []
    chosen = []
    for box, rects in zip(boxes, options, strict=True):
        on_labels, on_boxes = _hits(rects, np.array(taken)), _hits(rects, boxes)
        free = np.flatnonzero((on_labels == 0) & (on_boxes == 0))
        if not len(free):
            free = np.flatnonzero(on_labels == 0)
        if len(free):
            k = int(free[0])
        else:
            middle = np.array([(box[0] + box[2]) / 2.0, (box[1] + box[3]) / 2.0])
            away = middle - np.minimum(np.maximum(middle, rects[:, :2]), rects[:, 2:])
            k = int((on_labels * COST_LABEL + on_boxes * COST_BOX + (away**2).sum(axis=1) * COST_DISTANCE).argmin())
        taken.append(rects[k])
        chosen.append(k)
    return chosen


def _placed(pages: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for boxes, options in pages:
        out = []
        for b, o in zip(boxes, options, strict=True):
            flat = np.asarray(b, dtype=float).reshape(-1, 4)
            out.append(place_labels(flat, np.asarray(o, dtype=float).reshape(-1, 8, 4)))
        yield pd.Series(out, dtype=object)


def _drawn(c: Callable[[str], Column], zoom: float) -> Column:
    """What is drawn of a chunk: its scaled box, label, colour, line width and kind."""
    width = F.greatest(F.lit(1), F.lit(max(2, int(zoom))) - c("depth"))
    label = t.chunk_label(c("type"), c("layout"), c("absolute_position_coarse"), c("absolute_position_dynamic"), c("relative_position"))
    return F.struct(c("path").alias("path"), g.scale(c("bbox"), zoom).alias("box"), label.alias("label"), t.chunk_colour(c("type"), c("layout")).alias("colour"), width.alias("line_width"), c("type").alias("type"))


def _is_drawn(c: Callable[[str], Column], recurse_groups: bool) -> Column:
    return g.complete(c("bbox")) & (F.lit(True) if recurse_groups else c("depth") == 0)


def render_svg(chunks: DataFrame, pages: DataFrame, zoom: float = 2.0, show_labels: bool = True, recurse_groups: bool = True) -> DataFrame:
    """``doc_id, page_number, svg``: every page of ``pages`` with the boxes and labels of its chunks.

    ``pages`` has width and height. A page without chunks is an empty drawing.
    Chunks without a whole box aren't drawn; without ``recurse_groups`` only those at the
    top are. This is for stored tables and shuffles them by page; ``svg_of_pages``
    needs no shuffle.
    """
    drawn = chunks.where(_is_drawn(F.col, recurse_groups)).select(*PAGE, _drawn(F.col, zoom).alias("c"))
    grouped = drawn.groupBy(*PAGE).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    both = pages.select(*PAGE, "width", "height").join(grouped, PAGE, "left")
    return _svg(both.withColumn("cs", F.coalesce("cs", F.array().cast(grouped.schema["cs"].dataType))), zoom, show_labels)


def svg_of_pages(pages: DataFrame, zoom: float = 2.0, show_labels: bool = True, recurse_groups: bool = True) -> DataFrame:
    """As ``render_svg``, from pages with ``chunks`` (``layout.with_chunks``); nothing is shuffled."""
    return _svg(_drawn_pages(pages, zoom, recurse_groups), zoom, show_labels)


def png_of_pages(pages: DataFrame, zoom: float = 2.0, show_labels: bool = True, recurse_groups: bool = True) -> DataFrame:
    """``doc_id, page_number, png``: as ``svg_of_pages``, drawn on a white page; nothing is shuffled.

    The page itself isn't in the picture, as raw pages don't hold its drawing.
    """
    both = _with_places(_drawn_pages(pages, zoom, recurse_groups), zoom)
    part = lambda name: F.transform("cs", lambda c: c[name])
    place = F.zip_with("places", "chosen", lambda o, k: F.get(o, k))
    rects = F.flatten(F.transform(place, lambda p: F.array(*(p["rect"][s] for s in g.SIDES), p["ax"], p["ay"])))
    boxes = F.flatten(F.transform("cs", lambda c: F.array(*(c["box"][s] for s in g.SIDES))))
    labels = part("label") if show_labels else F.array().cast("array<string>")
    picture = F.pandas_udf(_pictures, "binary").asNondeterministic()
    return both.select(*PAGE, picture("w", "h", boxes, part("colour"), part("line_width"), labels, rects).alias("png"))


def placed_labels(pages: DataFrame, zoom: float = 2.0, recurse_groups: bool = True) -> DataFrame:
    """``doc_id, page_number, at, place_no, rect, ax, ay``: where the label of each drawn chunk goes, and its anchor."""
    both = _with_places(_drawn_pages(pages, zoom, recurse_groups), zoom)
    chosen = F.zip_with("places", "chosen", lambda o, k: F.struct(k.alias("place_no"), F.get(o, k).alias("p")))
    rows = unnest(both, PAGE, chosen, "at", "c")
    return rows.select(*PAGE, "at", "c.place_no", "c.p.rect", "c.p.ax", "c.p.ay")


def _pictures(pages: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for batch in pages:
        out = []
        for w, h, boxes, colours, widths, labels, rects in zip(*batch, strict=True):
            picture = Picture(w, h)
            places = np.asarray(rects, dtype=float).reshape(-1, 6)
            for k, (box, shade, width) in enumerate(zip(np.asarray(boxes, dtype=float).reshape(-1, 4), colours, widths, strict=True)):
                picture.frame(*box, colour(shade), int(width))
                if len(labels):
                    x0, y0, x1, y1, ax, ay = places[k]
                    picture.fill(x0, y0, x1, y1, colour(shade))
                    picture.write(x0 + PAD_X, (y0 + y1) / 2 - 3.5, labels[k] or "", (255, 255, 255))
                    picture.line(ax, ay, (x0 + x1) / 2, (y0 + y1) / 2, colour(t.COLOURS["connector"]))
            out.append(picture.png())
        yield pd.Series(out, dtype=object)


def _drawn_pages(pages: DataFrame, zoom: float, recurse_groups: bool) -> DataFrame:
    drawn = F.transform(F.filter("chunks", lambda c: _is_drawn(c.__getitem__, recurse_groups)), lambda c: _drawn(c.__getitem__, zoom))
    return pages.select(*PAGE, "width", "height", drawn.alias("cs"))


def _with_places(both: DataFrame, zoom: float) -> DataFrame:
    """Adds each chunk's eight places and the number of the chosen one."""
    if zoom <= 0:
        raise ValueError("zoom must be above 0")
    both = both.select(*PAGE, (F.col("width") * zoom).alias("w"), (F.col("height") * zoom).alias("h"), "cs")
    numbers = lambda b: F.array(*(b[s] for s in g.SIDES))
    both = both.withColumn("places", F.transform("cs", lambda c: candidates(c["box"], label_width(c["label"]), c["type"] == "group", F.col("w"), F.col("h"), zoom)))
    both = both.withColumn("chosen", F.pandas_udf(_placed, "array<int>").asNondeterministic()(F.flatten(F.transform("cs", lambda c: numbers(c["box"]))), F.flatten(F.transform("places", lambda o: F.flatten(F.transform(o, lambda p: numbers(p["rect"])))))))
    return both


def _svg(both: DataFrame, zoom: float, show_labels: bool) -> DataFrame:
    both = _with_places(both, zoom)
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))

    def element(c: Column, i: Column) -> Column:
        b = c["box"]
        frame = text('<rect x="', b["x0"], '" y="', b["y0"], '" width="', g.width(b), '" height="', g.height(b), '" fill="none" stroke="', c["colour"], '" stroke-width="', c["line_width"], '"/>')
        if not show_labels:
            return frame
        place = F.get(F.get(F.col("places"), i), F.get(F.col("chosen"), i))
        r = place["rect"]
        back = text('<rect x="', r["x0"], '" y="', r["y0"], '" width="', g.width(r), '" height="', g.height(r), '" fill="', c["colour"], '"/>')
        words = text('<text x="', r["x0"] + PAD_X, '" y="', r["y1"] - PAD_Y, '" fill="#ffffff" font-size="', str(max(12, int(6 * zoom))), '">', t.html_escape(c["label"]), "</text>")
        line = text('<line x1="', place["ax"], '" y1="', place["ay"], '" x2="', g.cx(r), '" y2="', g.cy(r), '" stroke="', t.COLOURS["connector"], '" stroke-width="1"/>')
        return F.concat(frame, back, words, line)

    head = text('<svg xmlns="http://www.w3.org/2000/svg" width="', F.col("w"), '" height="', F.col("h"), '">')
    return both.select(*PAGE, F.concat(head, F.array_join(F.transform("cs", element), ""), F.lit("</svg>")).alias("svg"))
