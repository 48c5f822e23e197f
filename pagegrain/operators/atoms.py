"""Text, image and table atoms of raw pages.

A page is one row and all steps on it are array functions of that row: nothing is
shuffled, and Python sees no row. Greedy steps are folds over a sorted array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.functions import geometry as g
from pagegrain.functions import text as t
from pagegrain.runtime import once, unnest

PAGE = ["doc_id", "page_number"]
#: Fixed values of the extraction.
TABLE_PAD = 2.0
TABLE_SAME_IOU = 0.90
TEXT_IN_TABLE = 0.60
IMAGE_SAME_IOU, IMAGE_CONTAINED = 0.92, 0.98
BACKGROUND_AREA, BACKGROUND_EDGE = 0.90, 3.0
BACKGROUND_WITH_TEXT, BACKGROUND_COVERAGE = 0.65, 0.55


@dataclass(frozen=True)
class ParseOptions:
    """What pages are parsed to: payloads of tables and images, images behind the text, groups or a flat list."""

    include_table_base64: bool = True
    include_image_base64: bool = True
    skip_background_images: bool = True
    enable_grouping: bool = True


def distinct_pages(raw: DataFrame) -> DataFrame:
    """Each page once, repeated deliveries left out; which of unequal ones stays isn't defined.

    Pages, with their payloads, aren't shuffled (``runtime.once``).
    """
    return once(raw, PAGE)


def _array(column: str) -> Column:
    return F.coalesce(F.col(column), F.array())


def keep_first(ordered: str, same) -> Column:
    """Of the array ``ordered``, those that aren't ``same`` as one kept before."""
    column = F.col(ordered)
    none = F.filter(column, lambda _: F.lit(False))
    return F.aggregate(column, none, lambda kept, x: F.when(F.exists(kept, lambda k: same(x, k)), kept).otherwise(F.concat(kept, F.array(x))))


def pad_table(bbox: Column) -> Column:
    """Two points more on each side; only the left and the top stop at the page."""
    p = F.lit(TABLE_PAD)
    return g.box(F.greatest(F.lit(0.0), bbox["x0"] - p), F.greatest(F.lit(0.0), bbox["y0"] - p), bbox["x1"] + p, bbox["y1"] + p)


def padded_tables(raw: DataFrame, include_table_base64: bool = True) -> DataFrame:
    """Adds ``table_list``: padded tables with payload, by falling area; tables without box are left out."""
    content = (lambda x: t.base64_plain(x["png"])) if include_table_base64 else (lambda x: F.lit(None).cast("string"))
    found = F.filter(_array("tables"), lambda x: g.complete(x["bbox"]))
    padded = F.transform(found, lambda x, i: F.struct(pad_table(x["bbox"]).alias("bbox"), i.alias("no"), content(x).alias("content")))
    keyed = F.transform(F.col("__padded"), lambda x: F.struct((-g.area(x["bbox"])).alias("k"), x["no"].alias("no"), x["bbox"].alias("bbox"), x["content"].alias("content")))
    return raw.withColumn("__padded", padded).withColumn("table_list", F.array_sort(keyed)).drop("__padded")


def same_table(a: Column, b: Column) -> Column:
    return g.iou(a["bbox"], b["bbox"]) >= F.lit(TABLE_SAME_IOU)


def same_image(a: Column, b: Column) -> Column:
    inside = (g.overlap_ratio(a["bbox"], b["bbox"]) >= F.lit(IMAGE_CONTAINED)) | (g.overlap_ratio(b["bbox"], a["bbox"]) >= F.lit(IMAGE_CONTAINED))
    return (a["signature"] == b["signature"]) & ((g.iou(a["bbox"], b["bbox"]) >= F.lit(IMAGE_SAME_IOU)) | inside)


def table_overlap(bbox: Column, tables: Column) -> Column:
    """The largest share of a box in one of the tables; 0 without tables."""
    return F.coalesce(F.array_max(F.transform(tables, lambda x: g.overlap_ratio(bbox, x["bbox"]))), F.lit(0.0))


def text_coverage(bbox: Column, texts: Column) -> Column:
    """Area of all intersections with text boxes over the box's own; overlapping texts count each."""
    covered = F.aggregate(texts, F.lit(0.0), lambda a, x: a + g.intersection_area(bbox, x))
    return F.when(g.area(bbox) > 0, covered / g.area(bbox)).otherwise(F.lit(0.0))


def is_background(bbox: Column, rect: Column, texts: Column) -> Column:
    ratio = g.page_area_ratio(bbox, rect)
    edges = F.lit(True)
    for side in g.SIDES:
        edges = edges & (F.abs(bbox[side] - rect[side]) <= F.lit(BACKGROUND_EDGE))
    return (ratio >= F.lit(BACKGROUND_AREA)) | edges | ((ratio >= F.lit(BACKGROUND_WITH_TEXT)) & (text_coverage(bbox, texts) >= F.lit(BACKGROUND_COVERAGE)))


def with_sizes(raw: DataFrame) -> DataFrame:
    return raw.withColumn("width", g.width(F.col("rect"))).withColumn("height", g.height(F.col("rect")))


def with_tables(raw: DataFrame, include_table_base64: bool = True) -> DataFrame:
    """Adds ``table_list``: padded tables, none the same as a larger one."""
    padded = padded_tables(raw, include_table_base64)
    return padded.withColumn("__kept", keep_first("table_list", same_table)).withColumn("table_list", F.col("__kept")).drop("__kept")


def with_text_boxes(raw: DataFrame) -> DataFrame:
    """Adds ``text_boxes``: those of all text blocks, also of blocks that give no atom."""
    texts = F.filter(_array("blocks"), lambda b: (b["type"] == 0) & g.complete(b["bbox"]))
    return raw.withColumn("text_boxes", F.transform(texts, lambda b: b["bbox"]))


def with_texts(pages: DataFrame) -> DataFrame:
    """Adds ``text_list``: text blocks outside tables whose text isn't empty. Needs ``table_list``, sizes."""
    placed = F.transform(_array("blocks"), lambda b, i: F.struct(i.alias("no"), b.alias("b")))
    outside = F.filter(placed, lambda x: (x["b"]["type"] == 0) & g.complete(x["b"]["bbox"]) & (table_overlap(x["b"]["bbox"], F.col("table_list")) < F.lit(TEXT_IN_TABLE)))
    raw = F.transform(F.col("__outside"), lambda x: F.struct(x["no"].alias("no"), x["b"].alias("b"), t.block_text(x["b"]).alias("raw")))
    clean = F.transform(F.col("__raw"), lambda x: F.struct(x["no"].alias("no"), x["b"].alias("b"), x["raw"].alias("raw"), t.normalize(x["raw"]).alias("clean")))
    texts = F.transform(
        F.filter(F.col("__clean"), lambda x: x["clean"] != ""),
        lambda x: F.struct(
            x["no"].alias("no"), x["b"]["bbox"].alias("bbox"), x["clean"].alias("content"), x["raw"].alias("content_raw"), t.tagged_text(x["b"], F.col("width"), F.col("height")).alias("content_tagged"),
            t.line_count(x["b"]).alias("line_count"), t.span_count(x["b"]).alias("span_count"),
        ),
    )
    return pages.withColumn("__outside", outside).withColumn("__raw", raw).withColumn("__clean", clean).withColumn("text_list", texts).drop("__outside", "__raw", "__clean")


def listed_images(pages: DataFrame, include_image_base64: bool = True, skip_background_images: bool = True) -> DataFrame:
    """Adds ``image_list``: image blocks with payload and signature, by falling area, those with payload first. Needs ``text_boxes``."""
    placed = F.transform(_array("blocks"), lambda b, i: F.struct(i.alias("no"), b.alias("b")))
    wanted = F.filter(placed, lambda x: (x["b"]["type"] == 1) & g.complete(x["b"]["bbox"]))
    if skip_background_images:
        wanted = F.filter(wanted, lambda x: ~is_background(x["b"]["bbox"], F.col("rect"), F.col("text_boxes")))
    content = (lambda b: t.base64_plain(b["image"])) if include_image_base64 else (lambda b: F.lit(None).cast("string"))
    ext = lambda b: F.lower(F.when(F.length(b["ext"]) > 0, b["ext"]).otherwise(F.lit("png")))
    loaded = F.transform(F.col("__wanted"), lambda x: F.struct(x["no"].alias("no"), x["b"]["bbox"].alias("bbox"), ext(x["b"]).alias("ext"), x["b"]["width"].alias("pixel_width"), x["b"]["height"].alias("pixel_height"), content(x["b"]).alias("content")))
    keyed = F.transform(
        F.col("__loaded"),
        lambda x: F.struct(
            (-g.area(x["bbox"])).alias("k"), F.when(x["content"].isNull(), 1).otherwise(0).alias("bare"), x["no"].alias("no"), x["bbox"].alias("bbox"), x["ext"].alias("ext"), x["pixel_width"].alias("pixel_width"), x["pixel_height"].alias("pixel_height"),
            x["content"].alias("content"), t.image_signature(x["ext"], x["pixel_width"], x["pixel_height"], x["content"]).alias("signature"),
        ),
    )
    return pages.withColumn("__wanted", wanted).withColumn("__loaded", loaded).withColumn("image_list", F.array_sort(keyed)).drop("__wanted", "__loaded")


def with_images(pages: DataFrame, include_image_base64: bool = True, skip_background_images: bool = True) -> DataFrame:
    """Adds ``image_list``: images, none the same as one before it. Without payloads more are the same."""
    listed = listed_images(pages, include_image_base64, skip_background_images)
    return listed.withColumn("__kept", keep_first("image_list", same_image)).withColumn("image_list", F.col("__kept")).drop("__kept")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _atom(kind: str, rank: int, x: Column, k1: Column, k2: Column, k3: Column, **own: Column) -> Column:
    b = x["bbox"]
    fields = {
        "content": _null("string"), "content_raw": _null("string"), "content_tagged": _null("string"), "mime_type": _null("string"),
        "line_count": F.lit(0), "span_count": F.lit(0), "char_count_raw": F.lit(0), "char_count_clean": F.lit(0), "source_block_type": _null("int"), "source_ext": _null("string"), "pixel_width": _null("int"), "pixel_height": _null("int"),
    } | own
    return F.struct(
        b["y0"].alias("y0"), b["x0"].alias("x0"), F.lit(rank).alias("rank"), k1.cast("double").alias("k1"), k2.cast("int").alias("k2"), k3.cast("int").alias("k3"),
        F.lit(kind).alias("type"), b.alias("bbox"), *(v.alias(k) for k, v in fields.items()),
    )


def page_atoms(raw: DataFrame, **flags: bool) -> DataFrame:
    """``doc_id, page_number, rect, width, height, atoms``: the atoms of each page in reading order, in one array.

    Reading order is by top, then left side; of equal ones texts come before images
    before tables, texts as listed, images and tables by falling area. Null blocks
    and tables count as none; a page without atoms has the empty array; a rect
    that is null or lacks a side counts as an empty page, and a box that lacks one
    as no box. ``flags`` are those of ``ParseOptions``.
    """
    options = ParseOptions(**flags)
    pages = with_sizes(raw.select(*PAGE, F.when(g.complete(F.col("rect")), F.col("rect")).otherwise(g.box(*[F.lit(0.0)] * 4)).alias("rect"), "blocks", "tables"))
    texts = with_texts(with_text_boxes(with_tables(pages, options.include_table_base64)))
    pages = with_images(texts, options.include_image_base64, options.skip_background_images)
    png = F.lit("image/png")
    texts = F.transform("text_list", lambda x: _atom(
        "text", 0, x, F.lit(0.0), F.lit(0), x["no"], content=x["content"], content_raw=x["content_raw"], content_tagged=x["content_tagged"], line_count=x["line_count"], span_count=x["span_count"],
        char_count_raw=F.length(x["content_raw"]), char_count_clean=F.length(x["content"]), source_block_type=F.lit(0)))
    images = F.transform("image_list", lambda x: _atom(
        "image", 1, x, x["k"], x["bare"], x["no"], content=x["content"], mime_type=F.when(x["content"].isNotNull(), F.concat(F.lit("image/"), x["ext"])), source_block_type=F.lit(1), source_ext=x["ext"],
        pixel_width=x["pixel_width"], pixel_height=x["pixel_height"]))
    tables = F.transform("table_list", lambda x: _atom("table", 2, x, x["k"], F.lit(0), x["no"], content=x["content"], mime_type=F.when(x["content"].isNotNull(), png), source_ext=F.lit("png")))
    return pages.select(*PAGE, "rect", "width", "height", F.array_sort(F.concat(texts, images, tables)).alias("atoms"))


ATOM_FIELDS = ["type", "bbox", "content", "content_raw", "content_tagged", "mime_type", "line_count", "span_count", "char_count_raw", "char_count_clean", "source_block_type", "source_ext", "pixel_width", "pixel_height"]


def extract_atoms(raw: DataFrame, **flags: bool) -> DataFrame:
    """One row for each atom: page, ``atom_no`` (its place in reading order), ATOM_FIELDS and its places on the page."""
    pages = page_atoms(raw, **flags)
    rows = unnest(pages, [*PAGE, "width", "height"], "atoms", "atom_no", "a")
    return rows.select(
        *PAGE, "atom_no", *(F.col(f"a.{c}").alias(c) for c in ATOM_FIELDS),
        g.normalized_position(F.col("a.bbox"), F.col("width"), F.col("height")).alias("position_normalized"), g.normalized_size(F.col("a.bbox"), F.col("width"), F.col("height")).alias("size_normalized"),
        g.coarse_position(F.col("a.bbox"), F.col("width"), F.col("height")).alias("absolute_position_coarse"),
    )


def page_counts(pages: DataFrame, *more: str) -> DataFrame:
    """The page's size and its atoms by kind, before any grouping; and columns to keep."""
    count = lambda kind: F.size(F.filter("atoms", lambda a: a["type"] == kind)).alias(f"{kind}_atom_count")
    return pages.select(*PAGE, "width", "height", F.size("atoms").alias("atom_count"), *(count(k) for k in ("text", "image", "table")), *more)
