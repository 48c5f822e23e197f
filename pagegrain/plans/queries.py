"""Queries of the core; ``plans.oracle`` has the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.functions import geometry as g
from pagegrain.functions import text as t
from pagegrain.operators import atoms, intervals, layout, nested, overlay, views
from pagegrain.plans import fixtures, oracle, parse
from pagegrain.runtime import materialize, spread, table, unnest
from pagegrain.sources.raw import at_page

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Size of the pages that ``fixtures.layout_boxes`` fills.
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def _w() -> Column:
    return F.lit(PAGE_WIDTH)


def _h() -> Column:
    return F.lit(PAGE_HEIGHT)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _sides(b: str = "b") -> list[Column]:
    return [F.col(f"{b}.{s}").alias(s) for s in g.SIDES]


# --- geometry, over boxes derived from events


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.layout_boxes(spark, d).select("page", "id", "kind", F.struct(*g.SIDES).alias("b"))


def _measured(spark: SparkSession, d: str, *columns: Column) -> DataFrame:
    return _boxes(spark, d).select("page", "id", *columns)


def _pairs(spark: SparkSession, d: str, kind_a: str, kind_b: str) -> DataFrame:
    """Intersecting boxes of two kinds on one page; a page has a dozen or so."""
    boxes = _boxes(spark, d)
    a = boxes.where(F.col("kind") == kind_a).select("page", F.col("id").alias("id_a"), F.col("b").alias("a"))
    b = boxes.where(F.col("kind") == kind_b).select("page", F.col("id").alias("id_b"), "b")
    pairs = a.join(b, "page").where(g.intersects(F.col("a"), F.col("b")))
    return pairs.where("id_a < id_b") if kind_a == kind_b else pairs


@query
def bbox_measures(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    return _measured(spark, d, g.width(b).alias("width"), g.height(b).alias("height"), g.area(b).alias("area"), g.cx(b).alias("cx"), g.cy(b).alias("cy"))


@query
def bbox_union(spark: SparkSession, d: str) -> DataFrame:
    return _boxes(spark, d).groupBy("page").agg(g.union_agg(F.col("b")).alias("b")).select("page", *_sides())


@query
def bbox_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "table", "text").withColumn("i", g.intersection(F.col("a"), F.col("b"))).select("page", "id_a", "id_b", *_sides("i"))


@query
def bbox_contains(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d, "table", "text").select("page", "id_a", "id_b", g.contains(a, b).alias("inside"), g.contains(a, b, 4.0).alias("nearly_inside"))


@query
def bbox_overlap_ratio(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, d, "table", "text").select("page", "id_a", "id_b", g.overlap_ratio(a, b).alias("a_in_b"), g.overlap_ratio(b, a).alias("b_in_a"))


@query
def bbox_iou(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d, "image", "image").select("page", "id_a", "id_b", g.iou(F.col("a"), F.col("b")).alias("iou"))


@query
def bbox_scale(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d, g.scale(F.col("b"), 2.0).alias("b")).select("page", "id", *_sides())


@query
def point_distance(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d, g.distance_squared(_w() / 2, _h() / 2, F.col("b")).alias("distance"))


@query
def coarse_position(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d, g.coarse_position(F.col("b"), _w(), _h()).alias("coarse"))


@query
def normalized_geometry(spark: SparkSession, d: str) -> DataFrame:
    p, s = g.normalized_position(F.col("b"), _w(), _h()), g.normalized_size(F.col("b"), _w(), _h())
    return _measured(spark, d, p["x"].alias("x"), p["y"].alias("y"), s["w"].alias("w"), s["h"].alias("h"))


@query
def page_area_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d, g.page_area_ratio(F.col("b"), g.box(F.lit(0.0), F.lit(0.0), _w(), _h())).alias("ratio"))


# --- text, over raw pages and documents


def _raw(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "raw_pages")
    return spread(atoms.distinct_pages(pages), pages)


def _text_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = atoms.with_sizes(_raw(spark, d))
    rows = pages.select("doc_id", "page_number", "width", "height", F.posexplode("blocks").alias("block_no", "b"))
    return rows.where((F.col("b.type") == 0) & F.col("b.bbox").isNotNull())


@query
def span_text(spark: SparkSession, d: str) -> DataFrame:
    blocks = _raw(spark, d).select("doc_id", "page_number", F.posexplode("blocks").alias("block_no", "b"))
    lines = blocks.select("doc_id", "page_number", "block_no", F.posexplode("b.lines").alias("line_no", "l"))
    spans = lines.select("doc_id", "page_number", "block_no", "line_no", F.posexplode("l.spans").alias("span_no", "s"))
    return spans.select("doc_id", "page_number", "block_no", "line_no", "span_no", t.span_text(F.col("s")).alias("text"))


@query
def text_normalize(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.dirty_text(spark, d).select("doc_id", t.normalize(F.col("text")).alias("text"))


@query
def block_text(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("b")
    rows = _text_blocks(spark, d).withColumn("content_raw", t.block_text(b)).withColumn("content", t.normalize(F.col("content_raw")))
    return rows.select("doc_id", "page_number", "block_no", "content_raw", "content", t.line_count(b).alias("line_count"), t.span_count(b).alias("span_count"), F.length("content_raw").alias("char_count_raw"), F.length("content").alias("char_count_clean"))


@query
def tagged_text(spark: SparkSession, d: str) -> DataFrame:
    return _text_blocks(spark, d).select("doc_id", "page_number", "block_no", t.tagged_text(F.col("b"), F.col("width"), F.col("height")).alias("content_tagged"))


@query
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.html_escape(F.col("text")).alias("text"))


@query
def base64_payload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.base64_plain(F.col("text").cast("binary")).alias("payload"))


@query
def image_signature(spark: SparkSession, d: str) -> DataFrame:
    rows = _images(spark, d).transform(_listed, "image_list", "i")
    return rows.select("doc_id", "page_number", F.col("i.no").alias("block_no"), F.col("i.signature").alias("signature"), F.when(F.col("i.content").isNotNull(), F.concat(F.lit("image/"), F.col("i.ext"))).alias("mime_type"))


@query
def chunk_label(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    label = t.chunk_label(F.col("type"), F.col("layout"), F.col("absolute_position_coarse"), F.col("absolute_position_dynamic"), F.col("relative_position"))
    return rows.select("chunk_id", label.alias("label"), t.chunk_colour(F.col("type"), F.col("layout")).alias("colour"))


# --- atoms, over raw pages


def _listed(pages: DataFrame, name: str, element: str) -> DataFrame:
    return unnest(pages, ["doc_id", "page_number"], name, "at", element)


def _tables(spark: SparkSession, d: str) -> DataFrame:
    return atoms.padded_tables(_raw(spark, d))


def _images(spark: SparkSession, d: str) -> DataFrame:
    return atoms.listed_images(atoms.with_text_boxes(_raw(spark, d)))


@query
def table_pad(spark: SparkSession, d: str) -> DataFrame:
    return _tables(spark, d).transform(_listed, "table_list", "t").select("doc_id", "page_number", F.col("t.no").alias("table_no"), *_sides("t.bbox"))


@query
def table_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return atoms.with_tables(_raw(spark, d)).transform(_listed, "table_list", "t").select("doc_id", "page_number", F.col("t.no").alias("table_no"), *_sides("t.bbox"))


@query
def text_table_antijoin(spark: SparkSession, d: str) -> DataFrame:
    pages = atoms.with_texts(atoms.with_tables(atoms.with_sizes(_raw(spark, d))))
    return pages.transform(_listed, "text_list", "x").select("doc_id", "page_number", F.col("x.no").alias("block_no"), "x.content")


def _image_blocks(spark: SparkSession, d: str) -> DataFrame:
    pages = atoms.with_text_boxes(_raw(spark, d))
    rows = pages.select("doc_id", "page_number", "rect", "text_boxes", F.posexplode(F.filter("blocks", lambda b: b["type"].isin(0, 1))).alias("no", "b"))
    return rows.where((F.col("b.type") == 1) & F.col("b.bbox").isNotNull()).withColumn("block_no", F.col("b.block_no"))


@query
def text_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _image_blocks(spark, d).select("doc_id", "page_number", "block_no", atoms.text_coverage(F.col("b.bbox"), F.col("text_boxes")).alias("coverage"))


@query
def background_images(spark: SparkSession, d: str) -> DataFrame:
    bbox, rect = F.col("b.bbox"), F.col("rect")
    return _image_blocks(spark, d).select("doc_id", "page_number", "block_no", g.page_area_ratio(bbox, rect).alias("ratio"), atoms.is_background(bbox, rect, F.col("text_boxes")).alias("is_background"))


@query
def image_dedupe(spark: SparkSession, d: str) -> DataFrame:
    pages = atoms.with_images(atoms.with_text_boxes(_raw(spark, d)))
    return pages.transform(_listed, "image_list", "i").select("doc_id", "page_number", F.col("i.no").alias("block_no"), *_sides("i.bbox"), "i.signature")


@query
def atom_union(spark: SparkSession, d: str) -> DataFrame:
    rows = atoms.extract_atoms(_raw(spark, d))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("content").alias("n_content"), F.countDistinct("doc_id").alias("n_docs"))


@query
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    rows = unnest(atoms.page_atoms(_raw(spark, d)), ["doc_id", "page_number"], "atoms", "atom_no", "a")
    return rows.select("doc_id", "page_number", "atom_no", "a.type", F.col("a.k3").alias("source_no"))


@query
def page_debug(spark: SparkSession, d: str) -> DataFrame:
    return atoms.page_counts(atoms.page_atoms(_raw(spark, d)))


def _flat_atoms(rows: DataFrame) -> DataFrame:
    """Scalar columns only; whole numbers that aren't known are -1, so that both engines give one type."""
    known = [F.coalesce(c, F.lit(-1)).alias(c) if c in ("source_block_type", "pixel_width", "pixel_height") else F.col(c) for c in atoms.ATOM_FIELDS[2:]]
    return rows.select("doc_id", "page_number", "atom_no", "type", *_sides("bbox"), *known)


@query
def extract_atoms(spark: SparkSession, d: str) -> DataFrame:
    return _flat_atoms(atoms.extract_atoms(_raw(spark, d)))


@query
def extract_atoms_no_payload(spark: SparkSession, d: str) -> DataFrame:
    return _flat_atoms(atoms.extract_atoms(_raw(spark, d), include_table_base64=False, include_image_base64=False))


# --- intervals, cuts and trees, over boxes derived from events


def _box_pages(spark: SparkSession, d: str) -> DataFrame:
    """One row for each page with its boxes in reading order."""
    placed = F.struct(F.col("b.y0").alias("y0"), F.col("b.x0").alias("x0"), "id", "b")
    pages = _boxes(spark, d).groupBy("page").agg(F.array_sort(F.collect_list(placed)).alias("ps"))
    rect = g.box(F.lit(0.0), F.lit(0.0), _w(), _h())
    return pages.select("page", rect.alias("rect"), _w().alias("width"), _h().alias("height"), F.transform("ps", lambda p: p["id"]).alias("ids"), F.transform("ps", lambda p: p["b"]).alias("bs"))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    pages = _box_pages(spark, d)
    for axis, end in (("vertical", _w()), ("horizontal", _h())):
        pages = pages.withColumn(f"merged_{axis}", intervals.occupied(F.col("bs"), F.lit(0.0), end, axis))
        pages = pages.withColumn(f"free_{axis}", intervals.gaps(F.col(f"merged_{axis}"), F.lit(0.0), end))
        pages = pages.withColumn(f"scored_{axis}", intervals.scored(F.col("bs"), F.col(f"free_{axis}"), end, axis))
    return pages


def _both_axes(pages: DataFrame, name: str) -> DataFrame:
    both = F.array(*(F.struct(F.lit(short).alias("axis"), F.col(f"{name}_{axis}").alias("l")) for axis, short in (("vertical", "x"), ("horizontal", "y"))))
    return unnest(unnest(pages, ["page"], both, "at", "a"), ["page", "a.axis"], "a.l", "at", "i").select("page", "axis", "i.s", "i.e")


@query
def occupied_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _both_axes(_gaps(spark, d), "merged")


@query
def find_gaps(spark: SparkSession, d: str) -> DataFrame:
    return _both_axes(_gaps(spark, d), "free")


@query
def split_scores(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(*(F.struct(F.lit(axis).alias("axis"), F.col(f"scored_{axis}").alias("l")) for axis in ("vertical", "horizontal")))
    return unnest(unnest(_gaps(spark, d), ["page"], both, "at", "a"), ["page", "a.axis"], "a.l", "at", "i").select("page", "axis", "i.s", "i.e", "i.first", "i.second", "i.score")


@query
def best_split(spark: SparkSession, d: str) -> DataFrame:
    best = intervals.best_cut(F.col("scored_vertical"), F.col("scored_horizontal"))
    return _gaps(spark, d).select("page", best.alias("c")).where("c is not null").select("page", "c.axis", "c.s", "c.e", "c.score")


@query
def region_members(spark: SparkSession, d: str) -> DataFrame:
    halves = F.array(F.struct(F.lit("left").alias("region"), g.box(F.lit(0.0), F.lit(0.0), _w() / 2, _h()).alias("r")), F.struct(F.lit("right").alias("region"), g.box(_w() / 2, F.lit(0.0), _w(), _h()).alias("r")))
    rows = _boxes(spark, d).withColumn("h", F.explode(halves))
    return rows.where(intervals.in_region(F.col("b"), F.col("h.r"))).select("page", "id", "h.region")


def _box_nodes(spark: SparkSession, d: str) -> DataFrame:
    pages = _box_pages(spark, d).withColumn("nodes", layout.tree_nodes(F.col("rect"), F.col("bs")))
    rows = unnest(pages, ["page", "ids"], "nodes", "chunk_index", "n")
    return rows.select("page", "chunk_index", "n.*", F.get(F.col("ids"), F.col("n.atom_no")).alias("id"))


@query
def layout_tree(spark: SparkSession, d: str) -> DataFrame:
    return _box_nodes(spark, d).select("page", "path", "parent_path", "depth", "layout", F.coalesce("id", F.lit(-1)).alias("id"))


@query
def layout_tree_levels(spark: SparkSession, d: str) -> DataFrame:
    """``layout_tree`` by the expressions of single cuts, level by level."""
    pages = _box_pages(spark, d)
    nodes = layout.tree_by_levels(pages, ["page", "ids"])
    return nodes.select("page", "path", "parent_path", "depth", "layout", F.coalesce(F.get(F.col("ids"), F.col("atom_no")), F.lit(-1)).alias("id"))


@query
def tree_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _box_nodes(spark, d).where("id is not null").select("page", "id", "path")


@query
def group_bbox(spark: SparkSession, d: str) -> DataFrame:
    return _box_nodes(spark, d).where("id is null").select("page", "path", *_sides("bbox"))


@query
def preorder_index(spark: SparkSession, d: str) -> DataFrame:
    return _box_nodes(spark, d).select("page", "path", "chunk_index")


@query
def relative_position(spark: SparkSession, d: str) -> DataFrame:
    return _box_nodes(spark, d).select("page", "path", layout.relative_position(F.col("ordinal"), F.col("n_siblings"), F.col("parent_layout")).alias("relative"))


def _zoned(spark: SparkSession, d: str) -> DataFrame:
    pages = _box_pages(spark, d).withColumn("nodes", layout.tree_nodes(F.col("rect"), F.col("bs")))
    pages = pages.withColumn("ms", F.transform("nodes", lambda n: g.normalized_position(n["bbox"], F.col("width"), F.col("height"))))
    pages = pages.withColumn("bx", layout.zone_breaks(F.transform("ms", lambda m: m["x"]), layout.ZONE_GAP_X)).withColumn("by", layout.zone_breaks(F.transform("ms", lambda m: m["y"]), layout.ZONE_GAP_Y))
    rows = unnest(pages, ["page", "bx", "by"], F.arrays_zip("nodes", "ms"), "at", "z")
    return rows.select("page", F.col("z.nodes.path").alias("path"), layout.dynamic_position(F.col("z.ms.x"), F.col("z.ms.y"), F.col("bx"), F.col("by")).alias("p")).select("page", "path", "p.*")


@query
def zone_clusters(spark: SparkSession, d: str) -> DataFrame:
    return _zoned(spark, d).select("page", "x_zone_count", "y_zone_count").distinct()


@query
def dynamic_position(spark: SparkSession, d: str) -> DataFrame:
    return _zoned(spark, d)


@query
def fallback_flow(spark: SparkSession, d: str) -> DataFrame:
    return _box_nodes(spark, d).where("parent_fell_back").select("page", "path", "id", "ordinal")


@query
def flat_index(spark: SparkSession, d: str) -> DataFrame:
    pages = layout.flat_nodes(_box_pages(spark, d).withColumn("atoms", F.transform("bs", lambda b: F.struct(b.alias("bbox")))))
    rows = unnest(pages, ["page", "ids"], "nodes", "chunk_index", "n")
    return rows.select("page", "chunk_index", F.get(F.col("ids"), F.col("n.atom_no")).alias("id"))


# --- parsing and views


@query
def parse_document(spark: SparkSession, d: str) -> DataFrame:
    return _plain_chunks(parse.parse_document(_raw(spark, d))[0])


def _plain_chunks(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "page_number", "path", "parent_path", "depth", "ordinal", "chunk_index", "type", "layout", *_sides("bbox"), "content", "content_raw", "content_tagged", "mime_type",
        "position_normalized.x", "position_normalized.y", F.col("absolute_position_coarse").alias("coarse"), "absolute_position_dynamic.*", "relative_position",
    )


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return views.distinct_chunks(table(spark, d, "chunks"))


_CHUNK = ["chunk_id", "doc_id", "page_number", "path", "depth", "chunk_index", "absolute_position_coarse"]


@query
def all_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select(*_CHUNK, "type")


def _kind(kind: str) -> Query:
    return lambda spark, d: views.distinct_chunks(views.of_kind(table(spark, d, "chunks"), kind)).select(*_CHUNK)


QUERIES |= {f"{kind}_chunks": _kind(kind) for kind in views.KINDS}


@query
def parent_children(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    parents = rows.select("doc_id", "page_number", F.col("path").alias("parent_path"), F.col("chunk_id").alias("parent_id"))
    return rows.join(parents, ["doc_id", "page_number", "parent_path"]).select("parent_id", F.col("chunk_id").alias("child_id"), "ordinal")


def _page_text(form: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return views.page_text(table(spark, d, "chunks"), form=form, all_pages=True)

    return run


QUERIES |= {"page_text": _page_text("clean"), "page_text_raw": _page_text("raw"), "page_text_tagged": _page_text("tagged")}


@query
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return views.page_blocks(table(spark, d, "chunks")).select("doc_id", "page_number", "block_index", *_sides("bbox"), "text")


@query
def point_page(spark: SparkSession, d: str) -> DataFrame:
    return views.distinct_chunks(at_page(table(spark, d, "chunks"), 2)).select("chunk_id", "path", "type")


@query
def parse_page(spark: SparkSession, d: str) -> DataFrame:
    """The lookup of one page, that of the first document's last number, among all."""
    raw = _raw(spark, d)
    doc, number = raw.agg(F.min_by(F.struct("doc_id", "page_number"), F.struct("doc_id", -F.col("page_number"))).alias("p")).first().p
    return _plain_chunks(parse.parse_page(raw, doc, number)[0])


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return layout.with_chunks(parse.parsed_pages(_raw(spark, d)))


@query
def page_json(spark: SparkSession, d: str) -> DataFrame:
    return views.json_of_pages(_parsed(spark, d))


@query
def document_json(spark: SparkSession, d: str) -> DataFrame:
    return views.document_json(views.json_of_pages(_parsed(spark, d)))


@query
def page_json_tree(spark: SparkSession, d: str) -> DataFrame:
    """What the JSON of pages holds when it is read again: nodes by their place in the tree."""
    flat = nested.flatten_records(views.json_of_pages(_parsed(spark, d)).withColumn("body", F.concat(F.lit('{"pages":['), F.col("json"), F.lit("]}"))).withColumn("key", F.concat_ws("/", *atoms.PAGE)), "key")
    nodes = flat.where("table_name = 'pages.chunks'")
    of = lambda name: F.expr(f"fields['{name}']")
    return nodes.select("key", "node_path", "parent_path", of("type").alias("type"), of("layout").alias("layout"), of("chunk_index").cast("int").alias("chunk_index"), of("absolute_position_coarse").alias("coarse"), of("relative_position").alias("relative_position"), of("content").alias("content"), of("bbox.x0").cast("double").alias("x0"), of("bbox.y1").cast("double").alias("y1"))


@query
def document_json_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of documents, with the numbers of the pages and chunks each holds when it is read again."""
    parts = views.document_json(views.json_of_pages(_parsed(spark, d)), pages_a_part=3)
    flat = nested.flatten_records(parts.select(F.concat_ws("/", "doc_id", "part_no").alias("key"), "json"), "key", "json", with_fields=False)
    count = lambda name: F.count(F.when(F.col("table_name") == name, 1))
    return flat.groupBy("key").agg(count("pages").alias("n_pages"), count("pages.chunks").alias("n_chunks"))


@query
def overlay_candidates(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d).withColumn("s", g.scale(F.col("b"), 2.0))
    places = overlay.candidates(F.col("s"), overlay.label_width(F.col("kind")), F.col("kind") == "table", _w() * 2, _h() * 2)
    rows = boxes.select("page", "id", F.posexplode(places).alias("place_no", "p"))
    return rows.select("page", "id", "place_no", *_sides("p.rect"), F.col("p.ax").alias("ax"), F.col("p.ay").alias("ay"))


@query
def overlay_svg(spark: SparkSession, d: str) -> DataFrame:
    return overlay.svg_of_pages(_parsed(spark, d))


@query
def overlay_labels(spark: SparkSession, d: str) -> DataFrame:
    return overlay.placed_labels(_parsed(spark, d)).select(*atoms.PAGE, "at", "place_no", *_sides("rect"), "ax", "ay")


@query
def overlay_png(spark: SparkSession, d: str) -> DataFrame:
    """Sizes in pixels of the pages' pictures, as their files give them."""
    pictures = overlay.png_of_pages(_parsed(spark, d))
    size = lambda at: F.conv(F.hex(F.substring("png", at, 4)), 16, 10).cast("int")
    return pictures.select(*atoms.PAGE, F.hex(F.substring("png", 2, 3)).alias("kind"), size(17).alias("width"), size(21).alias("height"))


@query
def overlay_frames(spark: SparkSession, d: str) -> DataFrame:
    """The frames in the drawings of pages, read again from their text: place, size and colour of each."""
    drawn = overlay.svg_of_pages(_parsed(spark, d), show_labels=False)
    frames = F.regexp_extract_all("svg", F.lit("<rect ([^>]*)/>"), 1)
    rows = unnest(drawn, atoms.PAGE, frames, "at", "f")
    value = lambda name: F.regexp_extract("f", f'(?:^| ){name}="([^"]*)"', 1)
    return rows.select(*atoms.PAGE, "at", *(value(n).cast("double").alias(n) for n in ("x", "y", "width", "height")), value("stroke").alias("colour"), value("stroke-width").cast("int").alias("line_width"))


# --- problem 6: nested records


def _flat(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "page_records").select("record_id", "body")
    return nested.flatten_records(spread(records, records))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.found_nodes(_flat(spark, d))


def _columns(rows: DataFrame) -> DataFrame:
    """A table's own columns, its box as four; ``p6_rest`` has the fields without one."""
    rows = rows.drop("rest")
    return rows.select(*(c for c in rows.columns if c != "bbox"), *_sides("bbox")) if "bbox" in rows.columns else rows


@query
def p6_pages(spark: SparkSession, d: str) -> DataFrame:
    return _columns(nested.page_table(_flat(spark, d)))


@query
def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return _columns(nested.node_table(_flat(spark, d), groups=True))


@query
def p6_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _columns(nested.node_table(_flat(spark, d), groups=False))


@query
def p6_rest(spark: SparkSession, d: str) -> DataFrame:
    return nested.rest_table(materialize(_flat(spark, d), "flat-records"))


@query
def p6_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.record_table(_flat(spark, d))


@query
def p6_annotations(spark: SparkSession, d: str) -> DataFrame:
    rows = _columns(nested.note_table(_flat(spark, d)))
    return rows.withColumn("tags", F.concat_ws(",", F.transform("tags", lambda t: F.concat(t["ordinal"], F.lit("="), t["tag"]))))


@query
def p6_others(spark: SparkSession, d: str) -> DataFrame:
    return nested.other_table(_flat(spark, d))


ORACLES = oracle.ORACLES
