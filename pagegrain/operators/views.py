"""Views of the node table: chunks by kind, page texts, JSON of pages and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrain.operators.atoms import PAGE, page_counts
from pagegrain.runtime import once

KINDS = ("text", "image", "table", "group")
TEXTS = {"clean": "content", "raw": "content_raw", "tagged": "content_tagged"}


def distinct_chunks(chunks: DataFrame) -> DataFrame:
    """Each chunk once; repeated deliveries differ in nothing a view shows. No rows are shuffled (``runtime.once``)."""
    return once(chunks, [*PAGE, "path"])


def of_kind(chunks: DataFrame, kind: str) -> DataFrame:
    """The chunks of one kind; the filter reaches the scan."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    return chunks.where(F.col("type") == kind)


def _page_texts(chunks: DataFrame, columns: list[Column], all_pages: bool) -> DataFrame:
    """``PAGE, ts``: a page's text chunks in pre-order, repeats once, as structs of ``chunk_index, path`` and ``columns``.

    One exchange, by page, of what ``columns`` need of text chunks; with
    ``all_pages`` of the names of other chunks too, else the scan leaves them out.
    """
    rows = chunks if all_pages else of_kind(chunks, "text")
    text = F.when(F.col("type") == "text", F.struct("chunk_index", "path", *columns)).alias("t")
    pages = rows.select(*PAGE, text).groupBy(*PAGE).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    first = lambda t, i: (i == 0) | ~t["path"].eqNullSafe(F.get(F.col("ts"), i - 1)["path"])
    return pages.withColumn("ts", F.filter("ts", first))


def page_text(chunks: DataFrame, pages: DataFrame | None = None, form: str = "clean", all_pages: bool = False) -> DataFrame:
    """``doc_id, page_number, text``: the page's texts in pre-order, an empty line between them.

    A page without text has a row, with the empty text, if it is in ``pages``, or
    if ``all_pages`` and any chunk is on it. Null texts are left out; repeated
    deliveries of a chunk count once.
    """
    texts = _page_texts(chunks, [F.col(TEXTS[form]).alias("t")], all_pages)
    joined = texts.select(*PAGE, F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n").alias("text"))
    if pages is None:
        return joined
    return pages.select(*PAGE).distinct().join(joined, PAGE, "left").withColumn("text", F.coalesce("text", F.lit("")))


def page_blocks(chunks: DataFrame) -> DataFrame:
    """``doc_id, page_number, block_index, bbox, text``: the text chunks of a page, repeats once, numbered in pre-order."""
    texts = _page_texts(chunks, [F.col("bbox"), F.col("content").alias("text")], all_pages=False)
    return texts.select(*PAGE, F.posexplode("ts").alias("block_index", "t")).select(*PAGE, "block_index", "t.bbox", "t.text")


_COMMON = ["chunk_index", "page_number", "type", "bbox", "position_normalized", "size_normalized", "absolute_position_coarse", "absolute_position_dynamic", "relative_position"]
_COUNTS = ("atom_count", "text_atom_count", "image_atom_count", "table_atom_count")
_KEEP_NULLS = {"ignoreNullFields": "false"}


def _json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), _KEEP_NULLS)


def _open(text: Column, more: str) -> Column:
    """An object's text without its last brace, and what goes on."""
    return F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(more))


def _chunk_text(c: Callable[[str], Column]) -> Column:
    """A chunk as JSON; a group's is left open for its children."""
    named = lambda *names: [c(n).alias(n) for n in names]
    group = _open(_json(*named(*_COMMON, "layout")), ',"children":[')
    text = _json(*named(*_COMMON, "content", "content_raw", "content_tagged", "debug"))
    other = _json(*named(*_COMMON, "content", "mime_type", "debug"))
    return F.when(c("type") == "group", group).when(c("type") == "text", text).otherwise(other)


def _tree_text(nodes: str) -> Column:
    """Chunks in pre-order (``depth, open, j``) as one text.

    Each is followed by as many closings as the next is less deep, so no recursion is needed.
    """

    def piece(n: Column, i: Column) -> Column:
        following = F.get(F.col(nodes), i + 1)
        next_depth = F.coalesce(following["depth"], F.lit(0))
        level = n["depth"] + F.when(n["open"], 1).otherwise(0)  # how deep the text is after this chunk
        closings = F.repeat(F.lit("]}"), F.greatest(level - next_depth, F.lit(0)))
        return F.concat(n["j"], closings, F.when(following.isNull() | (n["open"] & (next_depth > n["depth"])), "").otherwise(","))

    return F.array_join(F.transform(nodes, piece), "")


def _page_text_json(tree: Column, counts: list[Column | str]) -> Column:
    head = _open(_json("page_number", "width", "height"), ',"chunks":[')
    return F.concat(head, F.coalesce(tree, F.lit("")), F.lit('],"debug":'), _json(*counts), F.lit("}"))


def page_json(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, json``: each page of ``pages`` with its tree of chunks, nulls kept.

    Groups have ``layout`` and, last, ``children``; leaves have content and debug.
    ``pages`` has width, height and the four atom counts. This is for stored tables
    and shuffles them by page; ``json_of_pages`` needs no shuffle.
    """
    rows = chunks.withColumn("j", _chunk_text(F.col))
    trees = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("path", "depth", (F.col("type") == "group").alias("open"), "j"))).alias("ns"))
    whole = pages.select(*PAGE, "width", "height", *_COUNTS).join(trees.select(*PAGE, _tree_text("ns").alias("tree")), PAGE, "left")
    return whole.select(*PAGE, _page_text_json(F.col("tree"), list(_COUNTS)).alias("json"))


def json_of_pages(pages: DataFrame) -> DataFrame:
    """As ``page_json``, from pages with ``atoms`` and ``chunks`` (``layout.with_chunks``); nothing is shuffled."""
    number = F.col("page_number")
    nodes = F.transform("chunks", lambda c: F.struct(c["depth"].alias("depth"), (c["type"] == "group").alias("open"), _chunk_text(lambda name: number if name == "page_number" else c[name]).alias("j")))
    counted = page_counts(pages.withColumn("ns", nodes), "ns")
    return counted.select(*PAGE, _page_text_json(_tree_text("ns"), list(_COUNTS)).alias("json"))


def document_json(page_jsons: DataFrame, pages_a_part: int = 100) -> DataFrame:
    """``doc_id, part_no, n_pages, json``: a document as objects of ``pages`` in order, one for each stretch of pages.

    Part k holds the pages from k * pages_a_part + 1 on, so that no task and no
    value holds more than that many pages, however long a document is; one within
    that is whole in its part 0. Pages without a number are in a part of their own,
    with a null ``part_no``. Nothing is shuffled but the pages, by document and part.
    """
    part = F.floor((F.col("page_number") - 1) / pages_a_part).cast("int")
    pages = page_jsons.groupBy("doc_id", part.alias("part_no")).agg(F.array_sort(F.collect_list(F.struct("page_number", "json"))).alias("ps"))
    text = F.concat(F.lit('{"pages":['), F.array_join(F.transform("ps", lambda p: p["json"]), ","), F.lit("]}"))
    return pages.select("doc_id", "part_no", F.size("ps").alias("n_pages"), text.alias("json"))
