"""Text of spans, lines and blocks as column expressions; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrain.functions import geometry as g

#: The white space that ends of lines lose, besides the line feed.
BLANKS = r"[\t\x0B\f\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: A gap between spans beyond this, and beyond this many mean heights, parts them.
MIN_GAP, GAP_HEIGHTS = 18.0, 1.8
#: Fixed value: an image's signature covers so much of its encoded payload.
SIGNED_PREFIX = 2048


def normalize(text: Column) -> Column:
    """One kind of line end, no NULs, no blanks at line ends, at most one empty line, none outside.

    A NUL goes after the line ends are settled, so that one between a carriage
    return and a line feed leaves two line ends.
    """
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    text = F.replace(text, F.lit("\x00"), F.lit(""))
    text = F.regexp_replace(text, BLANKS + r"(?=\n|\z)", "")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"\A\n+|\n+\z", "")


def span_text(span: Column) -> Column:
    """The span's text, or that of its characters if it has none."""
    letters = F.transform(F.coalesce(span["chars"], F.array()), lambda c: F.coalesce(c["c"], F.lit("")))
    return F.coalesce(span["text"], F.array_join(letters, ""))


def _spans(line: Column) -> Column:
    return F.coalesce(line["spans"], F.array())


def line_text(line: Column) -> Column:
    return F.array_join(F.transform(_spans(line), span_text), "")


def block_text(block: Column) -> Column:
    """Lines in source order, each by a line feed; an empty line keeps its place."""
    return F.array_join(F.transform(F.coalesce(block["lines"], F.array()), line_text), "\n")


def line_count(block: Column) -> Column:
    return F.size(F.coalesce(block["lines"], F.array()))


def span_count(block: Column) -> Column:
    return F.aggregate(F.coalesce(block["lines"], F.array()), F.lit(0), lambda n, line: n + F.size(_spans(line)))


def html_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def base64_plain(data: Column) -> Column:
    """Base64 without line breaks; null for no data or none of length."""
    return F.when(F.length(data) > 0, F.replace(F.base64(data), F.lit("\r\n"), F.lit("")))


def image_signature(ext: Column, pixel_width: Column, pixel_height: Column, content: Column) -> Column:
    """Kind, size in pixels (-1 if unknown) and a hash of the encoded payload's beginning."""
    payload = F.when(F.length(content) > 0, F.substring(F.sha1(F.substring(content, 1, SIGNED_PREFIX).cast("binary")), 1, 12)).otherwise(F.lit(""))
    unknown = F.lit(-1)
    return F.concat_ws("|", F.coalesce(ext, F.lit("")), F.coalesce(pixel_width, unknown).cast("string"), F.coalesce(pixel_height, unknown).cast("string"), payload)


def tagged_text(block: Column, page_width: Column, page_height: Column) -> Column:
    """The block's lines as ``<TEXT><LINE><TOP_LEFT>...``: runs of spans between wide gaps, each tagged by its place.

    Spans without box or text don't count; the others go by their left side, those
    of one left side in source order. The text is raw, with signs escaped.
    """
    lines = F.transform(F.coalesce(block["lines"], F.array()), lambda line: _tagged_line(line, page_width, page_height))
    return F.concat(F.lit("<TEXT>"), F.array_join(lines, ""), F.lit("</TEXT>"))


def _tagged_line(line: Column, page_width: Column, page_height: Column) -> Column:
    placed = F.transform(_spans(line), lambda s, i: F.struct(s["bbox"]["x0"].alias("x0"), i.alias("i"), s["bbox"].alias("b"), span_text(s).alias("t")))
    spans = F.array_sort(F.filter(placed, lambda s: g.complete(s["b"]) & (s["t"] != "")))
    none = F.array().cast(f"array<struct<b:{g.BOX},t:string>>")
    start = F.struct(none.alias("done"), F.lit(None).cast("double").alias("right"))

    def step(limit: Column):
        def add(acc: Column, s: Column) -> Column:
            done = acc["done"]
            last = F.element_at(done, -1)
            one = F.array(F.struct(s["b"].alias("b"), s["t"].alias("t")))
            longer = F.array(F.struct(g.union(last["b"], s["b"]).alias("b"), F.concat(last["t"], s["t"]).alias("t")))
            grown = F.when(F.size(done) == 0, one).when(s["b"]["x0"] - acc["right"] > limit, F.concat(done, one)).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), longer))
            return F.struct(grown.alias("done"), s["b"]["x1"].alias("right"))

        return add

    def emit(spans: Column) -> Column:
        heights = F.aggregate(spans, F.lit(0.0), lambda a, s: a + g.height(s["b"]))
        limit = F.greatest(F.lit(MIN_GAP), heights / F.greatest(F.size(spans), F.lit(1)) * F.lit(GAP_HEIGHTS))
        parts = F.aggregate(spans, start, step(limit))["done"]
        tags = F.transform(parts, lambda p: _tag(p, page_width, page_height))
        return F.when(F.size(spans) > 0, F.concat(F.lit("<LINE>"), F.array_join(tags, ""), F.lit("</LINE>"))).otherwise(F.lit(""))

    return F.element_at(F.transform(F.array(spans), emit), 1)  # binds the sorted spans to one name


def _tag(part: Column, page_width: Column, page_height: Column) -> Column:
    tag = g.coarse_position(part["b"], page_width, page_height)
    return F.concat(F.lit("<"), tag, F.lit(">"), html_escape(part["t"]), F.lit("</"), tag, F.lit(">"))


def chunk_label(kind: Column, layout: Column, coarse: Column, dynamic: Column, relative: Column) -> Column:
    """What an overlay writes at a chunk: kind, coarse place, zones and place among its siblings, where known."""
    head = F.when(kind == "group", F.when(layout == "horizontal", "G:H").otherwise("G:V")).otherwise(F.upper(kind))
    zones = F.concat(F.lit(" {x:"), dynamic["x_zone"], F.lit("/"), dynamic["x_zone_count"], F.lit(",y:"), dynamic["y_zone"], F.lit("/"), dynamic["y_zone_count"], F.lit("}"))
    some = lambda text, column: F.when(F.length(column) > 0, text).otherwise(F.lit(""))
    return F.concat(head, some(F.concat(F.lit(" ["), coarse, F.lit("]")), coarse), F.coalesce(zones, F.lit("")), some(F.concat(F.lit(" <"), relative, F.lit(">")), relative))


#: The colours of an overlay.
COLOURS = {"text": "#0066cc", "image": "#009933", "table": "#cc0000", "horizontal": "#ff8c00", "vertical": "#9933ff", "connector": "#505050", "other": "#000000"}


def chunk_colour(kind: Column, layout: Column) -> Column:
    colour = F.when((kind == "group") & (layout == "horizontal"), COLOURS["horizontal"]).when(kind == "group", COLOURS["vertical"])
    for name in ("text", "image", "table"):
        colour = colour.when(kind == name, COLOURS[name])
    return colour.otherwise(COLOURS["other"])
