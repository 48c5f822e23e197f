"""Flat, linked tables from deeply nested records.

Each record is parsed into path-value-ordinal triples. A triple's path is parted
at its last repeated ancestor (an array of objects); triples of one ancestor and
one list of ordinals make up one row, and all rows of one ancestor one table. An
array of the recursive key counts as its parent's table, so a tree of any depth
is one table whose rows name their parent by its ordinals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from json.decoder import scanstring
from json.scanner import NUMBER_RE

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANKS = " \t\n\r"
_BLANK = re.compile(f"[{_BLANKS}]*").match


@dataclass(frozen=True)
class RecordShape:
    """Where a record's rows are: ``outer`` below the root, ``item`` in each, ``child`` in each item."""

    outer: str = "pages"
    item: str = "chunks"
    child: str = "children"

    #: An array of objects in each item.
    notes_key: str = "annotations"

    @property
    def items(self) -> str:
        return f"{self.outer}.{self.item}"

    @property
    def notes(self) -> str:
        return f"{self.items}.{self.notes_key}"

    def inside(self, table: str) -> bool:
        return table == self.outer or table.startswith(f"{self.outer}.")

    def alone(self, ancestor: str, leaf: str) -> bool:
        """Whether an object may stand here for an array of one."""
        return (ancestor, leaf) in (("", self.outer), (self.outer, self.item), (self.items, self.child))

    def below(self, ancestor: str, leaf: str) -> str:
        """The name of the table of the array ``leaf`` of ``ancestor``."""
        if (ancestor, leaf) == (self.items, self.child):
            return ancestor
        return f"{ancestor}.{leaf}" if ancestor else leaf


class _Open:
    """An object or array that hasn't ended yet, and where its values go."""

    __slots__ = ("fields", "index", "is_object", "keys", "kept", "leaf", "ordinals", "start", "table")

    def __init__(self, is_object: bool, table: str, ordinals: tuple[int, ...], fields: dict | None, leaf: str, start: int):
        self.is_object, self.table, self.ordinals, self.fields, self.leaf, self.start = is_object, table, ordinals, fields, leaf, start
        self.index, self.kept = 0, leaf
        self.keys: dict[str, tuple] = {}


def read_record(body: str | None, shape: RecordShape) -> list[tuple[str, tuple[int, ...], dict[str, str | None]]]:
    """``table, ordinals, fields`` of each object in an array, parents before children; none if ``body`` isn't a valid JSON object.

    One pass over the text as a stream of tokens: each scalar is a triple of its
    path below the last repeated ancestor, its value as text and that ancestor's
    ordinals, and is put where it belongs at once. No tree is built, and open
    objects are on a stack of their own, so that no depth is too large. Numbers keep their text; an array
    in an array is one value, its JSON.
    """
    rows: list = []
    if body is None:
        return rows
    try:
        _read(body, shape, rows)
    except (ValueError, IndexError):
        return []
    return [r for r in rows if r]


def _after_blanks(body: str, at: int) -> int:
    return _BLANK(body, at).end()


def _forget(box: _Open, key: str, rows: list) -> None:
    """Undoes what an earlier value of ``key`` in this object gave: of repeated keys the last holds."""
    row_from, row_to, paths = box.keys.pop(key)
    rows[row_from:row_to] = [None] * (row_to - row_from)
    if box.fields is not None:
        for path in [p for p in box.fields if p in paths or p.startswith((f"{paths[0]}.", f"{paths[0]}["))]:
            del box.fields[path]


def _read(body: str, shape: RecordShape, rows: list) -> None:
    """Fills ``rows`` from ``body``; ValueError or IndexError if it isn't valid."""
    at = _after_blanks(body, 0)
    if body[at] != "{":
        return
    root: dict = {}
    rows.append(("", (), root))
    box = _Open(True, "", (), root, "", at)
    stack = [box]
    at = _after_blanks(body, at + 1)
    first = True
    while True:
        # an object or array is open: its next key and value, or its end
        ch = body[at]
        if ch == ("}" if box.is_object else "]"):
            if not first and body[_last_sign(body, at)] == ",":
                raise ValueError
            at += 1
            stack.pop()
            if not stack:
                if _after_blanks(body, at) != len(body):
                    raise ValueError
                return
            ended, box = box, stack[-1]
            if ended.fields is None and box.fields is not None:  # an array in an array
                box.fields[f"{box.leaf}[{box.index}]"] = body[ended.start : at]
        else:
            if box.is_object:
                if ch != '"':
                    raise ValueError
                key, at = scanstring(body, at + 1, True)
                if body[at] != ":":
                    at = _after_blanks(body, at)
                    if body[at] != ":":
                        raise ValueError
                at += 1
                leaf = f"{box.kept}.{key}" if box.kept else key
                if key in box.keys:
                    _forget(box, key, rows)
                box.keys[key] = (len(rows), len(rows), (leaf,))
                box.leaf = leaf
                ch = body[at]
                if ch in _BLANKS:
                    at = _after_blanks(body, at)
                    ch = body[at]
            else:
                leaf = ""
            fields = box.fields
            if ch == '"':
                value, at = scanstring(body, at + 1, True)
            elif ch == "{":
                inner = _enter_object(box, shape, rows, at)
                stack.append(inner)
                box, first = inner, True
                at = _after_blanks(body, at + 1)
                continue
            elif ch == "[":
                inner = _Open(False, box.table, box.ordinals, fields if box.is_object else None, box.leaf, at)
                stack.append(inner)
                box, first = inner, True
                at = _after_blanks(body, at + 1)
                continue
            elif m := NUMBER_RE.match(body, at):
                value, at = m.group(), m.end()
            elif body.startswith("null", at):
                value, at = None, at + 4
            elif body.startswith("true", at):
                value, at = "true", at + 4
            elif body.startswith("false", at):
                value, at = "false", at + 5
            else:
                raise ValueError
            if fields is not None:
                if box.is_object:
                    fields[leaf] = value
                elif value is not None:
                    fields[f"{box.leaf}[{box.index}]"] = value
        # a value has ended: what follows it
        if box.is_object:
            key_from = next(reversed(box.keys))
            if (now := len(rows)) != box.keys[key_from][1]:
                box.keys[key_from] = (box.keys[key_from][0], now, box.keys[key_from][2])
        else:
            box.index += 1
        first = False
        ch = body[at]
        if ch in _BLANKS:
            at = _after_blanks(body, at)
            ch = body[at]
        if ch == ",":
            at = _after_blanks(body, at + 1)
        elif ch != ("}" if box.is_object else "]"):
            raise ValueError


def _last_sign(body: str, at: int) -> int:
    at -= 1
    while body[at] in _BLANKS:
        at -= 1
    return at


def _enter_object(box: _Open, shape: RecordShape, rows: list, at: int) -> _Open:
    """An object that begins: a row of its own as an array's element or where it stands for an array of one, else part of its row."""
    if box.fields is None:
        return _Open(True, box.table, box.ordinals, None, "", at)
    if box.is_object and not shape.alone(box.table, box.leaf):
        return _Open(True, box.table, box.ordinals, box.fields, box.leaf, at)
    fields: dict = {}
    table, ordinals = shape.below(box.table, box.leaf), (*box.ordinals, box.index if not box.is_object else 0)
    rows.append((table, ordinals, fields))
    return _Open(True, table, ordinals, fields, "", at)


def flatten_records(df: DataFrame, id_col: str = "record_id", body_col: str = "body", shape: RecordShape = RecordShape(), with_fields: bool = True) -> DataFrame:
    """``id_col, table_name, page_number, node_path, parent_path, ordinal, fields``: one row for each object in an array.

    ``table_name`` is the path of the array (the root's is empty). ``node_path`` is
    the ordinals below the page, each as four digits, joined by dots; the page
    itself has the empty path. Outside the pages it is all ordinals.
    ``parent_path`` is that of the enclosing object, ``''`` at the top. ``fields`` maps each path below the object to its value as
    text, a string as it is and anything else as JSON.

    A null or invalid body, or one that isn't an object, gives no rows. A null
    among an array's elements takes up an ordinal and gives no row. An object
    where ``shape`` expects an array counts as an array of one. Repeated records
    give repeated rows; of a key repeated in one object the last value holds.
    Other columns of ``df`` aren't read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list[int] = []
            out: list[tuple] = []
            for i, body in enumerate(batch.column(1).to_pylist()):
                read = read_record(body, shape)
                numbers = {ordinals: _int(fields.get("page_number")) for table, ordinals, fields in read if table == shape.outer}
                for table, ordinals, fields in read:
                    inside = shape.inside(table)
                    inner = [f"{x:04d}" for x in (ordinals[1:] if inside else ordinals)]
                    ids.append(i)
                    out.append((table, numbers.get(ordinals[:1]) if inside else None, ".".join(inner), ".".join(inner[:-1]), ordinals[-1] if ordinals else 0, ordinals[0] if inside and ordinals else None, fields))
                if len(out) > 20_000:
                    yield _batch(batch, ids, out, with_fields)
                    ids, out = [], []
            yield _batch(batch, ids, out, with_fields)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, table_name string, page_number int, node_path string, parent_path string, ordinal int, page_index int" + ", fields map<string,string>" * with_fields
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{body_col}`").alias("body"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _int(text: str | None) -> int | None:
    try:
        return int(float(text)) if text is not None else None
    except (ValueError, OverflowError):
        return None


def _strings(values: list[str | None]) -> pa.Array:
    """An array of texts; halves of surrogate pairs, which JSON may name but no text may hold, become question marks."""
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:
        return pa.array([None if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _batch(batch: pa.RecordBatch, ids: list[int], out: list[tuple], with_fields: bool) -> pa.RecordBatch:
    names = ["id", "table_name", "page_number", "node_path", "parent_path", "ordinal", "page_index"]
    kinds = [None, pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    columns = list(zip(*out, strict=True)) if out else [()] * 7
    arrays = [batch.column(0).take(pa.array(ids, pa.int64())), *(pa.array(c, k) if k else _strings(list(c)) for c, k in zip(columns, kinds, strict=False))]
    if with_fields:
        ends = [0]
        for fields in columns[6]:
            ends.append(ends[-1] + len(fields))
        keys, values = [k for fields in columns[6] for k in fields], [v for fields in columns[6] for v in fields.values()]
        arrays.append(pa.MapArray.from_arrays(pa.array(ends, pa.int32()), _strings(keys), _strings(values)))
        names.append("fields")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _number(name: str) -> Column:
    return F.expr(f"try_cast(fields['{name}'] AS double)")


def _box() -> Column:
    """The box, whether given as an object or as an array of four; numbers may be strings."""
    sides = [F.coalesce(_number(f"bbox.{side}"), _number(f"bbox[{i}]")).alias(side) for i, side in enumerate(("x0", "y0", "x1", "y1"))]
    return F.struct(*sides).alias("bbox")


def _rest(taken: list[str], numbers: dict[str, str]) -> Column:
    """The fields that no column holds: those not ``taken``, and numbers whose text isn't of the column's type."""
    lost = [F.expr(f"fields['{name}'] is not null and try_cast(fields['{name}'] AS {kind}) is null") for name, kind in numbers.items()]
    kept = F.array_compact(F.array(*(F.when(bad, name) for name, bad in zip(numbers, lost, strict=True)))) if numbers else F.array().cast("array<string>")
    listed = F.array(*map(F.lit, [*taken, *numbers]))
    return F.map_filter("fields", lambda k, _: ~F.array_contains(listed, k) | F.array_contains(kept, k)).alias("rest")


_BOX_FIELDS = {**{f"bbox.{s}": "double" for s in ("x0", "y0", "x1", "y1")}, **{f"bbox[{i}]": "double" for i in range(4)}}


def record_table(flat: DataFrame, id_col: str = "record_id") -> DataFrame:
    """One row for each record, with all fields outside arrays of objects."""
    return flat.where("table_name = ''").select(id_col, "fields")


def page_table(flat: DataFrame, id_col: str = "record_id", shape: RecordShape = RecordShape()) -> DataFrame:
    """One row for each page object; ``rest`` has the fields without a column."""
    number = F.map_filter("fields", lambda k, v: (k == "page_number") & v.isNotNull() & F.col("page_number").isNull())
    rest = F.map_concat(_rest(["page_number"], {"width": "double", "height": "double", "debug.atom_count": "int"}), number).alias("rest")
    return flat.where(F.col("table_name") == shape.outer).select(id_col, "page_index", "page_number", _number("width").alias("width"), _number("height").alias("height"), F.expr("try_cast(fields['debug.atom_count'] AS int)").alias("atom_count"), rest)


def _own(groups: bool | None) -> list[Column]:
    """The columns that groups, leaves or (None) both have besides those of any chunk."""
    text = lambda name: F.expr(f"fields['{name}']").alias(name)
    leaf = [text("content"), text("mime_type"), F.expr("try_cast(fields['debug.line_count'] AS int)").alias("line_count"), F.expr("fields['debug.dropped_reason']").alias("dropped_reason")]
    return [*([text("layout")] if groups in (True, None) else []), *(leaf if groups in (False, None) else [])]


def node_table(flat: DataFrame, groups: bool | None, id_col: str = "record_id", shape: RecordShape = RecordShape()) -> DataFrame:
    """One row for each chunk object: the groups, the leaves (all others), or with None both; ``rest`` has the fields without a column."""
    is_group = F.coalesce(F.expr("fields['type']"), F.lit("")) == "group"
    taken = ["type", *(["layout"] if groups in (True, None) else []), *(["content", "mime_type", "debug.dropped_reason"] if groups in (False, None) else [])]
    numbers = {"chunk_index": "int", "size_normalized.w": "double", "size_normalized.h": "double"} | _BOX_FIELDS | ({"debug.line_count": "int"} if groups in (False, None) else {})
    nodes = flat.where(F.col("table_name") == shape.items)
    return (nodes if groups is None else nodes.where(is_group if groups else ~is_group)).select(
        id_col, "page_index", "page_number", "node_path", "parent_path", "ordinal", F.expr("try_cast(fields['chunk_index'] AS int)").alias("chunk_index"), F.expr("fields['type']").alias("type"),
        _box(), _number("size_normalized.w").alias("w"), _number("size_normalized.h").alias("h"), *_own(groups), _rest(taken, numbers),
    )


def found_nodes(flat: DataFrame, id_col: str = "record_id") -> DataFrame:
    """``id_col, page_number, node_path, parent_path`` of the pivoted table of groups and leaves."""
    return node_table(flat, None, id_col).select(id_col, "page_number", "node_path", "parent_path")


_TAG = r"^tags\[[0-9]+\]$"


def note_table(flat: DataFrame, id_col: str = "record_id", shape: RecordShape = RecordShape()) -> DataFrame:
    """One row for each annotation; ``parent_path`` is its chunk's ``node_path``.

    Each tag has its place, as nulls among them take one up. ``rest`` has the
    fields without a column.
    """
    tags = F.transform(F.filter(F.map_entries("fields"), lambda e: e["key"].rlike(_TAG)), lambda e: F.struct(F.regexp_extract(e["key"], "[0-9]+", 0).cast("int").alias("ordinal"), e["value"].alias("tag")))
    rest = F.map_filter(_rest(["kind"], _BOX_FIELDS), lambda k, _: ~k.rlike(_TAG)).alias("rest")
    return flat.where(F.col("table_name") == shape.notes).select(id_col, "page_index", "page_number", "node_path", "parent_path", "ordinal", F.expr("fields['kind']").alias("kind"), _box(), tags.alias("tags"), rest)


def rest_table(flat: DataFrame, id_col: str = "record_id", shape: RecordShape = RecordShape()) -> DataFrame:
    """One row for each field that no column of the tables of pages, groups, leaves and annotations holds: its path below its object, and its value as text."""
    tables = [page_table(flat, id_col, shape).withColumn("node_path", F.lit("")), node_table(flat, True, id_col, shape), node_table(flat, False, id_col, shape), note_table(flat, id_col, shape)]
    rows = None
    for name, of in zip((shape.outer, shape.items, shape.items, shape.notes), tables, strict=True):
        part = of.select(id_col, F.lit(name).alias("table_name"), "page_index", "node_path", F.explode("rest").alias("path", "value"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def other_table(flat: DataFrame, id_col: str = "record_id", shape: RecordShape = RecordShape()) -> DataFrame:
    """One row for each object of any array without a table of its own, under the array's name."""
    return flat.where(~F.col("table_name").isin("", shape.outer, shape.items, shape.notes)).select(id_col, "table_name", "page_index", "page_number", "node_path", "parent_path", "ordinal", "fields")
