"""Nested records against a plain recursion, and odd bodies."""

import json
import random

import pytest

from pagegrain.operators import nested


def walk(node, path=""):
    """Paths of chunk objects below a value of ``chunks`` or ``children``."""
    items = [node] if isinstance(node, dict) else node if isinstance(node, list) else []
    for i, x in enumerate(items):
        if isinstance(x, dict):
            here = f"{path}.{i:04d}".lstrip(".")
            yield here
            yield from walk(x.get("children"), here)


def expected(body):
    pages = body.get("pages")
    for page in [pages] if isinstance(pages, dict) else pages or []:
        if isinstance(page, dict):
            for path in walk(page.get("chunks")):
                yield page["page_number"], path


def tree(rng, depth):
    def value():
        return rng.choice([None, "x", 'a "b" {', 1.5, True, {"x0": 1, "deep": [1, 2]}, [1, 2.5], [{"children": [{}]}], {"chunks": [{"type": "no chunk"}]}])

    node = {k: value() for k in rng.sample(["type", "bbox", "content", "annotations", "debug", "odd"], rng.randrange(6))}
    if depth and rng.random() < 0.7:
        children = [rng.choice([None, tree(rng, depth - 1), tree(rng, depth - 1)]) for _ in range(rng.randrange(4))]
        node["children"] = rng.choice([children, children, tree(rng, depth - 1), None])
    return node


def test_same_as_recursion(spark):
    rng = random.Random(4)
    bodies = [{"pages": [{"page_number": rng.randrange(9), "chunks": [tree(rng, 6) for _ in range(3)]} for _ in range(2)]} for _ in range(60)]
    bodies += [{"pages": {"page_number": 3, "chunks": tree(rng, 3)}}, {"meta": {"chunks": [{}]}, "pages": None}, {}]
    df = spark.createDataFrame([(i, json.dumps(b), "extra") for i, b in enumerate(bodies)], "record_id long, body string, id string")
    got = {}
    for r in nested.flatten_records(df, with_fields=False).where("table_name = 'pages.chunks'").collect():
        got.setdefault(r.record_id, []).append((r.page_number, r.node_path))
        assert r.parent_path == r.node_path[:-5]
    for i, body in enumerate(bodies):
        assert sorted(got.get(i, [])) == sorted(expected(body))


def deep(n):
    return '{"pages":[{"page_number":1,"chunks":[' + '{"children":[' * n + "{}" + "]}" * n + "]}]}"


@pytest.mark.parametrize("body", [None, "", "{", '{"pages": NaN}', '[{"pages": []}]', '"text"', '{"pages": [{"page_number": 1, "chunks": [{]}]}', '{"a": 1} x'])
def test_bodies_without_rows(spark, body):
    df = spark.createDataFrame([(1, body)], "record_id long, body string")
    assert nested.flatten_records(df).where("table_name <> ''").count() == 0


def read(body):
    return nested.read_record(body, nested.RecordShape())


def test_very_deep_record_and_long_integer():
    assert sum(t == nested.RecordShape().items for t, _, _ in read(deep(20_000))) == 20_001
    assert read('{"a": ' + "9" * 5000 + "}") == [("", (), {"a": "9" * 5000})]
    assert read('{"a": ' + "[" * 20_000 + "]" * 20_000 + "}") == [("", (), {"a[0]": "[" * 19_999 + "]" * 19_999})]


@pytest.mark.parametrize("body", ['{"a": [1, 2}', '{"a": 1} x', "{", '{"a": 1,}', '{"a": [1,]}', "{,}", '{"a": [,1]}', '{"a": [1 2]}', '{"a": tru}', '{"a": -}', '{"a": 01}', '{"a": "\n"}', '{"a"}', '{"a": }', "[1]", "1", ""])
def test_invalid_records_have_no_rows(body):
    assert read(body) == []


def test_tokens():
    assert read(' {"a" : [1, {"b": "\\u00e9"}, [2, {"c" : 3}], {}, null, true] , "d":{"e":1.50,"f":{}}} ') == [
        ("", (), {"a[0]": "1", "a[2]": '[2, {"c" : 3}]', "a[5]": "true", "d.e": "1.50"}), ("a", (1,), {"b": "é"}), ("a", (3,), {}),
    ]


def test_the_last_of_repeated_keys_holds():
    assert read('{"a": {"b": 2, "c": [1]}, "d": 3, "a": 1}') == [("", (), {"d": "3", "a": "1"})]
    assert read('{"a": 1, "a": {"b": 2}}') == [("", (), {"a.b": "2"})]
    assert read('{"pages": [{"x": 1}, {"chunks": [{}]}], "z": 0, "pages": {"page_number": 4}, "y": [{}]}') == [("", (), {"z": "0"}), ("pages", (0,), {"page_number": "4"}), ("y", (0,), {})]


def test_random_records_as_by_a_parsed_tree():
    rng = random.Random(9)

    def fields(value, path=""):
        if isinstance(value, dict):
            for k, v in value.items():
                yield from fields(v, f"{path}.{k}" if path else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                if isinstance(v, list):
                    yield f"{path}[{i}]", json.dumps(v)
                elif v is not None and not isinstance(v, dict):
                    yield f"{path}[{i}]", v if isinstance(v, str) else json.dumps(v)
        else:
            yield path, value if value is None or isinstance(value, str) else json.dumps(value)

    for _ in range(300):
        body = {"pages": {"page_number": 1, "chunks": tree(rng, 4)}, **{k: rng.choice([1, "ü", None, [[1, "a"], 2], {"q": {"r": [None, False]}}]) for k in rng.sample("abcd", 3)}}
        top = {k: v for k, v in body.items() if k != "pages"}
        assert dict(read(json.dumps(body))[0][2]) == dict(fields(top))


def test_half_a_surrogate_pair(spark):
    df = spark.createDataFrame([(1, '{"pages": [{"page_number": 1, "a": "\\ud800"}]}')], "record_id long, body string")
    assert nested.flatten_records(df).where("table_name = 'pages'").first().fields["a"] == "?"


def test_fields_without_a_column_are_rows(spark):
    body = {"pages": [{"page_number": 2, "skew": 1.5, "chunks": [{"type": "group", "odd": "x", "children": [{"type": "text", "odd": {"y": [7]}, "annotations": [{"by": "z"}]}]}]}]}
    flat = nested.flatten_records(spark.createDataFrame([(7, json.dumps(body))], "record_id long, body string"))
    assert sorted(tuple(r)[1:] for r in nested.rest_table(flat).collect()) == [("pages", 0, "", "skew", "1.5"), ("pages.chunks", 0, "0000", "odd", "x"), ("pages.chunks", 0, "0000.0000", "odd.y[0]", "7"), ("pages.chunks.annotations", 0, "0000.0000.0000", "by", "z")]
    assert sorted(tuple(r) for r in nested.found_nodes(flat).collect()) == [(7, 2, "0000", ""), (7, 2, "0000.0000", "0000")]


def test_tables(spark):
    body = {"pages": [{"page_number": 2, "width": 10, "height": 20, "debug": {"atom_count": 1}, "chunks": [{"type": "group", "bbox": [1, 2, 3, "4"], "layout": "vertical", "children": [None, {"type": "text", "bbox": {"x0": "1.5"}, "content": "é\n", "annotations": [{"kind": "mark"}]}]}]}]}
    flat = nested.flatten_records(spark.createDataFrame([(7, json.dumps(body))], "record_id long, body string"))
    page, group, leaf = nested.page_table(flat).first(), nested.node_table(flat, True).first(), nested.node_table(flat, False).first()
    assert (page.page_number, page.width, page.atom_count) == (2, 10.0, 1)
    assert (group.node_path, group.parent_path, group.layout, group.bbox.y1) == ("0000", "", "vertical", 4.0)
    assert (leaf.node_path, leaf.parent_path, leaf.content, leaf.bbox.x0, leaf.bbox.y0) == ("0000.0001", "0000", "é\n", 1.5, None)
    assert flat.where("table_name = 'pages.chunks.annotations'").first().fields == {"kind": "mark"}


def test_tables_hold_every_field(spark):
    notes = [None, {"kind": "mark", "bbox": [1, "2", 3, "wide"], "tags": ["a", None, "b"], "by": {"name": "x"}, "links": [{"to": 1}]}]
    chunk = {"type": "text", "content": "c", "chunk_index": "two", "odd": {"deep": [1]}, "layout": "x", "annotations": notes}
    page = {"page_number": "p", "width": 10, "skew": 1.5, "chunks": [{"type": "group", "content": "g", "children": [chunk]}], "marks": [{"at": 3}]}
    body = {"meta": {"title": "t", "by": [{"name": "n", "roles": [{"r": 1}, {"r": 2}]}]}, "pagesets": [{"n": 1}], "pages": [None, page]}
    flat = nested.flatten_records(spark.createDataFrame([(7, json.dumps(body))], "record_id long, body string"))
    assert nested.record_table(flat).first().fields == {"meta.title": "t"}
    assert nested.page_table(flat).first().rest == {"skew": "1.5", "page_number": "p"}
    assert nested.node_table(flat, True).first().rest == {"content": "g"}
    leaf = nested.node_table(flat, False).first()
    assert leaf.rest == {"chunk_index": "two", "odd.deep[0]": "1", "layout": "x"}
    (note,) = nested.note_table(flat).collect()
    assert (note.record_id, note.page_index, note.parent_path, note.ordinal, note.kind) == (7, leaf.page_index, leaf.node_path, 1, "mark")
    assert tuple(note.bbox) == (1.0, 2.0, 3.0, None) and [tuple(t) for t in note.tags] == [(0, "a"), (2, "b")]
    assert note.rest == {"bbox[3]": "wide", "by.name": "x"}
    others = {(r.table_name, r.page_index, r.node_path, r.parent_path): r.fields for r in nested.other_table(flat).collect()}
    assert others == {
        ("meta.by", None, "0000", ""): {"name": "n"}, ("meta.by.roles", None, "0000.0000", "0000"): {"r": "1"}, ("meta.by.roles", None, "0000.0001", "0000"): {"r": "2"}, ("pagesets", None, "0000", ""): {"n": "1"},
        ("pages.marks", 1, "0000", ""): {"at": "3"}, ("pages.chunks.annotations.links", 1, f"{note.node_path}.0000", note.node_path): {"to": "1"},
    }


def test_empty_table(spark):
    assert nested.flatten_records(spark.createDataFrame([], "record_id long, body string")).count() == 0
