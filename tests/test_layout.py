"""Cuts, trees, zones and parsing: hand-made pages, properties, and the two ways of cutting against each other."""

import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagegrain.functions import geometry as g
from pagegrain.functions import text as t
from pagegrain.operators import atoms, intervals, layout, nested, overlay, views
from pagegrain.plans import parse, queries
from pagegrain.sources import raw as sources

RECT = [0.0, 0.0, 600.0, 800.0]
BLOCK = {"block_no": 0, "type": 0, "bbox": None, "lines": None, "ext": None, "width": None, "height": None, "image": None}


def cut(*boxes):
    return layout.cut_page(RECT, [[float(b[k]) for b in boxes] for k in range(4)])


def text_block(no, bbox, text="words"):
    return BLOCK | {"block_no": no, "bbox": dict(zip(g.SIDES, map(float, bbox), strict=True)), "lines": [{"spans": [{"bbox": dict(zip(g.SIDES, map(float, bbox), strict=True)), "text": text, "chars": None}]}]}


def image_block(no, bbox, image=b"x", **own):
    return BLOCK | {"block_no": no, "type": 1, "bbox": dict(zip(g.SIDES, map(float, bbox), strict=True)), "ext": "PNG", "width": 3, "height": 4, "image": image} | own


def raw(spark, blocks=None, tables=None, rect=(0, 0, 600, 800), number=1):
    row = ("d", number, dict(zip(g.SIDES, map(float, rect), strict=True)), blocks, tables)
    return spark.createDataFrame([row], sources.RAW_PAGES)


def types(pages):
    return [a["type"] for a in pages.first()["atoms"]]


def test_empty_page_and_lone_box():
    assert layout.cut_page(RECT, [[], [], [], []]) == []
    (node,) = cut((10, 10, 20, 20))
    assert node["path"] == "0000" and node["parent_layout"] is None


def test_equal_scores_cut_upright():
    nodes = layout.cut_page([0.0, 0.0, 600.0, 600.0], [[0.0, 400.0], [0.0, 400.0], [200.0, 600.0], [200.0, 600.0]])
    assert nodes[0]["layout"] == "horizontal"


def test_margin_gap_falls_back():
    nodes = cut((-300, 100, -200, 140), (100, 100, 500, 140))
    assert nodes[0]["layout"] == "vertical" and len(nodes) == 3


def test_members_of_fallback_groups_of_any_size_are_marked():
    fell_back = lambda *bs: [n["path"] for n in cut(*bs) if n["parent_fell_back"]]
    assert fell_back((100, 100, 300, 200), (100.25, 100, 300.25, 200)) == ["0000.0000", "0000.0001"]
    assert fell_back((100, 100, 300, 200), (100, 600, 300, 700)) == []
    assert fell_back((100, 100, 300, 200), (100.25, 100, 300.25, 200), (100, 600, 300, 700)) == ["0000.0000.0000", "0000.0000.0001"]


def test_fallback_flow_has_groups_of_two(spark, tmp_path):
    import datetime

    # a table that fills its page's middle, and its echo: no cut parts the two
    when = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(5, when, 1, "error", 3.0)], "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = queries.fallback_flow(spark, str(tmp_path)).collect()
    assert sorted((r.path, r.id, r.ordinal) for r in got) == [("0000.0000", 5, 0), ("0000.0001", 1_000_000_005, 1)]


def test_box_without_area_is_lost_by_a_cut():
    kept = [n["atom_no"] for n in cut((0, 0, 100, 50), (0, 25, 100, 25), (0, 700, 100, 790)) if n["atom_no"] is not None]
    assert kept == [0, 2]


def test_cuts_end_at_the_depth_bound():
    height = 2.0**20
    boxes, low = [], 0.0
    for _ in range(15):
        boxes.append((0, low, 10, low + (height - low) * 0.45))
        low += (height - low) * 0.5
    nodes = layout.cut_page([0.0, 0.0, 10.0, height], np.array(boxes).T.tolist())
    assert max(n["depth"] for n in nodes) == 14 and sum(n["atom_no"] is not None for n in nodes) == 15


coordinate = st.integers(-40, 2600).map(lambda x: x / 4)
boxes = st.lists(st.tuples(coordinate, coordinate, st.integers(0, 400), st.integers(0, 400)).map(lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3])), min_size=1, max_size=14)


@settings(max_examples=150, deadline=None)
@given(boxes)
def test_tree_properties(bs):
    bs = sorted(bs, key=lambda b: (b[1], b[0]))
    nodes = cut(*bs)
    by_path = {n["path"]: n for n in nodes}
    assert [n["path"] for n in nodes] == sorted(by_path)
    leaves = [n["atom_no"] for n in nodes if n["atom_no"] is not None]
    assert len(leaves) == len(set(leaves)) and set(leaves) <= set(range(len(bs)))
    for n in nodes:
        children = [c for c in nodes if c["parent_path"] == n["path"]]
        assert (n["layout"] is None) == (not children) == (n["atom_no"] is not None)
        if n["layout"] == "horizontal":
            assert len(children) == 2 and children[0]["bbox"]["x0"] <= children[1]["bbox"]["x0"]
        for c in children:
            assert c["bbox"]["x0"] >= n["bbox"]["x0"] and c["bbox"]["y1"] <= n["bbox"]["y1"]


def test_kernel_and_expressions_cut_alike(spark):
    rng = np.random.default_rng(5)
    pages = []
    for k in range(120):
        low = rng.integers(0, 2000, (2, rng.integers(1, 12))) / 4
        size = rng.integers(1, 600, low.shape) / 4
        pages.append((k, [dict(zip(g.SIDES, (float(x), float(y), float(x + w), float(y + h)), strict=True)) for (x, y), (w, h) in zip(low.T, size.T, strict=True)]))
    df = spark.createDataFrame(pages, f"page int, bs array<{g.BOX}>")
    for axis, end in (("vertical", 600.0), ("horizontal", 800.0)):
        df = df.withColumn(axis, intervals.occupied(F.col("bs"), F.lit(0.0), F.lit(end), axis))
        df = df.withColumn(axis, intervals.gaps(F.col(axis), F.lit(0.0), F.lit(end))).withColumn(axis, intervals.scored(F.col("bs"), F.col(axis), F.lit(end), axis))
    got = {r.page: r.c and (0 if r.c.axis == "vertical" else 1, r.c.s, r.c.e) for r in df.select("page", intervals.best_cut(F.col("vertical"), F.col("horizontal")).alias("c")).collect()}
    for k, bs in pages:
        sides = [[b[s] for b in bs] for s in g.SIDES]
        assert layout.PageBoxes(sides).best_cut(list(range(len(bs))), RECT) == got[k]


def test_geometry_edges(spark):
    box = lambda *s: g.box(*(F.lit(float(x)) for x in s))
    a, beside, inverted = box(0, 0, 10, 10), box(10, 0, 20, 10), box(10, 10, 0, 0)
    null = F.lit(None).cast(g.BOX)
    r = spark.range(1).select(
        g.intersects(a, beside).alias("touch"), g.intersection(a, beside).alias("none"), g.area(inverted).alias("inverted"), g.overlap_ratio(inverted, a).alias("ratio"), g.iou(inverted, inverted).alias("iou"),
        g.coarse_position(box(198, 528, 198, 528), F.lit(600.0), F.lit(800.0)).alias("edge"), g.area(null).alias("null_area"), g.width(null).alias("null_width"),
    ).first()
    assert tuple(r) == (False, None, 0.0, 0.0, 0.0, "BOTTOM_CENTER", None, None)


@pytest.mark.parametrize(
    ("text", "clean"),
    [("a\r\x00\nb", "a\n\nb"), ("\n\n  a \t\n\n\n\n b\n", "  a\n\n b"), ("a 　\nb​", "a\nb​"), ("", ""), ("\r\n\r", ""), (None, None)],
)
def test_normalize(spark, text, clean):
    assert spark.createDataFrame([(text,)], "t string").select(t.normalize(F.col("t")).alias("t")).first().t == clean


def test_table_text_is_dropped_and_padding_overflows(spark):
    page = raw(spark, [text_block(0, (105, 105, 150, 120)), text_block(1, (10, 10, 50, 20)), text_block(2, (10, 30, 50, 40), " \t")], [{"table_no": 0, "bbox": dict(zip(g.SIDES, (1.0, 100.0, 600.0, 200.0), strict=True)), "png": None}])
    found = atoms.page_atoms(page).first()["atoms"]
    assert [a["type"] for a in found] == ["text", "table"]
    assert found[1]["bbox"].x0 == 0.0 and found[1]["bbox"].x1 == 602.0


def test_images_without_payload_are_more_alike(spark):
    page = raw(spark, [image_block(0, (10, 10, 60, 60), b"a"), image_block(1, (10, 10, 60, 60), b"b"), image_block(2, (300, 10, 350, 60), None)])
    assert types(atoms.page_atoms(page)) == ["image"] * 3
    assert types(atoms.page_atoms(page, include_image_base64=False)) == ["image"] * 2


def test_background_images(spark):
    edge = image_block(0, (3, 3, 597, 797))
    covered = image_block(1, (0, 0, 600, 560))
    assert types(atoms.page_atoms(raw(spark, [edge]))) == []
    assert types(atoms.page_atoms(raw(spark, [edge]), skip_background_images=False)) == ["image"]
    assert types(atoms.page_atoms(raw(spark, [covered]))) == ["image"]
    assert types(atoms.page_atoms(raw(spark, [covered, text_block(2, (0, 0, 600, 330))]))) == ["text"]


def test_null_fields_and_empty_pages(spark):
    blocks = [BLOCK, BLOCK | {"bbox": dict(zip(g.SIDES, (1.0, 1.0, 9.0, 9.0), strict=True))}, None, text_block(3, (10, 10, 50, 20), "")]
    for page in (raw(spark), raw(spark, [], []), raw(spark, blocks, [None, {"table_no": 1, "bbox": None, "png": None}])):
        chunks, pages = parse.parse_document(page)
        assert chunks.count() == 0 and pages.first().atom_count == 0
        assert views.page_text(chunks, pages).first().text == ""
        assert json.loads(views.page_json(chunks, pages).first().json)["chunks"] == []
        assert overlay.render_svg(chunks, pages).first().svg.endswith("></svg>")
    part = dict(zip(g.SIDES, (1.0, None, 9.0, 9.0), strict=True))
    odd = spark.createDataFrame([("d", None, part, [text_block(0, (1, 1, 9, 9)), BLOCK | {"bbox": part, "lines": [{"spans": [{"bbox": part, "text": "x", "chars": None}, None]}, None, {"spans": None}]}], [{"table_no": 0, "bbox": part, "png": None}])], sources.RAW_PAGES)
    chunks, pages = parse.parse_document(odd)
    assert [(r.content, r.absolute_position_coarse) for r in chunks.collect()] == [("words", "BOTTOM_RIGHT")] and pages.first().atom_count == 1
    assert len(overlay.svg_of_pages(layout.with_chunks(parse.parsed_pages(odd))).first().svg) > 100
    none = raw(spark).limit(0)
    assert parse.parse_document(none)[0].count() == 0


def test_ties_keep_source_order(spark):
    same = (10, 10, 50, 20)
    found = atoms.page_atoms(raw(spark, [text_block(0, same, "b"), text_block(1, same, "a")])).first()["atoms"]
    assert [a["content"] for a in found] == ["b", "a"]


def test_flat_and_grouped_indexes(spark):
    page = raw(spark, [text_block(k, (10, 10 + 100 * k, 200, 20 + 100 * k), f"t{k}") for k in range(4)])
    flat, _ = parse.parse_document(page, enable_grouping=False)
    assert [(r.chunk_index, r.content, r.absolute_position_dynamic) for r in flat.orderBy("chunk_index").collect()] == [(k, f"t{k}", None) for k in range(4)]
    grouped, _ = parse.parse_document(page)
    assert [r.chunk_index for r in grouped.orderBy("path").collect()] == list(range(grouped.count()))


def test_json_reads_back_as_the_same_tree(spark):
    rng = np.random.default_rng(2)
    blocks = [text_block(k, (x, y, x + 60, y + 20), f'say "{k}"\\\n') for k, (x, y) in enumerate(rng.integers(0, 700, (30, 2)))]
    chunks, pages = parse.parse_document(raw(spark, blocks))
    document = views.document_json(views.page_json(chunks, pages))
    flat = nested.flatten_records(document, "doc_id", "json").where("table_name = 'pages.chunks'")
    mine = {r.node_path: r.t for r in flat.select("node_path", F.expr("fields['type']").alias("t")).collect()}
    assert mine == {r.path: r.type for r in chunks.select("path", "type").collect()}
    assert "content_raw" in document.first().json


def test_pages_and_tables_give_the_same_json_and_drawings(spark):
    rng = np.random.default_rng(7)
    pages = raw(spark, [text_block(k, (x, y, x + 60, y + 20)) for k, (x, y) in enumerate(rng.integers(0, 700, (20, 2)))] + [image_block(20, (1, 1, 90, 90))]).unionByName(raw(spark, [], number=2))
    tables = parse.parse_document(pages)
    whole = layout.with_chunks(parse.parsed_pages(pages))
    assert sorted(views.page_json(*tables).collect()) == sorted(views.json_of_pages(whole).collect())
    for flags in ({}, {"recurse_groups": False}, {"show_labels": False, "zoom": 1.0}):
        assert sorted(overlay.render_svg(*tables, **flags).collect()) == sorted(overlay.svg_of_pages(whole, **flags).collect())
    for df in (views.json_of_pages(whole), overlay.svg_of_pages(whole)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_zones(spark):
    values = F.array(*(F.lit(v) for v in (-0.1, 0.5, 0.52, 0.9)))
    breaks = layout.zone_breaks(values, 0.08)
    r = spark.range(1).select(*(layout.zone(F.lit(v), breaks).alias(f"z{i}") for i, v in enumerate((-0.1, 0.5, 0.52, 0.9)))).first()
    assert list(r) == [2, 1, 1, 2]


def test_labels_avoid_each_other():
    boxes = np.array([[100.0, 100, 200, 200], [100, 100, 200, 200]])
    options = np.array([[[0.0, 0, 50, 20], [0, 300, 50, 320], *[[0, 0, 50, 20]] * 6]] * 2)
    assert overlay.place_labels(boxes, options) == [0, 1]


def test_page_numbers(spark):
    page = raw(spark, [])
    assert sources.at_page(page, 1, "d").count() == sources.at_page(page, 1).count() == parse.parse_page(page, "d", 1)[1].count() == 1
    for number in (0, 2):
        with pytest.raises(ValueError, match=f"no page {number}: pages count from 1, and 'd' has 1"):
            sources.at_page(page, number, "d")
        with pytest.raises(ValueError):
            parse.parse_page(page, "d", number)
    with pytest.raises(ValueError, match="'e' has 0"):
        parse.parse_page(page, "e", 1)
    assert sources.at_page(page, 2).count() == 0
    with pytest.raises(ValueError):
        sources.read_raw_pages(spark, "")


def test_stream_gives_the_same_chunks(spark, tmp_path):
    from pagegrain.streaming.pages import stream_chunks, write_stream

    page = raw(spark, [text_block(k, (10, 10 + 100 * k, 200, 20 + 100 * k)) for k in range(4)])
    page.write.parquet(str(tmp_path / "in"))
    write_stream(stream_chunks(sources.stream_raw_pages(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    batch, _ = parse.parse_document(sources.read_raw_pages(spark, str(tmp_path / "in")))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, batch.collect()))


def test_parsing_shuffles_nothing(spark):
    chunks, _ = parse.parse_document(raw(spark, [text_block(0, (10, 10, 50, 20))]))
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
