"""Repeats, scratch tables, sinks, and pages of PDF files by a stand-in for the library."""

import json
import logging
import os

import pytest

from pagegrain import runtime
from pagegrain.operators import atoms, layout, overlay, views
from pagegrain.plans import parse
from pagegrain.sources import raw as sources
from pagegrain.sources import sinks

ROWS = [(1, None, "a"), (1, None, "a"), (None, "x", "b"), (None, "x", "b"), (None, "x", "b"), (2, "x", "c"), (None, None, None)]
KEPT = sorted([(1, None, "a"), (None, "x", "b"), (2, "x", "c"), (None, None, None)], key=str)


@pytest.mark.parametrize("bound", [0, 500_000])
@pytest.mark.parametrize("stored", [True, False])
def test_once(spark, tmp_path, monkeypatch, bound, stored):
    monkeypatch.setattr(runtime, "REPEATED_KEYS", bound)
    df = spark.createDataFrame(ROWS, "k int, __row_ string, payload string").repartition(3)
    if stored:
        df.write.parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
    got = runtime.once(df, ["k", "__row_"])
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == KEPT
    assert runtime.once(df.where("payload = 'c'"), ["k"]).count() == 1
    assert runtime.once(df.limit(0), ["k"]).count() == 0


def test_once_moves_no_wide_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "k int, j string, payload string").write.parquet(str(tmp_path / "t"))
    plan = runtime.once(spark.read.parquet(str(tmp_path / "t")), ["k", "j"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan


def test_page_texts_take_one_exchange_and_filter_first(spark, tmp_path):
    row = ("d", 1, "0000", 0, "text", "words", "words", "words")
    spark.createDataFrame([row, row], "doc_id string, page_number int, path string, chunk_index int, type string, content string, content_raw string, content_tagged string").write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    texts = views.page_text(chunks)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "EqualTo(type,text)" in plan and "content_raw" not in plan
    assert [r.text for r in texts.collect()] == ["words"] == [r.text for r in views.page_text(chunks, all_pages=True).collect()]


def test_scratch_tables_go_when_their_query_is_done(spark):
    with runtime.scratch():
        df = runtime.materialize(spark.range(3), "test")
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
        with runtime.scratch():
            inner = runtime.materialize(spark.range(2), "test").inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and not os.path.exists(inner)
    assert not os.path.exists(path)


def test_what_dead_drivers_left_is_swept(spark, tmp_path):
    for name, age in (("pagegrain-old", 30), ("pagegrain-new", 0), ("other", 30)):
        (tmp_path / name).mkdir()
        when = (tmp_path / name).stat().st_mtime - age * 86_400
        os.utime(tmp_path / name, (when, when))
    runtime._sweep(spark, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["other", "pagegrain-new"]


def page_of(spark):
    box = {"x0": 10.0, "y0": 10.0, "x1": 90.0, "y1": 30.0}
    block = {"block_no": 0, "type": 0, "bbox": box, "lines": [{"spans": [{"bbox": box, "text": "wörds", "chars": None}]}], "ext": None, "width": None, "height": None, "image": None}
    pages = spark.createDataFrame([("d", n, {"x0": 0.0, "y0": 0.0, "x1": 600.0, "y1": 800.0}, [block], None) for n in (1, 2, 3)], sources.RAW_PAGES)
    return layout.with_chunks(parse.parsed_pages(pages)), parse.parse_document(pages)


def test_sinks(spark, tmp_path):
    whole, (chunks, _) = page_of(spark)
    jsons = views.json_of_pages(whole)
    path = sinks.write_json_file(jsons.where("page_number = 2"), str(tmp_path / "out" / "page.json"))
    text = open(path, encoding="utf-8").read()
    assert json.loads(text)["page_number"] == 2 and text.startswith('{\n  "page_number": 2') and "wörds" in text
    with pytest.raises(ValueError):
        sinks.write_json_file(jsons, path)
    drawings = overlay.svg_of_pages(whole)
    assert open(sinks.write_drawing_file(drawings.where("page_number = 1"), str(tmp_path / "p.svg"))).read().endswith("</svg>")
    with pytest.raises(ValueError):
        sinks.write_drawing_file(drawings.limit(0), str(tmp_path / "p.svg"))
    sinks.write_chunks(chunks, str(tmp_path / "chunks"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 3
    sinks.write_json(jsons, str(tmp_path / "json"))
    assert sorted(json.loads(r.value)["page_number"] for r in spark.read.text(str(tmp_path / "json")).collect()) == [1, 2, 3]
    sinks.write_drawings(drawings, str(tmp_path / "svg"))
    assert spark.read.parquet(str(tmp_path / "svg")).count() == 3


def dots(png):
    """The pixels of a PNG file, by the format's plain rules."""
    import struct
    import zlib

    import numpy as np

    assert png[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts = 8, {}
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at : at + 8])
        assert zlib.crc32(png[at + 4 : at + 8 + n]) == struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]
        parts[kind] = parts.get(kind, b"") + png[at + 8 : at + 8 + n]
        at += 12 + n
    width, height = struct.unpack(">II", parts[b"IHDR"][:8])
    rows = np.frombuffer(zlib.decompress(parts[b"IDAT"]), dtype=np.uint8).reshape(height, 1 + 3 * width)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(height, width, 3)


def test_pictures(spark, tmp_path):
    whole, _ = page_of(spark)
    pictures = overlay.png_of_pages(whole)
    assert "Exchange" not in pictures._jdf.queryExecution().executedPlan().toString()
    path = sinks.write_drawing_file(pictures.where("page_number = 1"), str(tmp_path / "o" / "p.png"))
    seen = dots(open(path, "rb").read())
    assert seen.shape == (1600, 1200, 3)
    blue, white = (0x00, 0x66, 0xCC), (255, 255, 255)
    assert tuple(seen[20, 100]) == tuple(seen[59, 100]) == tuple(seen[40, 20]) == tuple(seen[40, 179]) == blue and tuple(seen[40, 100]) == tuple(seen[800, 600]) == white
    plain = dots(overlay.png_of_pages(whole, show_labels=False).first().png)
    assert (seen != plain).any(axis=2).sum() > 200 and ((plain == blue).all(axis=2) | (plain == 255).all(axis=2)).all()
    with pytest.raises(ValueError):
        overlay.png_of_pages(whole, zoom=0.0)


def test_signs_are_drawn():
    from pagegrain.functions.raster import Picture

    picture = Picture(20, 9)
    picture.write(1, 1, "I?", (0, 0, 0))
    assert ["".join(".#"[int(not d.any())] for d in row) for row in picture.dots[1:8, 1:13]] == [".###...#####", "..#....#...#", "..#....#...#", "..#....#...#", "..#....#...#", "..#....#...#", ".###...#####"]
    picture.write(-3, 6, "AAAA", (0, 0, 0))
    picture.line(-5, -5, 40, 40, (1, 2, 3))
    assert len(dots(picture.png())) == 9


def test_documents_in_parts(spark):
    whole, _ = page_of(spark)
    jsons = views.json_of_pages(whole)
    (one,) = views.document_json(jsons).collect()
    assert (one.part_no, one.n_pages) == (0, 3)
    parts = views.document_json(jsons, pages_a_part=2).orderBy("part_no").collect()
    assert [p.n_pages for p in parts] == [2, 1]
    assert [x for p in parts for x in json.loads(p.json)["pages"]] == json.loads(one.json)["pages"]


STAND_IN = '''
class Rect(tuple):
    def __new__(cls, *sides):
        return super().__new__(cls, sides)
class Matrix(Rect):
    pass
class _Picture:
    def __init__(self, clip):
        self.clip = clip
    def tobytes(self, kind):
        return repr((kind, tuple(self.clip))).encode()
class _Found:
    def __init__(self, *bbox):
        self.bbox = bbox
class _Page:
    rect = Rect(0, 0, 600, 800)
    def __init__(self, kind):
        self.kind = kind
    def get_text(self, how):
        span = {"bbox": (10, 10, 90, 30), "chars": [{"c": "h"}, {"c": "i"}]}
        return {"blocks": [{"type": 0, "bbox": (10, 10, 90, 30), "lines": [{"spans": [span]}]}, {"type": 1, "bbox": (300, 300, 400, 400), "ext": "png", "width": 3, "height": 4, "image": b"x"}]}
    def find_tables(self):
        if self.kind == "lost":
            raise RuntimeError("no tables today")
        return type("Tables", (), {"tables": [_Found(1, 500, 90, 600), _Found(5, 700, 90, 790)]})
    def get_pixmap(self, matrix, clip, alpha):
        if clip[1] > 600 and self.kind == "undrawn":
            raise RuntimeError("no picture today")
        return _Picture(clip)
class _Document(list):
    def __enter__(self):
        return self
    def __exit__(self, *_):
        pass
def open(stream, filetype):
    return _Document(_Page(k) for k in bytes(stream).decode().split(","))
'''


def test_pdf_files_need_the_library(spark):
    with pytest.raises(RuntimeError, match="PyMuPDF"):
        sources.read_pdf_files(spark, "/nowhere")
    with pytest.raises(ValueError):
        sources.read_pdf_files(spark, "")


def test_pdf_pages(spark, tmp_path, monkeypatch, caplog):
    import sys
    import types

    import pandas as pd

    library = types.ModuleType("fitz")
    exec(STAND_IN, library.__dict__)
    monkeypatch.setitem(sys.modules, "fitz", library)
    with caplog.at_level(logging.WARNING):
        pages = pd.concat(sources._pdf_pages(iter([pd.DataFrame({"path": ["a.pdf", "b.pdf"], "content": [b"plain,lost", b"undrawn"]})])))
    assert [(r.doc_id, r.page_number, len(r.tables)) for r in pages.itertuples()] == [("a.pdf", 1, 2), ("a.pdf", 2, 0), ("b.pdf", 1, 2)]
    assert pages.tables.iloc[0][0]["png"] == b"('png', (0.0, 498.0, 92.0, 602.0))" and pages.tables.iloc[2][1]["png"] is None
    assert sorted(r.getMessage() for r in caplog.records) == ["a.pdf, page 2: no tables found, no tables today", "b.pdf, page 1: table 1 not drawn, no picture today"]
    raw = spark.createDataFrame([tuple(r)[1:] for r in pages[["doc_id", "page_number", "rect", "blocks", "tables"]].itertuples()], sources.RAW_PAGES)
    found = atoms.extract_atoms(raw)
    assert sorted((r.doc_id, r.page_number, r.type) for r in found.select("doc_id", "page_number", "type").collect()) == sorted((d, n, k) for d, n, ks in (("a.pdf", 1, "text image table table"), ("a.pdf", 2, "text image"), ("b.pdf", 1, "text image table table")) for k in ks.split())
    assert found.where("type = 'text'").first().content == "hi"
