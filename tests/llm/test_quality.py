"""Kinds of the labelled samples, and statistics against plain counting."""

import random
from collections import Counter
from pathlib import Path

import pytest

from pagegrain.llm import quality
from tests.conftest import DATA

needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are absent")


@needs_data
def test_samples(spark):
    common = frozenset(r.word for r in spark.read.parquet(f"{DATA}/common_words.parquet").collect())
    samples = spark.read.parquet(f"{DATA}/quality_samples.parquet").collect()
    right = sum(quality.chunk_kind(s.text, common) == s.text_class for s in samples)
    natural = sum((quality.chunk_kind(s.text, common) == "prose") == (s.text_class == "prose") for s in samples)
    assert right >= 0.97 * len(samples) and natural >= 0.98 * len(samples)


@needs_data
def test_held_out_samples(spark):
    """Limits fitted to two thirds of the samples; the others' classes."""
    common = frozenset(r.word for r in spark.read.parquet(f"{DATA}/common_words.parquet").collect())
    samples = [(s.text, s.text_class) for s in spark.read.parquet(f"{DATA}/quality_samples.parquet").orderBy("sample_id").collect()]
    right = {}
    for k in range(3):
        limits = quality.fit_limits([s for i, s in enumerate(samples) if i % 3 != k], common)
        for text, kind in (s for i, s in enumerate(samples) if i % 3 == k):
            right.setdefault(kind, []).append(quality.chunk_kind(text, common, limits) == kind)
    assert all(sum(r) >= 0.96 * len(r) for r in right.values()) and len(right) == 4


def test_limits_move_only_for_fewer_errors():
    assert quality.fit_limits([], frozenset()) == quality.Limits()
    signs = [("acgtacgtacgt pump valve rod beams frame halls", "junk")] * 3  # 12 of 39 letters in a word of four
    fitted = quality.fit_limits(signs, frozenset())
    assert fitted.junk_share < quality.Limits().junk_share and quality.chunk_kind(signs[0][0], frozenset(), fitted) == "junk"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Fig. 3 - pump (small type), sheet 4", "prose"), ("12. The pump of claim 2, wherein the valve is kept open.", "prose"), ("", "prose"), (" \n ", "prose"), ("转子喷嘴信号轴承，基板阀门薄膜过滤。", "prose"),
        ("• pump, 3 pcs\n• valve, 4 pcs\n• rod, 1 pcs", "list"), ("a | 1 | 2\nb | 3 | 4\nc | 5 | 6", "table"), ("x\t1\t2\ny\t3\t4", "table"), ("-" * 40 + "\n" + "=" * 30, "junk"), ("acgtacgtacgtacgt ttgacaggtacacg", "junk"), ("Ã©â€œÂµ ï¿½Ã¼Â Ã©Â", "junk"),
    ],
)
def test_kinds(text, kind):
    assert quality.chunk_kind(text, frozenset(["the", "of"])) == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Share this article. " * 60, "boilerplate"), ("\n\n".join(["All rights reserved. Terms apply."] * 50), "boilerplate"), ("\n".join(["The valve is shut. It stays so."] * 3 + ["The pump is on."] * 3), "boilerplate"),
        ("All rights reserved. Terms apply.", "prose"), ("Share this article.\nShare this article.", "prose"), ("The pump moves the water, and the valve stops the water. " * 2, "prose"),
    ],
)
def test_boilerplate(text, kind):
    assert quality.chunk_kind(text, frozenset(["the", "of"])) == kind


def statistics(df, words, least=quality.TOP_GRAM):
    measured = quality.figures(df, words)
    return {r.doc_id: r for r in quality.document_statistics(measured, quality.repetition(measured), quality.dominant_grams(df, measured, least)).collect()}


def test_statistics(spark):
    words = spark.createDataFrame([("en", "the"), ("en", None)], "lang string, word string")
    prose = "The pump moves the water.\nIt is kept by the valve"
    rows = [(1, "a", prose, 0), (1, "a", prose, 0), (2, "a", "• x, 1 pcs\n• y, 2 pcs", 0), (3, "b", "", 0), (4, "c", None, 0), (5, None, "word", 0), (6, "b", "x" * 1_000_000, 0)]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id string, content string, n_chars int")
    got = statistics(df, words)
    assert set(got) == {"a", "b", None}
    a = got["a"]
    assert (a.n_chars, a.word_count, a.is_prose) == (len(prose) + 21, 11 + 8, True)
    assert a.common_word_share == 3 / 19 and a.list_share == 21 / (len(prose) + 21)
    assert statistics(df.limit(0), words) == {}


def test_repetition_decides(spark):
    """Files of one notice on every page, of one phrase over and over, and of plain prose that quotes itself a little."""
    words = spark.createDataFrame([("en", "the")], "lang string, word string")
    notice = "All rights reserved by the owner of this page, who may be asked about terms."
    own = ["The pump moves water.", "A valve stops it again.", "Both are kept in a frame of steel.", "The frame is hung from a beam, which is part of the hall."]
    data = {"notices": [notice] * 6, "prose": [f"{x} It is number {i}, and no other is like {'abcdefg'[i]}." for i, x in enumerate(own)] + [own[0], own[0]]}
    data["chant"] = [f"{w} share this {v} share this {w}{v} share this" for w, v in zip("one two three four five six seven eight nine ten".split(), "pump valve rod beam frame hall water steel page owner".split(), strict=True)]
    df = spark.createDataFrame([(k * 100 + i, doc, text) for k, (doc, texts) in enumerate(data.items()) for i, text in enumerate(texts)], "chunk_id long, doc_id string, content string")
    got = statistics(df, words)
    assert {d: r.is_prose for d, r in got.items()} == {"notices": False, "prose": True, "chant": False}
    assert got["notices"].repeated_line_share == 5 / 6 and got["notices"].boilerplate_share == 0 and got["chant"].top_gram_share > 0.2 and got["chant"].repeated_line_share == 0


def plain(rows):
    """Repeated lines, paragraphs and the dominant pair of each document by plain counting."""
    out = {}
    for doc in {d for _, d, _ in rows}:
        texts = list({i: t for i, d, t in rows if d == doc and t is not None}.values())
        n, shares = sum(map(len, texts)), []
        for mark in ("\n", "\n\n"):
            parts = Counter(p.strip(" ") for t in texts for p in t.split(mark) if p.strip(" "))
            total = sum(len(p) * k for p, k in parts.items())
            shares.append(sum(len(p) * (k - 1) for p, k in parts.items()) / total if total else 0.0)
        grams = Counter(g for t in texts if (w := [x.strip(quality.EDGES).lower() for x in t.split()]) for g in zip(w, w[1:], strict=False))
        if texts:
            out[doc] = (*shares, min(1.0, max((k * (len(a) + len(b) + 1) for (a, b), k in grams.items() if k > 1), default=0) / n) if n else 0.0)
    return out


@pytest.mark.parametrize("bound", [0, 500_000])
def test_repetition_by_plain_counting(spark, monkeypatch, bound):
    monkeypatch.setattr(quality, "BROADCAST_DOCS", bound)
    rng = random.Random(4)
    parts = ["one", "Two three", "four, five", "\n", "\n\n", " ", "share this", "é"]
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, "".join(rng.choice(parts) + " " for _ in range(rng.randrange(12)))])) for i in range(80)]
    df = spark.createDataFrame(rows + rows[:20], "chunk_id long, doc_id string, content string")
    got = statistics(df, spark.createDataFrame([("en", "one")], "lang string, word string"), 0.0)
    want = plain(rows)
    assert set(got) == set(want)
    for doc, r in got.items():
        assert (r.repeated_line_share, r.repeated_paragraph_share, r.top_gram_share) == pytest.approx(want[doc])
