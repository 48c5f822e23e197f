"""Bands of graded samples that were not used for fitting."""

from pathlib import Path

import pytest

from pagegrain.llm import reading
from tests.conftest import DATA


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are absent")
def test_held_out_samples(spark):
    samples = [(r.text, r.reading_band) for r in spark.read.parquet(f"{DATA}/reading_samples.parquet").orderBy("sample_id").collect()]
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    familiar = reading.familiar_words(documents.where("lang = 'en'"), "text")
    right = 0
    for k in range(3):
        model = reading.fit([s for i, s in enumerate(samples) if i // 3 % 3 != k], familiar)
        right += sum(model.band(model.score(text)) == band for i, (text, band) in enumerate(samples) if i // 3 % 3 == k)
    assert right >= 0.96 * len(samples)


def test_familiar_words(spark, monkeypatch):
    monkeypatch.setattr(reading, "HELD_WORDS", 3)
    df = spark.createDataFrame([("The pump.",), ("the valve",), ("",), (None,), ("THE pump of the mill",)], "text string")
    assert reading.familiar_words(df, "text", 0.5) == {"the", "pump"}
    assert reading.familiar_words(df.limit(0), "text") == frozenset()


LARGE = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(LARGE).exists(), reason="test tables are absent")
def test_unfamiliar_words_keep_their_weight(spark):
    samples = spark.read.parquet(f"{LARGE}/reading_samples.parquet")
    model = reading.train(spark.read.parquet(f"{LARGE}/documents.parquet"), samples)
    assert model.weights[0] > 0 and model.weights[1] > 0
    graded = [(r.text, r.reading_band) for r in samples.collect()]
    assert sum(model.band(model.score(text)) == band for text, band in graded) >= 0.96 * len(graded)
    known, rare = (" ".join([f"The {word} turns here." for word in words] * 40) for words in (["water"], ["zymurgical"]))
    assert model.score(rare) > model.score(known)


def test_weights_of_figures_that_rise_together():
    # words cross into the list while lengths tell the bands apart: free least squares weighs words below 0
    texts = [("a " * 3 + ". ", 1), ("a " * 9 + "x . ", 2), ("a " * 25 + "x x x x . ", 3), ("a " * 26 + "x x x x x x x x x . ", 3)]
    model = reading.fit([(t.strip(), b) for t, b in texts], frozenset("a"))
    assert min(model.weights[:2]) > 0
    assert reading.fit([("a a a", 2), ("a a a", 2)], frozenset("a")).bands == (2,)


def test_word_grades(spark):
    rows = [("full half" if i < 13 else "full" if i < 20 else "part" if i < 38 else "none",) for i in range(100)]
    grades = reading.word_grades(spark.createDataFrame(rows, "text string"), "text")
    assert grades["none"] == 1.0 and 0 < grades["part"] < 1 and 0 < grades["full"] < 1
    assert "half" not in grades and grades["half"] == 0.0
    assert reading.measure("Part part unseen", grades)[0] == pytest.approx(1 - 2 * grades["part"] / 3)


def test_sentences():
    assert reading.sentence_length("It is wet. It is dry; It is old\nIt is new") == 3
    assert reading.sentence_length("the plate. wherein the rod turns. Then it stops again") == (6 + 4) / 2
    assert reading.sentence_length("") == 1


def test_frames(spark):
    model = reading.ReadingModel(frozenset(["a"]), (1.0, 1.0, 0.0), (1, 2, 3), (2.0, 3.0))
    rows = [(1, "en", "A word. " * 60), (1, "en", "A word. " * 60), (2, "en", "few words"), (3, "en", None), (4, None, "a " * 200), (5, "de", "a " * 200), (6, "en", "word " * 200_000), (7, "en", "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, score string")
    got = reading.reading_bands(df, model).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 6] and {r.reading_band for r in got if r.doc_id == 6} == {3}
    assert reading.reading_bands(df.limit(0), model).count() == 0
