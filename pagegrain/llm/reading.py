"""Reading level by a familiar-word formula.

A text's score adds the share of its words outside a list of frequent words, taken
from the document frequencies of the corpus, and the logarithm of its average
sentence length. Words about as frequent as the list's limit count in part, so that
a word that crosses it as the corpus grows moves no score by a leap. Weights and
band limits are fitted to a small table of graded samples.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from statistics import fmean

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.runtime import materialize

#: A word is familiar if this share of the documents has it.
FAMILIAR_SHARE = 0.2
#: Words from this part of that share on count in part, those from its counterpart above it on in full.
GRADED_FROM, GRADED_TO = 0.75, 1.25
#: Of the two figures, in spreads of the samples, each has at least this part of the other's weight.
LEAST_WEIGHT = 0.2
#: Graded samples used for fitting, at most; the table is small and fixed.
MAX_SAMPLES = 10_000
MIN_WORDS = 100
#: Words counted in a task before the counts are handed on.
HELD_WORDS = 200_000

_WORD = re.compile(r"[^\W\d_]+")
#: An end mark or a line end makes a sentence end only before a capital, a quote or a number in brackets.
_SENTENCE = re.compile(r"(?:[.!?;:][\"')\]]*\s+|\s*\n\s*)(?=[\"'(\[]*[^\W\d_a-zß-öø-ÿ]|[\"']*[\[(]\d)")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def average_length(sizes: list[int]) -> float:
    """The average of sentence lengths: that of their middle half, fragments of up to two words aside.

    A lost full stop makes one sentence of two, a false one a fragment; the plain average
    follows them, and puts about one text of a hundred into another band.
    """
    whole = sorted(n for n in sizes if n > 2)
    if not whole:
        return float(max(1, sum(sizes)))
    cut = len(whole) // 4
    return fmean(whole[cut : len(whole) - cut])


def sentence_length(text: str) -> float:
    """The average of the text's sentence lengths in words, as ``average_length`` takes it."""
    return average_length([len(words_of(part)) for part in _SENTENCE.split(text)])


class Grades(dict):
    """Familiarity of words, from 0 to 1; words that aren't held have 0."""

    def __missing__(self, word: str) -> float:
        return 0.0


def measure(text: str, familiar: frozenset[str] | Grades) -> tuple[float, float]:
    """Share of unfamiliar words, and average sentence length."""
    grade = familiar.__getitem__ if isinstance(familiar, Mapping) else familiar.__contains__
    sizes, known = [], 0
    for part in _SENTENCE.split(text):
        words = words_of(part)
        sizes.append(len(words))
        known += sum(map(grade, words))
    total = sum(sizes)
    return (1 - known / total if total else 0.0), average_length(sizes)


def familiar_words(texts: DataFrame, text_col: str, share: float = FAMILIAR_SHARE) -> frozenset[str]:
    """Words that at least ``share`` of the documents have; null texts don't count."""
    return frozenset(document_shares(texts, text_col, share))


def word_grades(texts: DataFrame, text_col: str, share: float = FAMILIAR_SHARE) -> Grades:
    """Words' familiarity: by the logarithm of their share of documents, 0 below and 1 above a stretch around ``share``."""
    low, high = np.log(share * GRADED_FROM), np.log(share * GRADED_TO)
    shares = document_shares(texts, text_col, share * GRADED_FROM)
    return Grades({w: min(1.0, float((np.log(s) - low) / (high - low))) for w, s in shares.items()})


def document_shares(texts: DataFrame, text_col: str, share: float) -> dict[str, float]:
    """Words that at least ``share`` of the documents have, each with its share.

    Counts are combined in each task before the shuffle. The list is bounded by the
    mean number of distinct words of a document over ``share``, whatever the
    number of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts[""] += 1
                counts.update(set(words_of(text)))
                if len(counts) > HELD_WORDS:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    counts = materialize(texts.where(F.col(text_col).isNotNull()).select(text_col).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    n_docs = next((r.n for r in counts.where("word = ''").collect()), 0)
    return {r.word: r.n / n_docs for r in counts.where((F.col("n") >= share * n_docs) & (F.col("word") != "")).collect()}


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


@dataclass(frozen=True)
class ReadingModel:
    familiar: frozenset[str] | Grades
    weights: tuple[float, float, float]
    bands: tuple[int, ...]
    limits: tuple[float, ...]

    def score(self, text: str) -> float:
        unknown, length = measure(text, self.familiar)
        return self.weights[0] * unknown + self.weights[1] * float(np.log(length)) + self.weights[2]

    def band(self, score: float) -> int:
        return self.bands[int(np.searchsorted(self.limits, score, side="right"))]


def fit(samples: list[tuple[str, int]], familiar: frozenset[str] | Grades) -> ReadingModel:
    """Least squares of the band on both figures, each weighted at least ``LEAST_WEIGHT`` of the other; limits where fewest samples are misplaced.

    Both figures rise together in the samples, so that free least squares can give
    the lesser any weight, one below 0 too, by small changes of the word list.
    """
    if not samples:
        raise ValueError("graded samples are needed")
    x = np.array([measure(t, familiar) for t, _ in samples])
    y = np.array([b for _, b in samples], dtype=float)
    figures = np.c_[x[:, 0], np.log(x[:, 1])]
    spread = figures.std(axis=0)
    scale = np.divide(1.0, spread, out=np.zeros(2), where=spread > 0)
    w = np.linalg.lstsq(np.c_[figures * scale, np.ones(len(x))], y, rcond=None)[0]
    lesser = int(w[0] > w[1])
    if w[lesser] < LEAST_WEIGHT * w[1 - lesser]:
        parts = np.ones(2)
        parts[lesser] = LEAST_WEIGHT
        slope, rest = np.linalg.lstsq(np.c_[figures * scale @ parts, np.ones(len(x))], y, rcond=None)[0]
        w = np.array([*(max(0.0, slope) * parts), rest])
    w[:2] *= scale
    scores = figures @ w[:2] + w[2]
    bands = sorted(set(y.astype(int).tolist()))
    limits = []
    for below in bands[:-1]:
        ranked = np.unique(scores)
        middles = (ranked[1:] + ranked[:-1]) / 2 if len(ranked) > 1 else ranked
        wrong = np.array([((scores > m) != (y > below)).sum() for m in middles])
        best = np.flatnonzero(wrong == wrong.min())
        gaps = ranked[best + 1] - ranked[best] if len(ranked) > 1 else np.ones(1)
        limits.append(float(middles[best[int(gaps.argmax())]]))
    return ReadingModel(familiar, tuple(w.tolist()), tuple(bands), tuple(np.maximum.accumulate(limits).tolist()))


def train(documents: DataFrame, samples: DataFrame, lang: str = "en") -> ReadingModel:
    """The model of a corpus: its familiar words, fitted to the graded samples."""
    familiar = word_grades(documents.where(F.col("lang") == lang), "text")
    graded = samples.where("text is not null and reading_band is not null").orderBy("sample_id").limit(MAX_SAMPLES).select("text", "reading_band").collect()
    return fit([(r.text, r.reading_band) for r in graded], familiar)


def reading_bands(documents: DataFrame, model: ReadingModel, lang: str = "en", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, reading_band, score, unfamiliar_share, sentence_length`` of each text of ``lang`` with enough words.

    Words, for the minimum, are split at white space. Null, empty and shorter
    texts have no row. Repeated rows stay repeated. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if len(text.split()) < min_words:
                    continue
                unknown, length = measure(text, model.familiar)
                score = model.weights[0] * unknown + model.weights[1] * float(np.log(length)) + model.weights[2]
                rows.append((i, model.band(score), score, unknown, length))
            index, *values = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=["doc_id", "reading_band", "score", "unfamiliar_share", "sentence_length"])

    source = documents.where((F.col("lang") == lang) & F.col("text").isNotNull()).select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, reading_band int, score double, unfamiliar_share double, sentence_length double")
