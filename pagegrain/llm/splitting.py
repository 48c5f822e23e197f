"""Cutting oversized texts at natural boundaries, with overlap.

Dynamic programming over the boundary positions of a text: each cut costs a
penalty by its kind (paragraph, sentence, clause or line, word, none), each piece
the square of its distance from the even size, and no piece is longer than the
limit. Each piece but the first begins with the last ``overlap`` characters of
the piece before it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH, SENTENCE, CLAUSE, LINE, WORD, NONE = 0.0, 0.1, 0.4, 0.5, 0.8, 3.0
#: Weight of a piece's squared relative distance from the even size.
BALANCE = 1.0

_STRONG = re.compile(
    r"(?P<paragraph>\n[ \t]*\n\s*)"
    r"|(?P<sentence>(?<!\b[A-Za-z])(?<!Fig)(?<!FIG)(?<!No)[.!?][\"')\]]*\s+(?=[^\W\d_a-zß-öø-ÿ]|[\[(•\"'])|[。！？])"
    r"|(?P<clause>[;:,]\s+|[；，、：])"
    r"|(?P<line>\n\s*)"
)
_COST = {"paragraph": PARAGRAPH, "sentence": SENTENCE, "clause": CLAUSE, "line": LINE}
_BLANKS = re.compile(r"\s+")
#: The joiner of pictographs and the sign that asks for a pictograph; both belong to the character before.
_JOINER, _AS_PICTURE = "‍", "️"


def boundaries(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where ``text`` may be cut, ascending, from 0 to its length; and their penalties.

    These are all ends of paragraphs, sentences, clauses, lines and words. Only a
    stretch without one that is longer than the new text of a piece, which must be cut
    within, may be cut between any two characters. No mark is parted from its
    letter, unless marks alone fill such a stretch.
    """
    found = {m.end(): WORD for m in _BLANKS.finditer(text)}
    found |= {m.end(): _COST[m.lastgroup] for m in _STRONG.finditer(text)}
    n = len(text)
    if not text.isascii():
        found = {p: c for p, c in found.items() if p < n and _is_whole(text, p)}
    at = sorted({0, n, *found})
    for allowed in (_is_whole, lambda _, __: True):
        if max(map(int.__sub__, at[1:], at[:-1]), default=0) > limit - overlap:
            wide = [(a, b) for a, b in zip(at[:-1], at[1:], strict=True) if b - a > limit - overlap]
            dense = [p for a, b in wide for p in range(a + 1, b) if allowed(text, p)]
            found |= dict.fromkeys(dense, NONE)
            at = sorted({*at, *dense})
    return np.array(at, dtype=np.int64), np.array([0.0 if p in (0, n) else found[p] for p in at])


def _is_whole(text: str, p: int) -> bool:
    return not (unicodedata.combining(text[p]) or text[p] in (_JOINER, _AS_PICTURE) or text[p - 1] == _JOINER)


def even_size(n: int, limit: int, overlap: int) -> float:
    """The new text of each piece if all are alike and as few as can be."""
    return (n - overlap) / -(-(n - overlap) // (limit - overlap))


def cuts(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces' new text, the last being the text's length; ``[len(text)]`` if it fits.

    The choice is the cheapest of all choices of boundaries that keep the limit, by
    dynamic programming: the cheapest way to each boundary is that to one within a
    piece's new text before it. Time is in proportion to the text's length.
    """
    n = len(text)
    if n <= limit:
        return [n]
    fresh, even = limit - overlap, even_size(n, limit, overlap)
    at, cost = boundaries(text, limit, overlap)
    uneven = BALANCE * ((np.arange(fresh + 1) - even) / even) ** 2  # by the length of the new text
    best = np.full(len(at), np.inf)
    back = np.zeros(len(at), dtype=np.int64)
    places, costs = at.tolist(), cost.tolist()
    i = 1
    for j in range(1, len(places)):
        p = places[j]
        if p <= overlap:  # the next piece must find its overlap in this one
            continue
        while places[i] < p - fresh:
            i += 1
        least = np.inf
        if i < j:
            total = uneven[p - at[i:j]] + best[i:j]
            k = int(total.argmin())
            least, back[j] = total[k], i + k
        if p <= limit and uneven[p - overlap] <= least:  # as the first piece, which has no overlap to carry
            least, back[j] = uneven[p - overlap], 0
        best[j] = least + costs[j]
    ends, j = [], len(at) - 1
    while j:
        ends.append(places[j])
        j = int(back[j])
    return ends[::-1]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece of ``text``."""
    ends = cuts(text, limit, overlap)
    return [(0, ends[0]), *((a - overlap, b) for a, b in zip(ends[:-1], ends[1:], strict=True))]


def split_oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 1000, overlap: int = 100, with_text: bool = True) -> DataFrame:
    """``id_col, piece_no, n_pieces, start, end`` and the ``piece``: the pieces of each row's text.

    A text within the limit is its own only piece, the empty one too; a null text
    has none. Lengths are in characters. Where a text has no boundary within a
    piece's new text it is cut between characters. Repeated rows give repeated pieces. Other
    columns of ``df`` aren't read. No shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows: list[tuple] = []
            parts: list[str] = []
            for i, text in enumerate(texts):
                cut = pieces(text, limit, overlap)
                for k, (a, b) in enumerate(cut):
                    rows.append((i, k, len(cut), a, b))
                    if with_text:
                        parts.append(text[a:b])
            index, *numbers = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            arrays = [batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(x, pa.int32()) for x in numbers)]
            names = ["id", "piece_no", "n_pieces", "start", "end"]
            if with_text:
                arrays, names = [*arrays, pa.array(parts, pa.string())], [*names, "piece"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece_no int, n_pieces int, start int, end int" + ", piece string" * with_text
    source = df.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
