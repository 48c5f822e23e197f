"""Pieces keep limit, overlap and text; cuts lie at natural boundaries."""

import unicodedata
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagegrain.llm.splitting import pieces, split_oversized
from tests.conftest import DATA

part = st.sampled_from(["word ", "a", "Sentence ends. ", "\n", "\n\n", "中文。", "é", ", ", "x" * 37, " ", "😀"])


@settings(max_examples=120, deadline=None)
@given(st.lists(part, max_size=120).map("".join), st.integers(12, 60), st.integers(0, 11))
def test_rules(text, limit, overlap):
    got = pieces(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(b - a <= limit for a, b in got)
    assert all(q[0] == p[1] - overlap and q[1] > p[1] and p[1] - p[0] >= overlap for p, q in zip(got, got[1:], strict=False))
    assert (len(got) == 1) == (len(text) <= limit)


def test_natural_boundaries_and_balance():
    text = "\n\n".join(["One sentence of some words follows another. " * 5 + "The end."] * 6)
    got = pieces(text, 500, 50)
    assert all(text[b - 2 : b] in ("\n\n", ". ") for _, b in got[:-1])
    sizes = [b - a for a, b in got]
    assert max(sizes) < 2 * min(sizes)


def test_best_of_all_cuts():
    """The cost found is that of the best choice of boundaries, by trying all."""
    import numpy as np

    from pagegrain.llm import splitting

    text = "Aa bb. Cc dd, ee ff. Gg hh\nii jj. Kk"
    limit, overlap = 16, 3
    at, cost = splitting.boundaries(text, limit, overlap)
    fresh, n = limit - overlap, len(text)
    even = (n - overlap) / -(-(n - overlap) // fresh)

    def total(ends):
        sizes = [ends[0] - overlap] + [b - a for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return sum(((s - even) / even) ** 2 for s in sizes) + sum(cost[np.searchsorted(at, e)] for e in ends)

    def choices(ends):
        last = ends[-1] if ends else 0
        if last == n:
            yield ends
        for p in at[1:]:
            if p > max(last, overlap) and p - last <= (fresh if ends else limit):
                yield from choices([*ends, int(p)])

    assert total(splitting.cuts(text, limit, overlap)) == pytest.approx(min(map(total, choices([]))))


def plain_cost(text, limit, overlap):
    """The cheapest cost of all choices of boundaries, by a plain loop over all pairs."""
    from pagegrain.llm import splitting

    at, cost = (x.tolist() for x in splitting.boundaries(text, limit, overlap))
    even, best = splitting.even_size(len(text), limit, overlap), [float("inf")] * len(at)
    for j in range(1, len(at)):
        ways = [((at[j] - overlap - even) / even) ** 2] * (overlap < at[j] <= limit)
        ways += [best[i] + ((at[j] - at[i] - even) / even) ** 2 for i in range(max(1, j - limit), j) if overlap < at[i] and at[j] - at[i] <= limit - overlap]
        best[j] = min(ways, default=float("inf")) + cost[j]
    return best[-1]


def cost_of(text, limit, overlap):
    from pagegrain.llm import splitting

    at, cost = splitting.boundaries(text, limit, overlap)
    penalty, even = dict(zip(at.tolist(), cost.tolist(), strict=True)), splitting.even_size(len(text), limit, overlap)
    ends = splitting.cuts(text, limit, overlap)
    return sum(((b - a - even) / even) ** 2 for a, b in zip([overlap, *ends], ends, strict=False)) + sum(penalty[e] for e in ends)


@settings(max_examples=60, deadline=None)
@given(st.lists(part, max_size=90).map("".join), st.integers(12, 60), st.integers(0, 11))
def test_no_choice_of_boundaries_is_cheaper(text, limit, overlap):
    if len(text) > limit:
        assert cost_of(text, limit, overlap) == pytest.approx(plain_cost(text, limit, overlap))


@pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are absent")
def test_no_choice_is_cheaper_on_the_tables():
    texts = [t for t in pq.read_table(f"{DATA}/chunks.parquet", columns=["content"]).column(0).unique().to_pylist() if t and len(t) > 1000]
    assert texts and all(cost_of(t, 1000, 100) == pytest.approx(plain_cost(t, 1000, 100)) for t in texts)


def test_a_stretch_without_boundaries_takes_the_fewest_pieces():
    assert [b - a for a, b in pieces("ab " * 17 + "x" * 1849, 1000, 100)] == [1000, 1000]
    assert len(pieces("x" * 3700, 1000, 100)) == 4


def test_marks_stay_with_their_letters():
    text = "e\u0301" * 900
    assert all(not unicodedata.combining(text[b]) for _, b in pieces(text, 1000, 100)[:-1])
    family = "\U0001f468\u200d\U0001f469 " * 500
    assert all(family[b] != "\u200d" != family[b - 1] for _, b in pieces(family, 1000, 100)[:-1])
    assert all(b - a <= 1000 for a, b in pieces("a" + "\u0301" * 3000, 1000, 100))


def test_frames(spark):
    df = spark.createDataFrame([(1, "short", 0), (2, "", 0), (3, None, 0), (4, "word " * 300_000, 0), (5, "x" * 2500, 0), (5, "x" * 2500, 0)], "chunk_id long, content string, piece int")
    rows = split_oversized(df, "chunk_id", "content").collect()
    by = {i: sorted((r.piece_no, r.piece) for r in rows if r.chunk_id == i) for i in range(1, 6)}
    assert by[1] == [(0, "short")] and by[2] == [(0, "")] and by[3] == []
    assert all(len(p) <= 1000 for _, p in by[4]) and by[4][0][1] + "".join(p[100:] for _, p in by[4][1:]) == "word " * 300_000
    assert len(by[5]) == 6
    assert split_oversized(df.limit(0), "chunk_id", "content").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, "chunk_id", "content", 10, 10)
