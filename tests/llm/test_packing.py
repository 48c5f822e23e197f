"""Containers keep every capacity, hold every item once and leave little space."""

import random

import numpy as np
import pytest

from pagegrain.llm import packing


def fill(lengths, bins):
    return np.bincount(bins, weights=lengths)


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_best_fit(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 6001, 3000)
    capacity = packing.Capacity(rule=rule)
    bins = packing.best_fit(lengths, capacity)
    assert fill(lengths, bins).max() <= 6000 and np.bincount(bins).max() <= capacity.items
    assert bins.max() + 1 <= (1.02 if rule == "residual_norm" else 1.1) * lengths.sum() / 6000 + 1


def one_by_one(lengths, capacity):
    """Plain best fit, item after item: how many bins of each content there are."""
    room, weights, bins = capacity.vector(), np.array(capacity.weights), []
    for n in sorted(lengths.tolist(), reverse=True):
        item = np.array([n, 1.0, float(n) ** 2])
        best = None
        for left, content in bins:
            if (left >= item).all():
                share, need = left / room, item / room
                score = (share - need) ** 2 @ weights if capacity.rule == "residual_norm" else -(share @ (need * weights))
                if best is None or score < best[0] or score == best[0] and len(content) > len(best[2]):
                    best = (score, left, content)
        if best is None:
            best = (0, room.copy(), [])
            bins.append(best[1:])
        best[1][:] -= item
        best[2].append(n)
    return sorted(tuple(content) for _, content in bins)


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
@pytest.mark.parametrize("seed", range(6))
def test_counts_give_what_item_after_item_gives(rule, seed):
    rng = np.random.default_rng(seed)
    capacity = packing.Capacity(length=100, items=int(rng.integers(2, 9)), cost=float(rng.integers(5000, 10_001)), rule=rule)
    lengths = rng.choice(rng.integers(0, capacity.largest + 1, 12), 300)
    bins = packing.best_fit(lengths, capacity)
    assert sorted(tuple(sorted(lengths[bins == k].tolist(), reverse=True)) for k in range(bins.max() + 1)) == one_by_one(lengths, capacity)


def test_counts_of_any_size():
    """Runs, and the time, depend on lengths, not on how many items there are."""
    runs = packing.fit_counts(np.array([6000, 4000, 2500, 1900, 300]), np.array([10**9, 10**9, 10**9, 10**9, 10**9]), packing.Capacity())
    assert len(runs) < 40
    held = {}
    for length, start, n, _, _ in runs:
        assert start == held.get(length, 0)
        held[length] = start + n
    assert set(held.values()) == {10**9}


def test_every_constraint():
    lengths = np.array([10] * 40 + [50] * 10)
    bins = packing.best_fit(lengths, packing.Capacity(length=100, items=4, cost=2600.0))
    assert fill(lengths, bins).max() <= 100 and np.bincount(bins).max() <= 4 and fill(lengths.astype(float) ** 2, bins).max() <= 2600
    with pytest.raises(ValueError):
        packing.best_fit(np.array([60]), packing.Capacity(length=100, cost=2600.0))


@pytest.mark.parametrize("buckets", [7, 200_000])
def test_frames(spark, monkeypatch, buckets):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), f"d{i}", i % 7, rng.choice([0, None, 5, 900, 6000, 6001, 20_000]), "x") for i in range(400)]
    df = spark.createDataFrame(rows, "source string, doc_id string, page_number int, length long, start string")
    monkeypatch.setattr(packing, "BUCKET_ITEMS", buckets)
    got = packing.pack(df, "source", ["doc_id", "page_number"], "length").collect()
    per = {s: np.array([r.end - r.start for r in got if r.source == s]) for s in ("a", "b", None)}
    assert {s: len({r.container for r in got if r.source == s}) for s in per} == {s: packing.best_fit(x, packing.Capacity()).max() + 1 for s, x in per.items()}
    assert {(r.source, r.doc_id, r.page_number) for r in got} == {r[:3] for r in rows}
    sums, groups = {}, {}
    for r in got:
        sums[r.container] = sums.get(r.container, 0) + r.end - r.start
        groups.setdefault(r.container, set()).add(r.source)
    assert max(sums.values()) <= 6000 and all(len(s) == 1 for s in groups.values())
    parts = {}
    for r in got:
        parts.setdefault(r.doc_id, []).append((r.start, r.end))
    for _, doc, _, length, _ in rows:
        assert sum(e - s for s, e in parts[doc]) == (length or 0) and len(parts[doc]) == max(1, -(-(length or 0) // 6000))
    bounded = packing.Capacity(items=3, cost=0.5 * 6000.0**2)
    sums = {}
    for r in packing.pack(df, "source", ["doc_id", "page_number"], "length", bounded).collect():
        n, cost = sums.get(r.container, (0, 0))
        sums[r.container] = (n + 1, cost + (r.end - r.start) ** 2)
    assert max(n for n, _ in sums.values()) == 3 and 0.9 * bounded.cost < max(c for _, c in sums.values()) <= bounded.cost
    assert packing.pack(df.limit(0), "source", ["doc_id", "page_number"], "length").count() == 0


def test_page_lengths(spark):
    rows = [(1, "s", "d", 1, "text", "abc"), (1, "s", "d", 1, "text", "abc"), (2, "s", "d", 1, "text", ""), (3, "s", "d", 1, "table", "x" * 9), (4, "s", "d", 2, "text", None)]
    df = spark.createDataFrame(rows, "chunk_id long, source string, doc_id string, page_number int, type string, content string")
    assert [tuple(r) for r in packing.page_lengths(df).collect()] == [("s", "d", 1, 5)]
