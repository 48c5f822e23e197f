"""Shares, caps and positions of a mix."""

import random

import pytest

from pagegrain.llm import mixing


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(6)
    sizes = [(s, i * 10 + k, rng.randrange(0, 900)) for k, (s, n) in enumerate([("big", 900), ("mid", 300), ("small", 40), ("other", 50), (None, 9)]) for i in range(n)]
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3), ("none", 0.0, None), ("big", 0.5, 1), (None, 0.4, 1)]
    return sizes, spark.createDataFrame(sizes, "source string, doc_id long, n_tokens long"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int")


def total(sizes, *sources):
    return sum(n for s, _, n in sizes if s in sources)


def test_plan(tables):
    sizes, df, targets = tables
    plan = {r.source: r for r in mixing.source_plan(df, targets).collect()}
    everything = total(sizes, "big", "mid", "small")
    assert set(plan) == {"big", "mid", "small", "none"}
    for name, share, repeats in (("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)):
        assert plan[name].tokens == total(sizes, name)
        assert plan[name].can_reach == (total(sizes, name) * repeats >= share * everything)
    assert abs(sum(r.slope * r.target_share for r in plan.values())) < 1e-9


@pytest.mark.parametrize("budget", ["feasible", "total"])
def test_mix(spark, tables, budget, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 50)
    sizes, df, targets = tables
    rows = mixing.mix(df, targets, budget=budget).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert len({(r.doc_id, r.round) for r in rows}) == len(rows)
    caps = {"big": 1, "mid": 2, "small": 3}
    assert all(r.round < caps[r.source] and 0 <= r.position <= 1 for r in rows)
    plan = mixing.source_plan(df, targets, budget)
    got = {r.source: r for r in mixing.shares(spark.createDataFrame(rows), plan).collect()}
    for r in plan.collect():
        assert abs(got[r.source].mixed_tokens - r.planned) <= 900
    if budget == "feasible":
        assert all(abs(got[s].reached_share - share) < 0.01 for s, share in (("big", 0.5), ("mid", 0.3), ("small", 0.2)))


def test_schedule(spark, tables):
    """Halfway through, a source has given the integral of its weight."""
    _, df, targets = tables
    rows = mixing.mix(df, targets).collect()
    for r in mixing.source_plan(df, targets, "feasible").where("tokens > 0").collect():
        half = sum(x.n_tokens for x in rows if x.source == r.source and x.position <= 0.5)
        assert abs(half - r.planned * (0.5 - 0.25 * r.slope)) <= 900


def area(knots, until):
    """The integral of straight lines between knots up to a time, by many small steps."""
    import numpy as np

    x = np.linspace(0, until, 20_001)
    return float(np.trapezoid(np.interp(x, *zip(*knots, strict=True)), x))


def test_given_schedules(spark, tables):
    """At every time a source has given the integral of its weights; weights of 0 give nothing."""
    _, df, targets = tables
    knots = {"big": [(0.0, 3.0), (0.5, 0.0), (0.75, 0.0), (1.0, 1.0)], "mid": [(0.3, 0.0), (0.6, 5.0)], "small": [(0.5, 0.0)]}
    rows = [(s, t, w) for s, ks in knots.items() for t, w in ks] + [(None, 0.5, 1.0), ("big", None, 1.0), ("other", 0.1, 1.0)]
    schedules = spark.createDataFrame(rows, "source string, time double, weight double")
    used = mixing.mix(df, targets, schedules=schedules).collect()
    plan = {r.source: r for r in mixing.source_plan(df, targets, "feasible", schedules).collect()}
    assert all(abs(sum(x.n_tokens for x in used if x.source == s) - plan[s].planned) <= 900 for s in ("big", "mid", "small"))
    for s in ("big", "mid"):
        for t in (0.1, 0.3, 0.5, 0.7, 0.9):
            got = sum(x.n_tokens for x in used if x.source == s and x.position <= t)
            assert abs(got - plan[s].planned * area(knots[s], t) / area(knots[s], 1.0)) <= 910
    assert not [x for x in used if x.source == "big" and 0.51 < x.position < 0.74] and not [x for x in used if x.source == "mid" and x.position < 0.3]
    assert len(plan["small"].segments) == 1  # without a weight above 0 as without a schedule
    whole = mixing.source_plan(df, targets, schedules=schedules).collect()
    assert {r.source: r.can_reach for r in whole} == {r.source: r.can_reach for r in mixing.source_plan(df, targets).collect()}


def test_sources_run_out_as_their_schedule_asks(spark, tables):
    sizes, df, targets = tables
    everything = total(sizes, "big", "mid", "small")
    for r in mixing.source_plan(df, targets).collect():
        if r.target_share > 0:
            share = min(1.0, r.tokens * r.max_repeats / (r.target_share * everything))
            knots = [(0.0, 1 - r.slope), (1.0, 1 + r.slope)]
            assert abs(area(knots, r.exhausted_at) - share) < 1e-6 and (r.exhausted_at < 1) == (not r.can_reach)


def test_running_demand(tables, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    sizes, df, _ = tables
    rows = sorted(mixing.running_demand(df.where("source = 'mid'")).collect(), key=lambda r: (r.before, r.n_tokens))
    at = 0
    for r in rows:
        assert r.before == at
        at += r.n_tokens
    assert at == total(sizes, "mid")


def test_empty(tables):
    _, df, targets = tables
    assert mixing.mix(df.limit(0), targets).count() == 0
    assert {r.tokens for r in mixing.source_plan(df.limit(0), targets).collect()} == {0}
    assert mixing.mix(df, targets.limit(0)).count() == 0
