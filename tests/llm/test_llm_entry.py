"""Queries of the subpackage with SQL give the SQL's rows; all of them run."""

from pathlib import Path

import duckdb
import pytest

from pagegrain.llm import packing
from pagegrain.llm.queries import ORACLES, QUERIES
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, DATA)
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(con.execute(f"SELECT {', '.join(sorted(df.columns))} FROM ({ORACLES[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()


def test_pairs_are_the_links_of_classes(spark):
    pairs = {tuple(r) for r in QUERIES["p1_found"](spark, DATA).collect()}
    classes = QUERIES["p1_classes"](spark, DATA).collect()
    assert 2 * len(pairs) == sum(r.n_links for r in classes) and {x for p in pairs for x in p} == {r.chunk_id for r in classes}
    of = {r.chunk_id: (r.doc_id, r.class_id, r.form_id) for r in classes}
    assert all(of[a][:2] == of[b][:2] and of[a][2] != of[b][2] and a < b for a, b in pairs)


def test_forms_of_raw_texts_are_those_of_the_clean_ones(spark):
    from pagegrain.llm.confusables import skeleton

    texts = {r.chunk_id: r.content for r in spark.read.parquet(f"{DATA}/chunks.parquet").where("type = 'text'").collect()}
    got = QUERIES["p1_forms"](spark, DATA).collect()
    assert {r.chunk_id: r.skeleton for r in got} == {i: skeleton(t) for i, t in texts.items()} and len(got) == len(texts)


@pytest.mark.parametrize(("name", "items", "cost"), [("p4_containers", 256, 6000**2), ("p4_bounded", 4, 6000**2 // 2)])
def test_containers_keep_every_capacity_and_hold_every_page_once(spark, name, items, cost):
    rows = QUERIES[name](spark, DATA).collect()
    bins, parts = {}, {}
    for r in rows:
        bins.setdefault(r.container, []).append(r)
        parts.setdefault((r.doc_id, r.page_number), []).append((r.start, r.end))
    for held in bins.values():
        sizes = [r.end - r.start for r in held]
        assert sum(sizes) <= 6000 and len(sizes) <= items and sum(n * n for n in sizes) <= cost and len({r.source for r in held}) == 1
    lengths = {(r.doc_id, r.page_number): r.length for r in packing.page_lengths(spark.read.parquet(f"{DATA}/chunks.parquet")).collect()}
    assert set(parts) == set(lengths)
    for page, spans in parts.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == lengths[page] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert (len(spans) > 1) <= (lengths[page] > 6000 or name == "p4_bounded")


@pytest.mark.parametrize("name", ["p8_mix", "p8_phases"])
def test_mixes_keep_shares_repeats_and_order(spark, name):
    rows = QUERIES[name](spark, DATA).collect()
    targets = {r.source: r for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").collect()}
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 and r.round < targets[r.source].max_repeats for r in rows)
    assert len({(r.doc_id, r.round) for r in rows}) == len(rows)
    total, largest = sum(r.n_tokens for r in rows), max(r.n_tokens for r in rows)
    for source, t in targets.items():
        assert abs(sum(r.n_tokens for r in rows if r.source == source) - t.target_share * total) <= 1.5 * largest


def test_found_are_those_of_the_full_results(spark):
    bad = {r.doc_id for r in QUERIES["p3_statistics"](spark, DATA).where("not is_prose").collect()}
    assert {r.doc_id for r in QUERIES["p3_found"](spark, DATA).collect()} == bad
    profile = {r.doc_id: r.reading_band for r in QUERIES["p9_profile"](spark, DATA).collect()}
    assert {r.doc_id: r.reading_band for r in QUERIES["p9_found"](spark, DATA).collect()} == profile
    short = {r.source for r in QUERIES["p8_shares"](spark, DATA).where("budget = 'total' and not can_reach").collect()}
    assert {r.source for r in QUERIES["p8_found"](spark, DATA).collect()} == short


@pytest.mark.parametrize("name", ["p1_forms", "p2_pieces"])
def test_texts_are_not_shuffled_for_their_repeats(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan and "MapInArrow" in plan
