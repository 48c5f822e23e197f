"""Ledgers built of deltas equal one built at once; lines against plain counting."""

import random
import re

from pyspark.sql import functions as F

from pagegrain.llm import sitelines

SCHEMA = "chunk_id long, source string, doc_id string, content string, key_a string"


def rows(seed=1, n=300):
    rng = random.Random(seed)
    lines = ["Share this page", "share  THIS page ", "Retrieved 12 times", "Retrieved 7 times", "", "  ", *(f"own line {c}" for c in "abcdefgh")]
    return [(i, rng.choice(["s", "t", None]), f"d{rng.randrange(12)}", rng.choice([None, "\n".join(rng.choice(lines) for _ in range(rng.randrange(6)))]), "x") for i in range(n)]


def normal(line):
    return " ".join(re.sub("[0-9]+", "0", line).lower().split())


def plain(data):
    docs, files = {}, {}
    for _, s, d, text, _ in data:
        if s is not None and d is not None:
            files.setdefault(s, set()).add(d)
            for line in (text or "").split("\n"):
                if normal(line):
                    docs.setdefault((s, normal(line)), set()).add(d)
    bad = {k for k, v in docs.items() if len(v) >= 3 and len(v) >= 0.2 * len(files[k[0]])}
    return sorted((i, n) for i, s, _, text, _ in data if text is not None for n, line in enumerate(text.split("\n")) if (s, normal(line)) in bad)


def ledger(spark, path, df, *conditions):
    got = sitelines.LineLedger.open(spark, str(path))
    before = got
    for c in conditions:
        part = df.where(c)
        before, got = got, sitelines.LineLedger.open(spark, str(path)).merge(sitelines.line_table(part), part)
    return before, got


def pairs(df):
    return sorted(map(tuple, df.select("chunk_id", "line_no").collect()))


def test_deltas_and_plain_counting(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data + data[:40], SCHEMA)
    _, once = ledger(spark, tmp_path / "once", df, "true")
    before, steps = ledger(spark, tmp_path / "steps", df, "chunk_id < 100", "chunk_id >= 90 and chunk_id < 250", "chunk_id >= 250")
    for found in (once, steps):
        assert pairs(found.occurrences(sitelines.line_table(df))) == plain(data)
    assert sorted(map(tuple, once.counts.collect())) == sorted(map(tuple, steps.counts.collect()))
    crossed = {tuple(r)[:3] for r in steps.crossed(before).collect()}
    old, new = ({tuple(r)[:3] for r in x.excessive().collect()} for x in (before, steps))
    assert crossed == old ^ new
    touched = {(r.source, r.doc_id) for r in steps.incidence.collect() if (r.source, r.key_a, r.key_b) in crossed}
    assert {tuple(r) for r in steps.to_rebuild(before).collect()} == touched
    assert not (tmp_path / "steps/counts/1").exists() and (tmp_path / "steps/counts/2").exists()


def test_a_delta_that_broke_off_is_done_anew(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    _, first = ledger(spark, tmp_path, df, "chunk_id < 100")
    first._write(sitelines.line_table(df).select(*sitelines.LINE, "doc_id").limit(5), "incidence", 2)  # of a driver that died
    after = sitelines.LineLedger.open(spark, str(tmp_path))
    assert after.version == 1
    rest = df.where("chunk_id >= 100")
    assert pairs(after.merge(sitelines.line_table(rest), rest).occurrences(sitelines.line_table(df))) == plain(data)


def test_deltas_through_logs(spark, tmp_path):
    """Cleaned partition by partition with crossings either way, equal to cleaning all at once; untouched documents aren't written again."""
    from datetime import datetime

    from pagegrain.llm.queries import site_line_deltas

    data = [(i, s, d, text, datetime(2023, 1 + 3 * (i % 4), 5)) for i, s, d, text, _ in rows(5, 240)]
    data += [(1000 + i, "u", f"u{i}", "Notice\nown" if i < 3 else "other", datetime(2023, 2 if i < 4 else 5, 1)) for i in range(24)]  # excessive in the first quarter, no more in the second
    data += [(2000, "u", None, "Notice", None), (2001, None, "x", "Notice", datetime(2023, 2, 1))]
    df = spark.createDataFrame(data, "chunk_id long, source string, doc_id string, content string, ingested_at timestamp").withColumn("type", F.lit("text"))
    df = df.unionByName(df.where("chunk_id < 30").withColumn("ingested_at", F.lit(datetime(2023, 9, 1))))
    known = [(i, s, d, text, None) for i, s, d, text, _ in data if d is not None and s is not None]
    ledger_, log, rebuilt = site_line_deltas(spark, df, str(tmp_path / "a"), with_text=False)
    assert pairs(log.current()) == plain(known)
    assert ledger_.version == 5 and any(r.count() for r in rebuilt[2:])
    assert ("u", "u0") in {(r.source, r.doc_id) for r in rebuilt[2].collect()}
    _, log, _ = site_line_deltas(spark, df, str(tmp_path / "b"), with_text=True)
    gone = {}
    for i, n in plain(known):
        gone.setdefault(i, set()).add(n)
    want = {i: text if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone.get(i, ())) for i, _, _, text, _ in data}
    got = log.current().collect()
    assert {r.chunk_id: r.content for r in got} == want and len(got) == len(want)
    assert spark.read.parquet(str(tmp_path / "b/log/docs/version=5")).count() < 40


def test_cleaned(spark, tmp_path):
    data = rows(3, 120)
    df = spark.createDataFrame(data, SCHEMA)
    _, found = ledger(spark, tmp_path, df, "true")
    gone = {}
    for i, n in plain(data):
        gone.setdefault(i, set()).add(n)
    got = {r.chunk_id: r.content for r in sitelines.without_lines(df, found.occurrences(sitelines.line_table(df))).collect()}
    assert got == {i: text if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone.get(i, ())) for i, _, _, text, _ in data}


def test_large_sets_are_joined_without_broadcast(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sitelines, "BROADCAST_LINES", 0)
    monkeypatch.setattr(sitelines, "BROADCAST_DOCS", 0)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    _, found = ledger(spark, tmp_path, df, "chunk_id < 100", "chunk_id >= 50")
    assert pairs(found.occurrences(sitelines.line_table(df))) == plain(data)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], SCHEMA)
    before, found = ledger(spark, tmp_path, df, F.lit(True), F.lit(True))
    assert found.version == 2 and found.occurrences(sitelines.line_table(df)).count() == found.to_rebuild(before).count() == 0
