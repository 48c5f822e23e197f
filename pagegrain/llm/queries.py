"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.functions.text import normalize
from pagegrain.llm import confusables, mixing, packing, quality, reading, sitelines, splitting, tokens
from pagegrain.runtime import materialize, once, scratch_path, table

Query = Callable[[SparkSession, str], DataFrame]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("type = 'text'")


def _distinct_texts(spark: SparkSession, d: str, column: str = "content") -> DataFrame:
    return once(_texts(spark, d).select("chunk_id", column), ["chunk_id"])


# 1: look-alike texts
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_alike_pairs(_texts(spark, d), "doc_id", "chunk_id", "content")


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """All of ``content_raw`` in one form: the minimal normalisation, then the skeleton."""
    texts = _distinct_texts(spark, d, "content_raw").select("chunk_id", normalize(F.col("content_raw")).alias("text"))
    return confusables.skeletons(texts, ["chunk_id"], "text").select("chunk_id", "skeleton")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = confusables.look_classes(_texts(spark, d), "doc_id", "chunk_id", "content")
    return rows.select("doc_id", "chunk_id", F.lower(F.hex("look")).alias("class_id"), F.lower(F.hex("form")).alias("form_id"), "n_forms", "n_links")


# 2: splitting
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(_texts(spark, d), "chunk_id", "content", with_text=False)
    return pieces.where("piece_no = 1").select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_distinct_texts(spark, d), "chunk_id", "content")


def p2_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The texts put together again from their pieces, each without its overlap; and the largest piece's and the least overlap's length."""
    pieces = p2_pieces(spark, d).withColumn("fresh", F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.expr("substring(piece, 101)")))
    texts = pieces.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "fresh"))).alias("ps"), (F.max(F.length("piece")) <= 1000).alias("within_limit"))
    return texts.select("chunk_id", F.array_join(F.transform("ps", lambda p: p["fresh"]), "").alias("content"), "within_limit")


# 3: quality
def _statistics(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "common_words")
    measured = materialize(quality.figures(_texts(spark, d), words, quality.train(table(spark, d, "quality_samples"), words)), "figures")
    return quality.document_statistics(measured, quality.repetition(measured), quality.dominant_grams(_texts(spark, d), measured, quality.TOP_GRAM))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(spark, d).where(~F.col("is_prose")).select("doc_id")


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(spark, d)


def p3_repetition(spark: SparkSession, d: str) -> DataFrame:
    """Repeated lines, paragraphs and dominant pairs of words of all documents, the latter however small their share."""
    measured = materialize(quality.figures(_texts(spark, d), table(spark, d, "common_words")), "figures")
    rows = quality.document_statistics(measured, quality.repetition(measured), quality.dominant_grams(_texts(spark, d), measured, 0.0))
    return rows.select("doc_id", "n_chars", "word_count", "mean_word_length", "ended_line_share", "common_word_share", "repeated_line_share", "repeated_paragraph_share", "top_gram_share")


# 4: packing
#: Containers of few documents and half the attention cost of one that a single text fills: both bounds bind.
BOUNDED = packing.Capacity(items=4, cost=0.5 * 6000.0**2)


def _packed(spark: SparkSession, d: str, capacity: packing.Capacity = packing.Capacity()) -> DataFrame:
    pages = materialize(packing.page_lengths(table(spark, d, "chunks")), "page-lengths")
    return packing.pack(pages, "source", ["doc_id", "page_number"], "length", capacity)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose parts had to be put into several containers."""
    return _packed(spark, d).groupBy("doc_id", "page_number").agg(F.count_distinct("container").alias("n")).where("n > 1").select("doc_id", "page_number")


def p4_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p4_bounded(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, BOUNDED)


def p4_bins(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the packing for each source: its characters, whether its containers keep their capacity, and their number what falling best-fit guarantees."""
    bins = _packed(spark, d).groupBy("source", "container").agg(F.sum(F.col("end") - F.col("start")).alias("chars"))
    sums = bins.groupBy("source").agg(F.sum("chars").alias("n_chars"), F.count(F.lit(1)).alias("n_bins"), F.max("chars").alias("fullest"))
    return sums.select("source", "n_chars", (F.col("fullest") <= 6000).alias("within_capacity"), (F.col("n_bins") * 9 <= F.ceil(F.col("n_chars") / 6000) * 11 + 9).alias("within_guarantee"))


# 5: site lines
def _quarter() -> Column:
    """The partition of a chunk: the quarter in which it arrived; those without a time come with the first."""
    return F.coalesce(F.date_format(F.date_trunc("quarter", "ingested_at"), "yyyy-MM"), F.lit("0000-00"))


def site_line_deltas(spark: SparkSession, chunks: DataFrame, path: str, with_text: bool, min_docs: int = sitelines.MIN_DOCS, min_share: float = sitelines.MIN_SHARE) -> tuple[sitelines.LineLedger, sitelines.DocumentLog, DataFrame]:
    """Chunks, partition by partition, through a ledger of their lines: the ledger, the log of what was rebuilt, and the names of the documents rebuilt in each.

    The log holds ``chunk_id, line_no`` of excessive lines, or with ``with_text`` each
    chunk's content without them. After each partition only documents are done again that it
    touches or that hold a line which crossed the threshold.
    """
    chunks = chunks.withColumn("quarter", _quarter())
    texts = chunks.where("type = 'text'")
    if with_text:
        texts = once(texts.select("chunk_id", "source", "doc_id", "content", "quarter"), ["chunk_id"])
    lines = materialize(sitelines.line_table(texts, ["quarter"]), "lines", by="quarter")
    files = materialize(chunks.select("source", "doc_id", "quarter").distinct(), "files", by="quarter")
    ledger, log, rebuilt = sitelines.LineLedger.open(spark, f"{path}/ledger", min_docs, min_share), sitelines.DocumentLog(spark, f"{path}/log"), []
    for quarter in sorted(r.quarter for r in files.select("quarter").distinct().collect()):  # one for each quarter of a year
        before, now, so_far = ledger, F.col("quarter") == quarter, F.col("quarter") <= quarter
        ledger = before.merge(lines.where(now), files.where(now))
        crossed = materialize(ledger.to_rebuild(before), "to-rebuild")
        redo = materialize(crossed.unionByName(files.where(now).select("source", "doc_id")).distinct(), "redo")
        found = ledger.occurrences(sitelines.of_documents(lines.where(so_far), redo))
        if with_text:
            part = sitelines.of_documents(texts.where(so_far).select("chunk_id", "source", "doc_id", "content"), redo)
            found = sitelines.without_lines(part, materialize(found, "found"))
        log.put(ledger.version, redo, found)
        rebuilt.append(crossed.withColumn("quarter", F.lit(quarter)))
    return ledger, log, rebuilt


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    _, log, _ = site_line_deltas(spark, table(spark, d, "chunks"), scratch_path(spark, "site-lines"), with_text=False)
    return log.current().select("chunk_id", "line_no")


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    _, log, _ = site_line_deltas(spark, table(spark, d, "chunks"), scratch_path(spark, "site-lines"), with_text=True)
    return log.current().select("chunk_id", "content")


def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Documents rebuilt as a line crossed the threshold, by partition; the first one's are those cleaned at all."""
    *_, rebuilt = site_line_deltas(spark, table(spark, d, "chunks"), scratch_path(spark, "site-lines"), with_text=False)
    return reduce(DataFrame.unionByName, rebuilt)


# 7: tokens
def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_ids(table(spark, d, "documents"), "doc_id", "text")


# 8: mixing
def _sizes(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "mix_targets").select("source").where("source is not null").distinct()
    listed = table(spark, d, "documents").select("doc_id", "source", "text").join(F.broadcast(wanted), "source", "left_semi")
    return materialize(tokens.count_tokens(listed, "text"), "token-counts")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose tokens, as their schedule asks for them, are used up before training ends."""
    return mixing.source_plan(_sizes(spark, d), table(spark, d, "mix_targets")).where("not can_reach").select("source")


def p8_phases(spark: SparkSession, d: str) -> DataFrame:
    """A mix by schedules that are given: in turns of the targets, sources that fade out by two thirds of training, that come in then, and that stay."""
    targets = table(spark, d, "mix_targets")
    turn = F.pmod(F.xxhash64("source"), F.lit(3))
    weights = F.when(turn == 0, F.array(*map(F.lit, (2.0, 2.0, 0.0, 0.0)))).when(turn == 1, F.array(*map(F.lit, (0.0, 0.5, 2.0, 2.0)))).otherwise(F.array(*[F.lit(1.0)] * 4))
    schedules = targets.select("source", F.posexplode(weights).alias("k", "weight")).select("source", (F.col("k") / 3).alias("time"), "weight")
    return mixing.mix(_sizes(spark, d), targets, schedules=schedules)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = _sizes(spark, d), table(spark, d, "mix_targets")
    reached = [mixing.shares(mixing.mix(sizes, targets, budget=b), mixing.source_plan(sizes, targets, b)).withColumn("budget", F.lit(b)) for b in ("total", "feasible")]
    return reached[0].unionByName(reached[1])


# 9: reading level
def _bands(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return reading.reading_bands(documents, reading.train(documents, table(spark, d, "reading_samples")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d).select("doc_id", "reading_band")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    return _bands(spark, d)


QUERIES: dict[str, Query] = {
    "p1_found": p1_found, "p1_forms": p1_forms, "p1_classes": p1_classes,
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_rejoined": p2_rejoined,
    "p3_found": p3_found, "p3_statistics": p3_statistics, "p3_repetition": p3_repetition,
    "p4_found": p4_found, "p4_containers": p4_containers, "p4_bounded": p4_bounded, "p4_bins": p4_bins,
    "p5_found": p5_found, "p5_cleaned": p5_cleaned, "p5_rebuilt": p5_rebuilt,
    "p7_ids": p7_ids,
    "p8_found": p8_found, "p8_mix": p8_mix, "p8_phases": p8_phases, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_profile": p9_profile,
}

_LINES = r"""
WITH texts AS (SELECT DISTINCT chunk_id, doc_id, source, content FROM chunks WHERE type = 'text' AND content IS NOT NULL),
split AS (SELECT chunk_id, doc_id, source, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM texts),
lines AS (SELECT chunk_id, doc_id, source, line_no,
  trim(regexp_replace(lower(regexp_replace(line, '[0-9]+', '0', 'g')), '[\t\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS line FROM split),
files AS (SELECT source, count(DISTINCT doc_id) AS n_files FROM chunks GROUP BY source),
many AS (SELECT source, line, count(DISTINCT doc_id) AS n_docs FROM lines WHERE line <> '' GROUP BY source, line),
excessive AS (SELECT source, line FROM many JOIN files USING (source) WHERE n_docs >= 3 AND n_docs >= n_files * 0.2::DOUBLE)
"""

_REBUILT = _LINES.split("files AS (")[0].replace("SELECT DISTINCT chunk_id, doc_id, source, content FROM", "SELECT DISTINCT chunk_id, doc_id, source, content, strftime(date_trunc('quarter', ingested_at), '%Y-%m') AS quarter FROM").replace("doc_id, source, unnest", "doc_id, source, quarter, unnest").replace("doc_id, source, line_no,", "doc_id, source, quarter, line_no,") + """
known AS (SELECT DISTINCT source, doc_id, strftime(date_trunc('quarter', ingested_at), '%Y-%m') AS quarter FROM chunks),
upto AS (SELECT DISTINCT quarter AS q FROM known),
files AS (SELECT q, source, count(DISTINCT doc_id) AS n_files FROM known, upto WHERE quarter <= q GROUP BY ALL),
held AS (SELECT DISTINCT q, source, line, doc_id FROM lines, upto WHERE quarter <= q AND line <> ''),
many AS (SELECT q, source, line, count(*) AS n_docs FROM held GROUP BY ALL),
excessive AS (SELECT q, source, line FROM many JOIN files USING (q, source) WHERE n_docs >= 3 AND n_docs >= n_files * 0.2::DOUBLE),
before AS (SELECT u.q, source, line FROM excessive e JOIN (SELECT q, lag(q) OVER (ORDER BY q) AS p FROM upto) u ON e.q = u.p),
crossed AS ((SELECT * FROM excessive EXCEPT SELECT * FROM before) UNION (SELECT * FROM before EXCEPT SELECT * FROM excessive))
SELECT DISTINCT q AS quarter, source, doc_id FROM held JOIN crossed USING (q, source, line)
"""
_BLANK_SIGNS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_REPETITION = rf"""
WITH texts AS (SELECT DISTINCT chunk_id, doc_id, content FROM chunks WHERE type = 'text' AND content IS NOT NULL),
worded AS (SELECT chunk_id, doc_id, content, list_filter(string_split_regex(content, '{_BLANK_SIGNS}'), lambda w: w <> '') AS ws FROM texts),
lowered AS (SELECT *, list_transform(ws, lambda w: lower(trim(w, '.,;:!?()[]"''«»'))) AS ls, list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda x: trim(x)), lambda x: x <> '') AS paragraphs FROM worded),
sums AS (SELECT doc_id, sum(length(content))::BIGINT AS n_chars, sum(len(ws))::BIGINT AS word_count, sum(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)) AS word_chars, sum(len(lines)) AS n_lines,
  sum(len(list_filter(lines, lambda x: contains('.!?。！？;:,、；：，', right(x, 1))))) AS n_ended, sum(len(list_filter(ls, lambda w: list_contains(known, w)))) AS n_common FROM lowered, (SELECT list(DISTINCT lower(word)) AS known FROM common_words) GROUP BY doc_id),
parts AS (SELECT doc_id, 'line' AS kind, unnest(lines) AS part FROM lowered UNION ALL SELECT doc_id, 'paragraph', unnest(paragraphs) FROM lowered),
again AS (SELECT doc_id, coalesce(sum((n - 1) * length(part)) FILTER (kind = 'line') / sum(n * length(part)) FILTER (kind = 'line'), 0)::DOUBLE AS l, coalesce(sum((n - 1) * length(part)) FILTER (kind = 'paragraph') / sum(n * length(part)) FILTER (kind = 'paragraph'), 0)::DOUBLE AS p
  FROM (SELECT doc_id, kind, part, count(*) AS n FROM parts GROUP BY ALL) GROUP BY doc_id),
grams AS (SELECT doc_id, unnest(list_zip(ls[:-2], ls[2:])) AS g FROM lowered WHERE len(ls) > 1),
top AS (SELECT doc_id, max(n * (length(g[1]) + length(g[2]) + 1)) AS chars FROM (SELECT doc_id, g, count(*) AS n FROM grams GROUP BY ALL) WHERE n > 1 GROUP BY doc_id)
SELECT doc_id, n_chars, word_count, CASE WHEN word_count > 0 THEN word_chars / word_count ELSE 0 END::DOUBLE AS mean_word_length, CASE WHEN n_lines > 0 THEN n_ended / n_lines ELSE 0 END::DOUBLE AS ended_line_share, CASE WHEN word_count > 0 THEN n_common / word_count ELSE 0 END::DOUBLE AS common_word_share,
  coalesce(l, 0) AS repeated_line_share, coalesce(p, 0) AS repeated_paragraph_share, coalesce(least(1, chars / n_chars), 0)::DOUBLE AS top_gram_share FROM sums LEFT JOIN again USING (doc_id) LEFT JOIN top USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE type = 'text' AND length(content) > 1000",
    "p4_found": """SELECT doc_id, page_number FROM (SELECT DISTINCT chunk_id, doc_id, page_number, length(content) AS n FROM chunks WHERE type = 'text' AND content IS NOT NULL)
GROUP BY doc_id, page_number HAVING sum(n) + 2 * (count(*) - 1) > 6000""",
    "p3_repetition": _REPETITION,
    "p2_rejoined": "SELECT DISTINCT chunk_id, content, true AS within_limit FROM chunks WHERE type = 'text' AND content IS NOT NULL",
    "p5_rebuilt": _REBUILT,
    "p4_bins": """SELECT source, sum(n)::BIGINT AS n_chars, true AS within_capacity, true AS within_guarantee FROM (SELECT min(source) AS source, sum(n) + 2 * (count(*) - 1) AS n FROM
(SELECT DISTINCT chunk_id, source, doc_id, page_number, length(content) AS n FROM chunks WHERE type = 'text' AND content IS NOT NULL) GROUP BY doc_id, page_number) GROUP BY source""",
    "p5_cleaned": _LINES + """, kept AS (SELECT s.chunk_id, string_agg(s.line, chr(10) ORDER BY s.line_no) AS content FROM split s LEFT JOIN (SELECT DISTINCT chunk_id, line_no FROM lines JOIN excessive USING (source, line)) g USING (chunk_id, line_no) WHERE g.chunk_id IS NULL GROUP BY s.chunk_id)
SELECT chunk_id, CASE WHEN c.content IS NOT NULL THEN coalesce(k.content, '') END AS content FROM (SELECT DISTINCT chunk_id, content FROM chunks WHERE type = 'text') c LEFT JOIN kept k USING (chunk_id)""",
    "p5_found": _LINES + "SELECT DISTINCT chunk_id, CAST(line_no AS INTEGER) AS line_no FROM lines JOIN excessive USING (source, line)",
}
