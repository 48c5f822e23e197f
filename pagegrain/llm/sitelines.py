"""Lines repeated across one source's documents.

A ledger per corpus holds which document has which line and how many documents of
each source have it, in a folder that outlives the process. New partitions are
merged as deltas: only incidences the ledger lacks raise its counts. After each
delta the lines that crossed the threshold, either way, are known, and only
documents with such lines, and those the delta touched, are rebuilt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.runtime import delete, exists, materialize, small_side, within

#: The white space besides the line feed.
BLANKS = r"[\t\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
LINE = ["source", "key_a", "key_b"]
MIN_DOCS, MIN_SHARE = 3, 0.2
#: Lines and documents are broadcast up to so many; beyond it the join is shuffled, that by lines in so many salts.
BROADCAST_LINES, BROADCAST_DOCS, SALTS = 200_000, 200_000, 16


def normal_line(line: Column) -> Column:
    """Digit runs as one sign, lower case, single blanks, none outside."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, "[0-9]+", "0")), BLANKS, " "))


def line_table(chunks: DataFrame, extra: list[str] = []) -> DataFrame:
    """``chunk_id, line_no, source, doc_id, key_a, key_b``: the lines that aren't empty.

    Lines are split at line feeds and counted from 0. A line is named by a
    128-bit key. Rows with null content, source or doc_id have no lines.
    """
    rows = chunks.where("content is not null and source is not null and doc_id is not null")
    lines = rows.select("chunk_id", "source", "doc_id", *extra, F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", normal_line(F.col("line"))).where("line <> ''")
    return lines.select("chunk_id", "line_no", "source", "doc_id", *extra, F.xxhash64("line").alias("key_a"), F.xxhash64(F.lit("b"), F.reverse("line")).alias("key_b"))


def _spread(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` of the given ``lines`` (a stored table without repeats).

    Up to ``BROADCAST_LINES`` lines are broadcast. Beyond it each line is put out
    ``SALTS`` times and the rows of a line meet its copies by turns, as one line may be in a
    third of all rows.
    """
    if within(lines, BROADCAST_LINES):
        return rows.join(F.broadcast(lines), LINE, "left_semi")
    salted = lines.select(*LINE).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    turn = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", turn).join(salted, [*LINE, "__salt"], "left_semi").drop("__salt")


def of_documents(rows: DataFrame, docs: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` of the given documents (a stored table of ``source, doc_id`` without repeats); null ones are documents too."""
    marks = docs.select(F.col("source").alias("__s"), F.col("doc_id").alias("__d"))
    return rows.join(small_side(marks, BROADCAST_DOCS), F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d")), how)


@dataclass(frozen=True)
class LineLedger:
    """Which document has which line, and in how many documents of its source each line is, after some deltas.

    It lives in ``path``, a folder that all executors share, and outlives its
    process: ``open`` goes on where the last whole delta ended. Each delta appends
    what is new; only the counts, without documents, and what follows from them are written whole.

    ``incidence``: source, key_a, key_b, doc_id, without repeats.
    ``counts``: source, key_a, key_b, n_docs.
    ``files``: source, doc_id, without repeats; ``totals``: source, n_files.
    ``excessive``: source, key_a, key_b, n_docs, n_files, over the threshold now.
    """

    spark: SparkSession
    path: str
    version: int = 0
    min_docs: int = MIN_DOCS
    min_share: float = MIN_SHARE

    @staticmethod
    def open(spark: SparkSession, path: str, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> LineLedger:
        """The ledger in ``path``, with the thresholds it was begun with; a new, empty one if there is none."""
        if not exists(spark, f"{path}/done"):
            return LineLedger(spark, path, 0, min_docs, min_share)
        last = spark.read.parquet(f"{path}/done").orderBy(F.desc("version")).first()
        return LineLedger(spark, path, last.version, last.min_docs, last.min_share)

    def _read(self, name: str, whole: bool = True) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{name}/{v}" for v in range(1 if whole else self.version, self.version + 1)))

    def _write(self, df: DataFrame, name: str, version: int) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/{version}")

    @property
    def incidence(self) -> DataFrame:
        return self._read("incidence")

    @property
    def counts(self) -> DataFrame:
        return self._read("counts", whole=False)

    @property
    def files(self) -> DataFrame:
        return self._read("files")

    @property
    def totals(self) -> DataFrame:
        return self.files.groupBy("source").agg(F.count(F.lit(1)).alias("n_files"))

    def merge(self, lines: DataFrame, files: DataFrame) -> LineLedger:
        """The ledger after one more delta: its lines and its documents. A line seen again in a known document adds nothing.

        A delta that broke off is done anew; its parts are overwritten. The counts
        of the version before are kept, older ones are deleted.
        """
        after = LineLedger(self.spark, self.path, self.version + 1, self.min_docs, self.min_share)
        new, fresh = lines.select(*LINE, "doc_id").distinct(), files.where("source is not null and doc_id is not null").select("source", "doc_id").distinct()
        if self.version:
            known = of_documents(self.incidence, materialize(fresh, "delta-files"))  # only documents of the delta can hold its lines already
            new, fresh = new.join(known, [*LINE, "doc_id"], "left_anti"), fresh.join(self.files, ["source", "doc_id"], "left_anti")
        self._write(new, "incidence", after.version)
        self._write(fresh, "files", after.version)
        added = after.spark.read.parquet(f"{self.path}/incidence/{after.version}").groupBy(*LINE).agg(F.count(F.lit(1)).alias("n_docs"))
        if self.version:
            added = self.counts.unionByName(added).groupBy(*LINE).agg(F.sum("n_docs").alias("n_docs"))
        self._write(added, "counts", after.version)
        likely = after.counts.where(F.col("n_docs") >= self.min_docs).join(after.totals, "source")
        self._write(likely.where(F.col("n_docs") >= F.col("n_files") * self.min_share), "excessive", after.version)
        self.spark.createDataFrame([(after.version, self.min_docs, self.min_share)], "version int, min_docs int, min_share double").coalesce(1).write.mode("append").parquet(f"{self.path}/done")
        if self.version > 1:
            for name in ("counts", "excessive"):
                delete(self.spark, f"{self.path}/{name}/{self.version - 1}")
        return after

    def excessive(self) -> DataFrame:
        """``source, key_a, key_b, n_docs, n_files`` of the lines over the threshold, as the last merge found them."""
        if not self.version:
            return self.spark.createDataFrame([], "source string, key_a bigint, key_b bigint, n_docs bigint, n_files bigint")
        return self._read("excessive", whole=False)

    def crossed(self, before: LineLedger) -> DataFrame:
        """``source, key_a, key_b, now``: lines excessive now and not before (now = true), or the reverse."""
        old, new = before.excessive().select(*LINE), self.excessive().select(*LINE)
        return new.join(old, LINE, "left_anti").withColumn("now", F.lit(True)).unionByName(old.join(new, LINE, "left_anti").withColumn("now", F.lit(False)))

    def to_rebuild(self, before: LineLedger) -> DataFrame:
        """``source, doc_id``: the documents that hold a line which crossed the threshold."""
        crossed = materialize(self.crossed(before).select(*LINE), "line-crossed")
        return _spread(self.incidence, crossed).select("source", "doc_id").distinct()

    def occurrences(self, lines: DataFrame) -> DataFrame:
        """``chunk_id, line_no, source, doc_id``: every excessive line among ``lines``, repeats once."""
        return _spread(lines, materialize(self.excessive().select(*LINE), "line-excessive")).select("chunk_id", "line_no", "source", "doc_id").distinct()


@dataclass(frozen=True)
class DocumentLog:
    """Rows of documents that are redone now and then, in ``path``, a folder that all executors share.

    Each version appends the rows of the documents it redoes, and their names; what
    is current of a document is what its last version gave. Documents that a
    version doesn't touch aren't written again.
    """

    spark: SparkSession
    path: str

    def put(self, version: int, docs: DataFrame, rows: DataFrame) -> None:
        """``docs`` (source, doc_id) are redone in this version, ``rows`` is all that they have now."""
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/rows/version={version}")
        docs.write.mode("overwrite").parquet(f"{self.path}/docs/version={version}")

    def current(self) -> DataFrame:
        rows, docs = (self.spark.read.parquet(f"{self.path}/{name}") for name in ("rows", "docs"))
        last = docs.groupBy(F.col("source").alias("__s"), F.col("doc_id").alias("__d")).agg(F.max("version").alias("__v"))
        same = F.col("source").eqNullSafe(F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("version") == F.col("__v"))
        return rows.join(small_side(materialize(last, "last-versions"), BROADCAST_DOCS), same, "left_semi").drop("version")


def without_lines(chunks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``chunks`` with ``content`` less the given lines; a chunk of nothing else has the empty content.

    Null contents stay null.
    """
    gone = occurrences.groupBy("chunk_id").agg(F.collect_set("line_no").alias("__gone"))
    kept = F.filter(F.split("content", "\n"), lambda _, i: ~F.array_contains(F.col("__gone"), i))
    return chunks.join(gone, "chunk_id", "left").withColumn("content", F.when(F.col("__gone").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n"))).drop("__gone")
