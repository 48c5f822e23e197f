"""Session helpers: table access, shared scratch tables, repeats, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Repeated keys that are broadcast to find the rows to drop; beyond it whole rows are shuffled.
REPEATED_KEYS = 500_000
#: Scratch tables of drivers that died are deleted when they are older than this.
LEFT_OVER_DAYS = 7

_local_scratch: str | None = None
_made: list[tuple[SparkSession, str]] = []
_swept: set[str] = set()


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``root``."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session without that setting (tests, a local shell) falls back to a
    temporary folder of this machine, and only when the master is local.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    global _local_scratch
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="pagegrain-")
    return _local_scratch


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared file system, if it is there and the session still lives."""
    with suppress(Py4JError, OSError, AttributeError):
        target, files = _file_system(spark, path)
        files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, files = _file_system(spark, path)
    return files.exists(target)


def _sweep(spark: SparkSession, folder: str) -> None:
    """Deletes, once for each folder, what drivers left that died without doing so."""
    if folder in _swept:
        return
    _swept.add(folder)
    with suppress(Py4JError, OSError):
        target, files = _file_system(spark, folder)
        if files.exists(target):
            before = (time.time() - LEFT_OVER_DAYS * 86_400) * 1000
            for status in files.listStatus(target):
                if status.getPath().getName().startswith("pagegrain-") and status.getModificationTime() < before:
                    files.delete(status.getPath(), True)


def _clean(down_to: int = 0) -> None:
    while len(_made) > down_to:
        delete(*_made.pop())


atexit.register(_clean)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes, at its end, the scratch tables made within it: put a query and the writing of its result inside.

    A frame whose rows come from scratch tables can't be read after that. Without
    it the tables stay until the driver ends.
    """
    before = len(_made)
    try:
        yield
    finally:
        _clean(before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, whose content goes as ``materialize``'s tables do."""
    folder = scratch_dir(spark)
    _sweep(spark, folder)
    path = os.path.join(folder, f"pagegrain-{label}-{uuid.uuid4().hex}")
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it again.

    Cuts the lineage so that lost executors only repeat what follows, keeps a
    Python stage from being run once per consumer, and gives the planner real
    sizes. ``scratch`` removes the table, at the latest the driver's end does.
    ``by``: a column of few values, by which it is parted into folders, so that a
    filter on it reads no others.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def within(df: DataFrame, rows_bound: int) -> bool:
    """Whether ``df`` holds at most ``rows_bound`` rows. On a materialised table that is a footer read."""
    return df.limit(rows_bound + 1).count() <= rows_bound


def small_side(df: DataFrame, rows_bound: int) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``rows_bound`` rows, else as it is."""
    return F.broadcast(df) if within(df, rows_bound) else df


def spread(df: DataFrame, scan: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if the files of ``scan``, which it is read from, give fewer.

    For work that is heavy for its bytes, as pages are: a few small files would leave
    most cores idle. Inputs with a partition for each core are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if scan.rdd.getNumPartitions() >= cores else df.repartition(cores)


def unnest(df: DataFrame, keep: list, array: str | Column, position: str, value: str) -> DataFrame:
    """One row for each element of a computed array, with its position.

    A plain explode makes the planner add a filter on the array's size below it,
    which computes the array a second time; this form keeps it to once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, value))
    return rows.where(F.col(position).isNotNull())


def _same(keys: list[str], other: str) -> Column:
    """Null-safe equality of keys with their namesakes, which begin with ``other``."""
    both = F.lit(True)
    for k in keys:
        both = both & F.col(f"`{k}`").eqNullSafe(F.col(f"`{other}{k}`"))
    return both


def once(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, null-safe, without shuffling rows; which of unequal ones stays isn't defined.

    Only keys are counted, combined before the shuffle, so that a key may be
    repeated in any share of the rows; of a repeated key the first row, by file and
    place in it, is known from that and all others are filtered out at the scan. A
    frame that isn't read from Parquet has no places: there the rows of repeated
    keys alone are shuffled. Beyond ``REPEATED_KEYS`` of them all rows are, each key's
    combined before.
    """
    try:
        placed = df.withColumns({"__file": F.xxhash64("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
        first = F.min(F.struct("__file", "__row")).alias("__first")
    except AnalysisException:
        placed, first = df, F.lit(None).alias("__first")
    counted = placed.groupBy(*(F.col(f"`{k}`").alias(f"__k_{k}") for k in keys)).agg(F.count(F.lit(1)).alias("__n"), first)
    repeated = materialize(counted.where("__n > 1").drop("__n"), "repeated-keys")
    if not within(repeated, REPEATED_KEYS):
        return df.dropDuplicates(keys)
    marks = F.broadcast(repeated)
    if placed is not df:
        marked = placed.join(marks, _same(keys, "__k_"), "left")
        return marked.where(F.col("__first").isNull() | F.struct("__file", "__row").eqNullSafe(F.col("__first"))).select(*(F.col(f"`{c}`") for c in df.columns))
    again = df.join(marks, _same(keys, "__k_"), "left_semi").dropDuplicates(keys)
    return df.join(marks, _same(keys, "__k_"), "left_anti").unionByName(again)
