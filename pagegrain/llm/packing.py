"""Filling containers of fixed capacity with items of varying length.

Vector best-fit: each open bin has a residual of tokens, of documents and of
attention cost (the sum of squared lengths). Items come by falling size; of the
bins with room in every dimension an item goes to the one whose weighted residual
norm after placement is least (or whose weighted dot product with the item is
greatest). Only an item that passes a capacity alone is split.

What decides is how many items of each length there are, and no more lengths
exist than a container has room. So a whole group is packed at once from its
counts of lengths, however many items it holds: equal bins are kept as one with a
number, and items of a length are put into them in runs. Then each item finds its
run by its rank among the items of its length, which is taken in buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrain.runtime import materialize

#: Items of one length and group that are ranked in one task, about.
BUCKET_ITEMS = 200_000


@dataclass(frozen=True)
class Capacity:
    """Room of a container in each dimension, and the weights of the fit.

    ``cost`` bounds the sum of squared lengths; by default it is that of one item
    filling the container, which no other bound would let be passed.
    """

    length: int = 6000
    items: int = 256
    cost: float | None = None
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "residual_norm"

    def vector(self) -> np.ndarray:
        return np.array([self.length, self.items, self.cost or float(self.length) ** 2])

    @property
    def largest(self) -> int:
        """The length of the largest item that has room in an empty container."""
        return min(self.length, int(np.sqrt(self.vector()[2])))


class _Bins:
    """Open bins, equal ones as one with their number; bins of one kind have numbers without gaps."""

    def __init__(self, capacity: Capacity):
        self.room, self.weights, self.rule = capacity.vector(), np.array(capacity.weights), capacity.rule
        self.left, self.count, self.first = np.zeros((256, 3)), np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        self.n = 0

    def add(self, left: np.ndarray, count: int, first: int) -> None:
        if self.n == len(self.left):
            self.left, self.count, self.first = np.vstack([self.left, np.zeros_like(self.left)]), np.append(self.count, np.zeros_like(self.count)), np.append(self.first, np.zeros_like(self.first))
        self.left[self.n], self.count[self.n], self.first[self.n] = left, count, first
        self.n += 1

    def drop(self, k: int) -> None:
        self.n -= 1
        self.left[k], self.count[k], self.first[k] = self.left[self.n], self.count[self.n], self.first[self.n]

    def score(self, left: np.ndarray, item: np.ndarray) -> np.ndarray:
        share, need = left / self.room, item / self.room
        return (share - need) ** 2 @ self.weights if self.rule == "residual_norm" else -(share @ (need * self.weights))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Best fit of ``counts`` items of each of ``lengths``: runs of ``length, start, n_items, per_bin, first_bin``.

    The items of a length with ranks from ``start`` on go, ``per_bin`` each, into
    the bins from ``first_bin`` on. It is what putting item after item would give:
    of equal bins the one begun is filled as long as it is the best.
    """
    bins, runs, n_bins = _Bins(capacity), [], 0
    least = int(lengths.min()) if len(lengths) else 0
    order = np.argsort(-lengths, kind="stable")
    for length, n in zip(lengths[order].tolist(), counts[order].tolist(), strict=True):
        item, start = np.array([length, 1.0, float(length) ** 2]), 0
        if (item > bins.room).any():
            raise ValueError("an item alone passes a capacity")
        while n:
            fits = np.flatnonzero((bins.left[: bins.n] >= item).all(axis=1))
            if len(fits):
                scores = bins.score(bins.left[fits], item)
                at = int(scores.argmin())
                g = int(fits[at])
                left, count, first = bins.left[g].copy(), int(bins.count[g]), int(bins.first[g])
                scores[at] = scores[at] if count > 1 else np.inf
                rival = float(scores.min())
                k = 1  # items that one bin takes before another bin is better
                while k < n and (left - (k + 1) * item >= 0).all() and float(bins.score((left - k * item)[None], item)[0]) <= rival:
                    k += 1
                used = min(count, n // k)
                if used < count:
                    bins.count[g], bins.first[g] = count - used, first + used
                else:
                    bins.drop(g)
            else:
                left, first = bins.room, n_bins
                k = int(min(n, *(bins.room[d] // item[d] for d in range(3) if item[d])))
                used = n // k
                n_bins += used
            left = left - k * item
            if left[0] >= max(1, least) and left[1] >= 1:  # else nothing fits any more
                bins.add(left, used, first)
            runs.append((length, start, used * k, k, first))
            start, n = start + used * k, n - used * k
    return runs


def best_fit(lengths: np.ndarray, capacity: Capacity) -> np.ndarray:
    """The bin of each item, bins numbered from 0; every item must fit an empty bin."""
    sizes, counts = np.unique(lengths, return_counts=True)
    out = np.zeros(len(lengths), dtype=np.int64)
    places = {s: np.flatnonzero(lengths == s) for s in sizes.tolist()}
    for length, start, n, k, first in fit_counts(sizes, counts, capacity):
        out[places[length][start : start + n]] = first + np.arange(n) // k
    return out


def item_parts(items: DataFrame, length_col: str, largest: int) -> DataFrame:
    """``items`` with ``part_no, n_parts, start, end``: one row each, several only beyond the largest length that has room.

    Empty items stay one part of length 0; a null length counts as 0.
    """
    size = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    n = F.greatest(F.lit(1), F.ceil(size / F.lit(largest))).cast("int")
    parts = items.withColumn("n_parts", n).withColumn("part_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return parts.withColumn("start", F.col("part_no").cast("long") * largest).withColumn("end", F.least(F.col("start") + largest, size))


def _group_key(group_col: str) -> Column:
    """A group's name that is never null, and differs from that of the null group."""
    return F.when(F.col(group_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))


def pack(items: DataFrame, group_col: str, key_cols: list[str], length_col: str, capacity: Capacity = Capacity()) -> DataFrame:
    """``group_col, key_cols, part_no, n_parts, start, end, container``: each item's container.

    Containers never mix groups; the null group is a group of its own. A group is
    packed as a whole from its counts of lengths (``fit_counts``), at most
    ``capacity.length`` of them, so its packing doesn't depend on how many items or
    tasks there are. Items of one length and group are ranked in buckets of about
    ``BUCKET_ITEMS``, so that a group and a length may hold any share of all items.
    Only keys and lengths are shuffled. ``items`` is read several times: give a
    stored table. ``container`` names are unique over all groups.
    """
    spark = items.sparkSession
    keep = [group_col, *key_cols, "part_no", "n_parts", "start", "end"]
    parts = item_parts(items.select(group_col, *key_cols, length_col), length_col, capacity.largest).select(*keep)
    parts = parts.withColumns({"__g": _group_key(group_col), "__size": (F.col("end") - F.col("start")).cast("int"), "__hash": F.xxhash64(*key_cols, "part_no")})
    counts = materialize(parts.groupBy("__g", "__size").agg(F.count(F.lit(1)).alias("n")), "length-counts")
    n_buckets = -(-(counts.agg(F.sum("n")).first()[0] or 0) // BUCKET_ITEMS) or 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = pd.DataFrame(fit_counts(pdf["__size"].to_numpy(dtype=np.int64), pdf["n"].to_numpy(dtype=np.int64), capacity), columns=["__size", "from", "n", "per_bin", "first_bin"])
        runs.insert(0, "__g", pdf["__g"].iloc[0])
        return runs

    # as many partitions as named, which isn't taken back for their few bytes: packing a group is all the work there is
    spread = counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "__g")
    runs = spread.groupBy("__g").applyInPandas(run, "`__g` string, `__size` int, `from` bigint, n bigint, per_bin bigint, first_bin bigint")
    runs = materialize(runs.groupBy("__g", "__size").agg(F.array_sort(F.collect_list(F.struct("from", "n", "per_bin", "first_bin"))).alias("runs")), "runs")
    bucket = F.pmod("__hash", F.lit(n_buckets)).cast("int")
    starts = parts.groupBy("__g", "__size", bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("__g", "__size").orderBy("__bucket")) - F.col("n")
    # these sides grow with sources and buckets: merged, never broadcast
    starts = starts.withColumn("before", before).join(runs.hint("merge"), ["__g", "__size"])
    met = F.filter("runs", lambda r: (r["from"] < F.col("before") + F.col("n")) & (r["from"] + r["n"] > F.col("before")))
    starts = starts.select("__g", "__size", "__bucket", "before", met.alias("runs"))
    inside = F.row_number().over(Window.partitionBy("__g", "__size", "__bucket").orderBy("__hash", *key_cols, "part_no"))
    ranked = parts.withColumn("__bucket", bucket).withColumn("__inside", inside).join(starts.hint("merge"), ["__g", "__size", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("before") + F.col("__inside") - 1)
    mine = F.get(F.filter("runs", lambda r: (r["from"] <= F.col("__rank")) & (F.col("__rank") < r["from"] + r["n"])), F.lit(0))
    ranked = ranked.withColumn("__run", mine)
    number = F.col("__run.first_bin") + F.floor((F.col("__rank") - F.col("__run.from")) / F.col("__run.per_bin"))
    return ranked.select(*keep, F.concat_ws("/", "__g", number.cast("string")).alias("container"))


def page_lengths(chunks: DataFrame) -> DataFrame:
    """``source, doc_id, page_number, length`` of each page text.

    A page text is the content of the page's text chunks joined by two line feeds,
    repeats of a chunk once; a chunk with null content isn't part of it. Only ids
    and lengths are shuffled.
    """
    texts = chunks.where("type = 'text' and content is not null").select("chunk_id", "source", "doc_id", "page_number", F.length("content").cast("long").alias("size"))
    once = texts.dropDuplicates(["chunk_id"])
    return once.groupBy("doc_id", "page_number").agg(F.min("source").alias("source"), (F.sum("size") + 2 * (F.count(F.lit(1)) - 1)).alias("length")).select("source", "doc_id", "page_number", "length")
