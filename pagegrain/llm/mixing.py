"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time 0..1, given as knots or a
straight line by default, whose integral is its target share. Its documents stand in a random fixed order; the running sum of
their tokens, over as many rounds as are needed and allowed, is the demand at
which each is used, and inverting the integrated schedule turns that demand into
a training position. The mix is sorted by position, in ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrain.runtime import materialize

#: How far the weights of the scarcest and the richest source swing about their shares.
SWING = 0.5
#: Documents of one running sum; sums of buckets carry on from one to the next.
BUCKET_DOCS = 10_000


def source_plan(sizes: DataFrame, targets: DataFrame, budget: str = "total", schedules: DataFrame | None = None) -> DataFrame:
    """``source, target_share, max_repeats, tokens, n_docs, budget, exhausted_at, can_reach, planned, slope, segments``, one row for each target.

    ``sizes`` has ``source`` and ``n_tokens`` of each document; sources not in
    ``targets``, and null ones, don't count. ``budget`` is the tokens of all
    documents of the listed sources ("total"), or the most at which every source
    reaches its share ("feasible"; 0 if one with a share has no tokens). ``exhausted_at``: the
    training time, by the source's integrated schedule over the total, at which it has given
    its tokens max_repeats times. ``can_reach``: that is not before the end. ``planned``: the tokens a source is to give, its
    share of the budget or all it may. A target without documents has 0 tokens.
    ``slope``: the weight at time t is share * (1 + slope * (2t - 1)), scarcer
    sources rising; weighted by share the slopes add up to 0. ``schedules`` replaces
    that (``with_segments``). Repeated targets count once.
    """
    totals = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs"))
    wanted = targets.where("source is not null").dropDuplicates(["source"]).select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    plan = wanted.join(totals, "source", "left").fillna(0, ["tokens", "n_docs"])
    everything = Window.partitionBy(F.lit(0))  # one row a target: a small fixed table
    plan = plan.withColumn("total", F.sum("tokens").over(everything))
    limit = F.when(F.col("target_share") > 0, F.col("tokens") * F.col("max_repeats") / F.col("target_share"))
    plan = plan.withColumn("feasible", F.least(F.col("total").cast("double"), F.min(limit).over(everything)))
    plan = plan.withColumn("budget", F.col("feasible") if budget == "feasible" else F.col("total").cast("double"))
    plan = plan.withColumn("planned", F.least(F.col("target_share") * F.col("budget"), (F.col("tokens") * F.col("max_repeats")).cast("double")))
    scarce = F.when(F.col("tokens") > 0, F.col("target_share") * F.col("total") / F.col("tokens")).otherwise(F.lit(0.0))
    plan = plan.withColumn("scarce", scarce / (1 + scarce))
    mean = F.sum(F.col("scarce") * F.col("target_share")).over(everything) / F.sum("target_share").over(everything)
    plan = with_segments(plan.withColumn("slope", F.coalesce((F.col("scarce") - mean) * 2 * SWING, F.lit(0.0))), schedules)
    supply, wanted = (F.col("tokens") * F.col("max_repeats")).cast("double"), F.col("target_share") * F.col("total")
    plan = plan.withColumn("exhausted_at", position(supply, wanted, F.col("segments")))
    # the check behind it is exact where the inverse is rounded to the end
    return plan.withColumn("can_reach", (F.col("exhausted_at") >= 1) & (supply >= wanted)).drop("total", "feasible", "scarce")


def _default_knots(slope: Column) -> Column:
    """A straight line over all training whose integral is 1."""
    return F.array(F.struct(F.lit(0.0).alias("t"), (1 - slope).alias("w")), F.struct(F.lit(1.0).alias("t"), (1 + slope).alias("w")))


def with_segments(plan: DataFrame, schedules: DataFrame | None) -> DataFrame:
    """Adds ``segments`` to a plan: each source's weights over training time, integrated.

    ``schedules`` has ``source, time, weight``: knots of weights that go straight from
    one to the next and stay as they are before the first and behind the last. Times are in
    0 to 1 (others are moved there), weights at least 0, nulls don't count; only a source's
    weights to one another matter. A source without knots, or whose weights are all 0, rises
    or falls by its ``slope``.
    """
    if schedules is None:
        rows = plan.withColumn("__knots", F.lit(None).cast("array<struct<t:double,w:double>>"))
    else:
        given = schedules.where("source is not null and time is not null and weight is not null")
        knots = F.struct(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("time").cast("double"))).alias("t"), F.greatest(F.lit(0.0), F.col("weight").cast("double")).alias("w"))
        given = given.groupBy("source").agg(F.array_sort(F.collect_list(knots)).alias("__knots"))
        rows = plan.join(F.broadcast(given.where(F.exists("__knots", lambda k: k["w"] > 0))), "source", "left")
    edge = lambda t, k: F.array(F.struct(F.lit(t).alias("t"), k["w"].alias("w")))
    whole = F.concat(edge(0.0, F.get(F.col("__knots"), F.lit(0))), F.col("__knots"), edge(1.0, F.element_at("__knots", -1)))
    rows = rows.withColumn("__knots", F.coalesce(whole, _default_knots(F.col("slope"))))
    n = F.size("__knots") - 1
    parts = F.zip_with(F.slice("__knots", F.lit(1), n), F.slice("__knots", F.lit(2), n), lambda a, b: F.struct(a["t"].alias("t"), (b["t"] - a["t"]).alias("dt"), a["w"].alias("w0"), b["w"].alias("w1"), ((b["t"] - a["t"]) * (a["w"] + b["w"]) / 2).alias("area")))
    area = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["area"])
    rows = rows.withColumn("__parts", F.filter(parts, lambda p: p["dt"] > 0)).withColumn("__area", area(F.col("__parts")))
    flat = F.when(F.col("__area") > 0, F.col("__area")).otherwise(F.lit(1.0))
    scaled = F.transform("__parts", lambda p, i: F.struct(p["t"].alias("t"), p["dt"].alias("dt"), (p["w0"] / flat).alias("w0"), (p["w1"] / flat).alias("w1"), (area(F.slice("__parts", F.lit(1), i)) / flat).alias("c")))
    return rows.withColumn("segments", scaled).drop("__knots", "__parts", "__area")


def position(demand: Column, planned: Column, segments: Column) -> Column:
    """The time at which the integrated schedule has given ``demand`` of ``planned`` tokens: its inverse; 1 from ``planned`` on."""
    share = F.when(planned > 0, demand / planned).otherwise(F.lit(1.0))
    s = F.element_at(F.filter(segments, lambda x: (x["c"] <= share) & (x["w0"] + x["w1"] > 0)), -1)
    rest = F.greatest(share - s["c"], F.lit(0.0))
    root = F.sqrt(F.greatest(s["w0"] * s["w0"] + 2 * (s["w1"] - s["w0"]) / s["dt"] * rest, F.lit(0.0)))
    x = F.when(s["w0"] + root > 0, 2 * rest / (s["w0"] + root)).otherwise(F.lit(0.0))
    return F.when(share >= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), s["t"] + F.least(s["dt"], x)))


def running_demand(sizes: DataFrame, id_col: str = "doc_id", seed: int = 17) -> DataFrame:
    """``source, id_col, n_tokens, before``: tokens of the source's documents that come before, in a random fixed order.

    The order is by a hash of the id. Running sums are taken in buckets of about
    BUCKET_DOCS documents; the buckets' sums give each bucket's start, so a source
    of any size is spread over tasks.
    """
    keyed = sizes.select("source", id_col, "n_tokens", F.xxhash64(F.lit(seed), id_col).alias("key"))
    n_buckets = keyed.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET_DOCS)).alias("n_buckets"))
    keyed = keyed.join(F.broadcast(n_buckets), "source")  # one row a listed source, as many as there are targets
    bucket = F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * F.col("n_buckets"))
    keyed = keyed.withColumn("bucket", bucket).drop("n_buckets")
    sums = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    starts = sums.withColumn("start", F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket")) - F.col("tokens")).drop("tokens")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("key", id_col).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return keyed.withColumn("inside", inside).join(starts, ["source", "bucket"]).select("source", id_col, "n_tokens", (F.col("start") + F.col("inside")).alias("before"))


def mix(sizes: DataFrame, targets: DataFrame, id_col: str = "doc_id", budget: str = "feasible", seed: int = 17, schedules: DataFrame | None = None) -> DataFrame:
    """``source, id_col, round, n_tokens, position``, sorted by position: the uses of documents in the mix.

    A document is used in round r if the middle of its demand lies within what its
    source is to give, so each source ends within one document of its plan; rounds
    are at most max_repeats. Documents of unlisted or null sources are in no mix;
    those of 0 tokens are used once at most, as their demand falls. ``sizes`` is
    read several times: give a stored table.
    """
    plan = materialize(source_plan(sizes, targets, budget, schedules), "mix-plan")
    wanted = plan.select("source", "planned", "segments", "tokens", "max_repeats").where("tokens > 0")
    rows = running_demand(sizes.join(F.broadcast(plan.select("source")), "source", "left_semi"), id_col, seed).join(F.broadcast(wanted), "source")
    rounds = F.least(F.col("max_repeats"), F.ceil(F.col("planned") / F.col("tokens")))
    rows = rows.where("planned > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), rounds).cast("int") - 1)))
    rows = rows.withColumn("demand", F.col("before") + F.col("round") * F.col("tokens") + F.col("n_tokens") / 2)
    used = rows.where("demand <= planned").withColumn("position", position(F.col("demand"), F.col("planned"), F.col("segments")))
    return used.select("source", id_col, "round", "n_tokens", "position").orderBy("position", "source", id_col, "round")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, target_share, reached_share, mixed_tokens, n_uses, can_reach``: what the mix holds of each target."""
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("n_uses"))
    both = plan.select("source", "target_share", "can_reach").join(got, "source", "left").fillna(0, ["mixed_tokens", "n_uses"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))
    return both.withColumn("reached_share", F.when(total > 0, F.col("mixed_tokens") / total).otherwise(F.lit(0.0)))
