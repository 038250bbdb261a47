"""Quantiles of everything known before each block, without a copy of the rows a block.

``exact``: values are counted by bucket and by the first block that may use them. Buckets
are cut where the logarithm of the size passes multiples of 1 / FINE, so their order is that
of the values and any counts add up. Running sums over blocks and buckets say in which
bucket a rank lies; only the values of those buckets are counted one by one, and the
interpolated quantile is that of the sorted rows. Neither table of counts grows with the
number of rows: one has blocks x buckets rows, the other the distinct values of a bucket.

``sketched``: one mergeable sketch (KLL) a session, merged over the sessions before a block.
Its rank error is at most ``rank_error(k)`` with a chance of 99 in 100, its size does not
grow, and a session's sketch can be kept and merged later. Sketches draw at random, so two
runs may differ within the error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FINE = 64


def bucket(value: Column) -> Column:
    """Whole numbers in the order of the values: 0 for zero, the sign's side for others."""
    size = F.floor(F.ln(F.abs(value)) * FINE) + 60_000  # the smallest double is exp(-745)
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, size).otherwise(-size)


def _chunked(rows: DataFrame, value: str, at: str, blocks: DataFrame) -> DataFrame:
    """(block, v): the first block that may use the row."""
    spans = blocks.select("block", F.col("train_to").alias("_to"), F.coalesce(F.lag("train_to").over(W.orderBy("block")), F.lit(-1)).alias("_from"))
    own = rows.select(F.col(at).alias("_at"), F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    return own.join(F.broadcast(spans), (F.col("_at") <= F.col("_to")) & (F.col("_at") > F.col("_from"))).select("block", "v")


def exact(rows: DataFrame, value: str, at: str, blocks: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(block, n, q0, q1, ...): the interpolated quantiles ``probs`` of the rows with
    ``at`` <= the block's train_to; blocks without rows give none."""
    own = _chunked(rows, value, at, blocks)
    counts = own.groupBy("block", bucket(F.col("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    numbers = F.broadcast(blocks.select(F.col("block").alias("b")))
    known = counts.join(numbers, F.col("block") <= F.col("b")).groupBy("b", "bucket").agg(F.sum("n").alias("n"))  # counts, not rows
    order = W.partitionBy("b").orderBy("bucket")
    known = known.withColumns({"upto": F.sum("n").over(order), "total": F.sum("n").over(W.partitionBy("b"))})
    ask = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p")) for k, p in enumerate(probs)])).alias("ask")
    asked = known.select("*", ask).withColumn("at", F.col("ask.p") * (F.col("total") - 1))
    ranks = asked.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))  # from 0
    held = ranks.filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    held = held.select("b", "bucket", "ask.k", "at", "rank", "total", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("within"))
    need = F.broadcast(held.select("bucket").distinct())  # at most two a block and quantile
    values = own.withColumn("bucket", bucket(F.col("v"))).join(need, "bucket").groupBy("block", "bucket", "v").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.broadcast(held.select("b", "bucket").distinct())
    each = values.join(pairs, ["bucket"]).filter("block <= b").groupBy("b", "bucket", "v").agg(F.sum("n").alias("n"))
    each = each.withColumn("upto", F.sum("n").over(W.partitionBy("b", "bucket").orderBy("v")))
    found = held.join(each, ["b", "bucket"]).filter((F.col("within") < F.col("upto")) & (F.col("within") >= F.col("upto") - F.col("n")))
    low, high = F.min_by("v", "rank"), F.max_by("v", "rank")
    q = found.groupBy("b", "k").agg((low + (high - low) * (F.first("at") - F.floor(F.first("at")))).alias("q"), F.first("total").alias("n"))
    return q.groupBy(F.col("b").alias("block")).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(probs))])


def rank_error(k: int) -> float:
    """Of one quantile of a sketch of size ``k``, as a share of the rows (the published fit)."""
    return 2.296 / k**0.9021


def sketched(rows: DataFrame, value: str, at: str, blocks: DataFrame, probs: Sequence[float], *, k: int = 800) -> DataFrame:
    """As ``exact`` within ``rank_error(k)``."""
    own = _chunked(rows, value, at, blocks)
    part = own.groupBy("block").agg(F.expr(f"kll_sketch_agg_double(v, {k})").alias("s"), F.count(F.lit(1)).alias("n"))
    numbers = F.broadcast(blocks.select(F.col("block").alias("b")))
    merged = part.join(numbers, F.col("block") <= F.col("b")).groupBy(F.col("b").alias("block")).agg(F.expr(f"kll_merge_agg_double(s, {k})").alias("s"), F.sum("n").alias("n"))  # sketches, not rows
    return merged.select("block", "n", *[F.expr(f"kll_sketch_get_quantile_double(s, {float(p)}D)").alias(f"q{j}") for j, p in enumerate(probs)])
