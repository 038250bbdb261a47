"""Joins in time. Every one has an equi-key, so none becomes a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str | list[str], time: str, values: list[str], *, strict: bool = True, tolerance: str | None = None) -> DataFrame:
    """For each row of ``left`` the latest row of ``right`` of its key that was known: before
    it (``strict``) or at its time. One union, one shuffle, one forward fill; rows of the
    right side never meet pairwise, so a hot key costs no more than its rows."""
    keys = [key] if isinstance(key, str) else key
    seen = F.struct(F.col(time).alias("t"), *values)
    rows = right.select(*keys, time, F.lit(0 if not strict else 1).alias("_side"), seen.alias("_seen"))
    asks = left.withColumn("_side", F.lit(1 if not strict else 0)).withColumn("_row", F.struct(*[F.col(c) for c in left.columns]))
    both = asks.select(*keys, time, "_side", "_row").unionByName(rows.select(*keys, time, "_side", "_seen"), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    got = both.withColumn("_seen", F.last("_seen", ignorenulls=True).over(w)).filter("_row is not null")
    fresh = F.lit(True) if tolerance is None else F.col("_seen.t") >= F.col(f"_row.{time}") - F.expr(f"INTERVAL {tolerance}")
    return got.select("_row.*", *[F.when(fresh, F.col(f"_seen.{v}")).alias(f"asof_{v}") for v in values], F.when(fresh, F.col("_seen.t")).alias("asof_time"))


def interval_counts(left: DataFrame, right: DataFrame, key: str, time: str, windows: dict[str, int]) -> DataFrame:
    """For each row of ``left`` how many rows of ``right`` of its key lie in the half-open
    (time - days, time]-less windows [time - days, time). Counted by a running sum over one
    union instead of a range join, so the work is linear in the rows of a key."""
    secs = F.unix_micros(F.col(time).cast("timestamp"))
    asks = left.select("*", secs.alias("_t")).withColumn("_n", F.lit(0))
    rows = right.select(key, secs.alias("_t"), F.lit(1).alias("_n"))
    both = asks.unionByName(rows, allowMissingColumns=True).withColumn("_ask", F.col("_n") == 0)
    out = both
    for name, days in windows.items():
        w = W.partitionBy(key).orderBy("_t").rangeBetween(-days * 86_400_000_000, -1)
        out = out.withColumn(name, F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long"))
    return out.filter("_ask").select(*left.columns, *windows)


def bitemporal(facts: DataFrame, at: DataFrame, key: str, series: list[str], time: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Of every series of a key the version that is valid at each row of ``at``, on the
    closed interval [start, end]. Versions of a series don't overlap, so the latest that
    began is the only candidate: an as-of fill per series, and no version meets every time."""
    asks = at.join(facts.select(key, *series).distinct(), key)
    got = asof(asks, facts.withColumnRenamed(start, time), [key, *series], time, [*values, end], strict=False)
    live = got.filter(F.col("asof_time").isNotNull() & (F.col(time) <= F.coalesce(f"asof_{end}", time)))
    return live.select(key, *series, time, *[F.col(f"asof_{v}").alias(v) for v in values])


def latest_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last by ``order``."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
