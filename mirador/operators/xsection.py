"""Operators across the symbols of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def xs():
    return W.partitionBy("session")


def rank_pct(value: str, key: str = "symbol", least: int = 10) -> Column:
    """Ordinal rank / (n - 1) - 0.5 among the valid values, ties by key; null in groups of ``least`` or fewer."""
    n = F.count(value).over(xs())
    order = xs().orderBy(F.col(value).asc_nulls_last(), F.col(key))
    return F.when(F.col(value).isNotNull() & (n > least), (F.row_number().over(order) - 1) / (n - 1) - 0.5)


def rank_average(value: str, by: list[str]) -> Column:
    """Average rank from 1, ties shared."""
    w = W.partitionBy(*by).orderBy(value)
    return F.when(F.col(value).isNotNull(), F.rank().over(w) + (F.count(value).over(W.partitionBy(*by, value)) - 1) / 2)


def leave_one_out(value: str, *by: str) -> Column:
    """Mean of the others of the group; null where there is none."""
    w = W.partitionBy(*by)
    n = F.count(value).over(w) - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    return F.when(n > 0, (F.sum(value).over(w) - F.coalesce(F.col(value), F.lit(0.0))) / n)


def demean(value: str, *by: str) -> Column:
    return F.col(value) - F.avg(value).over(W.partitionBy(*by))


def spread(df: DataFrame, by: str, score: str, outcome: str, share: float, least: int) -> DataFrame:
    """Per group the mean outcome at or above the upper quantile of the score less that at
    or below the lower; quantiles interpolate, and a tie may be in both."""
    cuts = df.groupBy(by).agg(F.percentile(score, 1 - share).alias("hi"), F.percentile(score, share).alias("lo"), F.count(score).alias("n"))
    cut = df.join(cuts.filter(F.col("n") >= least), by)
    top, low = F.avg(F.when(F.col(score) >= F.col("hi"), F.col(outcome))), F.avg(F.when(F.col(score) <= F.col("lo"), F.col(outcome)))
    return cut.groupBy(by).agg(top.alias("top"), low.alias("low"), (top - low).alias("spread"), F.first("n").alias("n"))


def top_k(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)
