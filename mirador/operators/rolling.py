"""Windows over a symbol's sessions, each with its own rule for missing values.

A frame is a number of calendar rows: panels are aligned first, so a missing bar is a null
in its place. The guards say when a frame is good enough to give a value.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by():
    return W.partitionBy("symbol").orderBy("ix")


def frame(n: int, end: int = 0):
    """The n rows that end ``end`` rows after this one (negative: before)."""
    return by().rowsBetween(end - n + 1, end)


def full(agg: Column, n: int, end: int = 0) -> Column:
    """Needs n calendar rows; nulls among them are skipped."""
    w = frame(n, end)
    return F.when(F.count(F.lit(1)).over(w) == n, agg.over(w))


def at_least(agg: Column, value: Column, n: int, least: int, end: int = 0) -> Column:
    """Needs ``least`` valid values."""
    w = frame(n, end)
    return F.when(F.count(value).over(w) >= least, agg.over(w))


def half(agg: Column, value: Column, n: int, end: int = 0) -> Column:
    return at_least(agg, value, n, max(1, n // 2), end)


def strict(agg: Column, value: Column, n: int, end: int = 0) -> Column:
    """Any missing value makes the result missing."""
    return at_least(agg, value, n, n, end)


def lag(value: str, n: int) -> Column:
    return F.lag(value, n).over(by())


def ema(df: DataFrame, value: str, span: int, out: str) -> DataFrame:
    """Exponential average; the first value starts it and a missing one leaves it. A closed
    form over blocks of rows: a block's own weighted sum, and the tail of the block before.
    Older blocks weigh less than a double can tell."""
    keep = 1 - 2.0 / (span + 1)
    size = math.ceil(40 / -math.log(keep))
    own = df.filter(F.col(value).isNotNull()).withColumn("_k", F.row_number().over(by()) - 1)
    own = own.withColumns({"_b": F.expr(f"int(_k div {size})"), "_p": F.col("_k") % size})
    weight = F.when(F.col("_k") == 0, 1.0).otherwise(1 - keep) * F.col(value) * F.pow(F.lit(keep), -F.col("_p"))
    own = own.withColumn("_e", F.pow(F.lit(keep), F.col("_p")) * F.sum(weight).over(W.partitionBy("symbol", "_b").orderBy("_p")))
    tails = own.groupBy("symbol", (F.col("_b") + 1).alias("_b")).agg(F.max_by("_e", "_p").alias("_t"))
    e = own.join(tails, ["symbol", "_b"], "left").select("symbol", "ix", (F.col("_e") + F.coalesce(F.pow(F.lit(keep), F.col("_p") + 1) * F.col("_t"), F.lit(0.0))).alias("_e"))
    filled = df.select("symbol", "ix").join(e, ["symbol", "ix"], "left")
    return filled.select("symbol", "ix", F.last("_e", ignorenulls=True).over(by().rowsBetween(W.unboundedPreceding, 0)).alias(out))


def earlier_median(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the median of the earlier values of its key and how many they are
    (``out``_n). An exact median of a growing frame has no built-in form but to sort the
    frame anew for every row; here each task streams its sorted rows past two heaps, so the
    work is n log n and a key's values are all that is held."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, low, high = None, [], []
        for pdf in frames:
            medians, counts = [], []
            for row in zip(*(pdf[k] for k in keys), pdf[value], strict=True):
                if row[:-1] != here:
                    here, low, high = row[:-1], [], []
                counts.append(len(low) + len(high))
                medians.append(None if not low else -low[0] if len(low) > len(high) else (high[0] - low[0]) / 2)
                if not pd.isna(row[-1]):
                    heapq.heappush(high, -heapq.heappushpop(low, -row[-1]))
                    if len(high) > len(low):
                        heapq.heappush(low, -heapq.heappop(high))
            yield pdf.assign(**{out: pd.Series(medians, dtype="float64", index=pdf.index), f"{out}_n": pd.Series(counts, dtype="int64", index=pdf.index)})

    schema = df.schema.simpleString()[len("struct<") : -1] + f",{out}:double,{out}_n:bigint"
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def streak(df: DataFrame, sign: Column, out: str) -> DataFrame:
    """Signed length of the run of equal signs that ends here (gaps and islands)."""
    marked = df.withColumn("_s", sign).withColumn("_new", F.when(F.col("_s").eqNullSafe(F.lag("_s").over(by())), 0).otherwise(1))
    marked = marked.withColumn("_run", F.sum("_new").over(by()))
    run = W.partitionBy("symbol", "_run").orderBy("ix")
    return marked.withColumn(out, (F.col("_s") * F.row_number().over(run)).cast("long")).drop("_s", "_new", "_run")


def drawdown(value: str, n: int) -> Column:
    """Largest fall from a running maximum within the n rows (an array of at most n)."""
    xs = F.collect_list(value).over(frame(n))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("worst"))
    step = lambda a, x: F.struct(
        F.greatest(a["top"], x).alias("top"), F.least(a["worst"], x / F.greatest(a["top"], x) - 1).alias("worst")
    )
    return F.when(F.count(value).over(frame(n)) == n, F.aggregate(xs, start, step)["worst"])
