"""Walk-forward estimation as relations: blocks with an embargo, and least squares from
normal equations that Spark sums up."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(calendar: DataFrame, first: int, step: int, embargo: int) -> DataFrame:
    """(block, lo, hi, train_to): block b predicts sessions [lo, hi) from rows whose target
    is known by lo - 1, that is rows up to lo - 1 - embargo."""
    ix = calendar.agg(F.max("ix").alias("last")).filter(F.col("last") >= first)
    b = ix.select("last", F.explode(F.sequence(F.lit(first), F.col("last"), F.lit(step))).alias("lo"))
    return b.select(((F.col("lo") - first) / step).cast("int").alias("block"), "lo", F.least(F.col("lo") + step, F.col("last") + 1).alias("hi"), (F.col("lo") - 1 - embargo).alias("train_to"))


def moments(rows: DataFrame, xs: list[str], y: str, by: str) -> DataFrame:
    """Per group the sums of products of (1, xs, y): one map-side combined aggregation."""
    cols = {"one": F.lit(1.0)} | {x: F.col(x) for x in xs}
    names = list(cols)
    pairs = [F.sum(cols[a] * cols[b]).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(by).agg(*pairs, *[F.sum(cols[a] * F.col(y)).alias(f"{a}__y") for a in names])


def solve2(m: DataFrame, x1: str, x2: str, ridge: float = 0.0) -> DataFrame:
    """Coefficients (b0, b1, b2) of two regressors by Cramer's rule on centred moments."""
    n = F.col("one__one")
    cov = lambda a, b: F.col(f"{a}__{b}") - F.col(f"one__{a}") * F.col(f"one__{b}") / n
    s11, s22, s12 = cov(x1, x1) + ridge, cov(x2, x2) + ridge, cov(x1, x2)
    c1, c2 = F.col(f"{x1}__y") - F.col(f"one__{x1}") * F.col("one__y") / n, F.col(f"{x2}__y") - F.col(f"one__{x2}") * F.col("one__y") / n
    det = s11 * s22 - s12 * s12
    b1, b2 = F.when(det != 0, (c1 * s22 - c2 * s12) / det), F.when(det != 0, (c2 * s11 - c1 * s12) / det)
    out = m.withColumns({"b1": b1, "b2": b2})
    return out.withColumn("b0", (F.col("one__y") - F.col("b1") * F.col(f"one__{x1}") - F.col("b2") * F.col(f"one__{x2}")) / n)


def solve(df: DataFrame, a: list[list[Column]], b: list[Column], names: list[str]) -> DataFrame:
    """``df`` with the solution of a symmetric positive definite system a x = b per row as
    columns ``names``: elimination without pivots, a column a coefficient."""
    k = len(b)
    rows = [[*a[i], b[i]] for i in range(k)]
    df = df.withColumns({f"_s{i}_{j}": rows[i][j] for i in range(k) for j in range(k + 1)})
    at = lambda i, j: F.col(f"_s{i}_{j}")
    for p in range(k):
        df = df.withColumns({f"_s{i}_{j}": at(i, j) - F.try_divide(at(i, p), at(p, p)) * at(p, j) for i in range(p + 1, k) for j in range(p, k + 1)})
    for i in range(k - 1, -1, -1):
        rest = sum((at(i, j) * F.col(names[j]) for j in range(i + 1, k)), F.lit(0.0))
        df = df.withColumn(names[i], F.try_divide(at(i, k) - rest, at(i, i)))
    return df.drop(*[f"_s{i}_{j}" for i in range(k) for j in range(k + 1)])


def clustered(rows: DataFrame, xs: list[str], y: str, cluster: str) -> DataFrame:
    """(x, b, se, t, n, clusters): least squares on any regressors, with a covariance clustered
    by ``cluster``. Two aggregations: the cross moments, then the scores summed within clusters;
    what reaches the driver is a square of the regressors. Where the regressors are linearly
    dependent, or there are no rows, there is no fit and no row."""
    own = rows.dropna(subset=[*xs, y])
    spark, k, n = rows.sparkSession, len(xs), F.count(F.lit(1))
    m = own.agg(n.alias("n"), F.avg(y).alias("my"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)], *[(F.covar_pop(xs[i], xs[j]) * n).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[(F.covar_pop(x, y) * n).alias(f"y{i}") for i, x in enumerate(xs)]).first()
    out = "x string, b double, se double, t double, n long, clusters long"
    a = np.array([[m[f"a{min(i, j)}_{max(i, j)}"] if m.n else 0.0 for j in range(k)] for i in range(k)], float)
    if not m.n or np.linalg.matrix_rank(a) < k:
        return spark.createDataFrame([], out)
    inverse = np.linalg.inv(a)
    b = inverse @ np.array([m[f"y{i}"] for i in range(k)])
    dev = [F.col(x) - m[f"m{i}"] for i, x in enumerate(xs)]
    rest = F.col(y) - m.my - sum((float(b[i]) * dev[i] for i in range(k)), F.lit(0.0))
    scores = own.groupBy(cluster).agg(*[F.sum(dev[i] * rest).alias(f"s{i}") for i in range(k)])
    s = scores.agg(F.count(F.lit(1)).alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.array([[s[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
    return spark.createDataFrame([(x, float(b[i]), float(se[i]), float(b[i] / se[i]) if se[i] else None, m.n, s.g) for i, x in enumerate(xs)], out)
