"""Walk-forward fits of any estimator: block by block, each from the rows whose target was
known before the block, none of whose copies is kept for another block.

An estimator either has ``fit_blocks(rows, blocks, at)``: coefficients of every block from
one aggregation by session and running sums, or ``fit(train)`` with ``predict(model, rows)``
for fits that read their rows. For the latter the rows are written once in the order of
sessions; a block's training set is a prefix of that table, so a scan with a filter that
Parquet's statistics prune, and blocks are fitted a few at a time.

Rows: ``at`` numbers the sessions from 0; a target of a row of session t is known at
t + embargo. Blocks with under ``min_train`` training rows give no forecast.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import staged
from . import histboost
from . import models as M


class Estimator(Protocol):
    def fit(self, train: DataFrame) -> Any: ...

    def predict(self, model: Any, rows: DataFrame) -> DataFrame: ...


def upto(sums: DataFrame, blocks: DataFrame, by: Sequence[str], at: str) -> DataFrame:
    """Running sums of a table of sums by session, as they stand at each block's ``train_to``:
    (block, lo, hi, *by, sums). A row a block and key."""
    values = [c for c in sums.columns if c not in (*by, at)]
    # a session belongs to the first block that may learn from it
    first = blocks.select(F.col("block").alias("_first"), F.col("train_to").alias("_to"), F.coalesce(F.lag("train_to").over(W.orderBy("block")), F.lit(-1)).alias("_from"))
    part = sums.join(F.broadcast(first), (F.col(at) <= F.col("_to")) & (F.col(at) > F.col("_from"))).groupBy("_first", *by).agg(*[F.sum(c).alias(c) for c in values])
    grid = blocks.select("block", "lo", "hi")
    if by:  # every key in every block
        last = blocks.agg(F.max("block")).first()[0]
        every = F.explode(F.array(*map(F.lit, range((last if last is not None else -1) + 1))).cast("array<int>"))
        grid = part.select(*by).distinct().withColumn("block", every).join(F.broadcast(grid), "block")
    met = grid.join(part.withColumnRenamed("_first", "block"), ["block", *by], "left")
    run = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, 0) if by else W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    return met.select("block", "lo", "hi", *by, *[F.sum(c).over(run).alias(c) for c in values])


class Ridge:
    """Least squares on any regressors with a penalty on their slopes."""

    def __init__(self, xs: Sequence[str], y: str, penalty: float = 0.0):
        self.xs, self.y, self.penalty = list(xs), y, penalty

    def fit_blocks(self, rows: DataFrame, blocks: DataFrame, at: str) -> DataFrame:
        own = rows.dropna(subset=[*self.xs, self.y])
        m = upto(M.moments(own, self.xs, self.y, at), blocks, [], at)
        n = F.col("one__one")
        name = lambda a, b: f"{a}__{b}" if self.xs.index(a) <= self.xs.index(b) else f"{b}__{a}"
        spread = lambda a, b: F.col(name(a, b)) - F.col(f"one__{a}") * F.col(f"one__{b}") / n
        a = [[spread(p, q) + (self.penalty if p == q else 0.0) for q in self.xs] for p in self.xs]
        b = [F.col(f"{p}__y") - F.col(f"one__{p}") * F.col("one__y") / n for p in self.xs]
        slopes = [f"b_{x}" for x in self.xs]
        s = M.solve(m, a, b, slopes)
        level = (F.col("one__y") - sum((F.col(c) * F.col(f"one__{x}") for c, x in zip(slopes, self.xs, strict=True)), F.lit(0.0))) / n
        return s.select("block", "lo", "hi", n.cast("long").alias("trained"), level.alias("b_one"), *slopes)

    def forecast(self) -> Column:
        return sum((F.col(f"b_{x}") * F.col(x) for x in self.xs), F.col("b_one"))

    keys: tuple[str, ...] = ()


class Rates:
    """The past mean of the target by group; of all groups where one has under ``least`` rows."""

    def __init__(self, by: Sequence[str], y: str, least: int = 20):
        self.keys, self.y, self.least = tuple(by), y, least

    def fit_blocks(self, rows: DataFrame, blocks: DataFrame, at: str) -> DataFrame:
        own = rows.dropna(subset=[self.y])
        sums = own.groupBy(*self.keys, at).agg(F.sum(F.col(self.y).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("k"))
        groups = upto(sums, blocks, list(self.keys), at)
        every = W.partitionBy("block")
        total = lambda c: F.sum(c).over(every)
        rate = F.when(F.col("k") >= self.least, F.col("s") / F.col("k")).otherwise(F.try_divide(total("s"), total("k")))
        return groups.select("block", "lo", "hi", *self.keys, total("k").cast("long").alias("trained"), rate.alias("rate"), F.try_divide(total("s"), total("k")).alias("overall"))

    def forecast(self) -> Column:
        return F.col("rate")


class Boosted:
    """Boosted trees with any of their losses."""

    def __init__(self, xs: Sequence[str], y: str, **options):
        self.xs, self.y, self.options = list(xs), y, options

    def fit(self, train: DataFrame) -> histboost.Model:
        return histboost.fit(train, self.xs, self.y, **self.options)

    def predict(self, model: histboost.Model, rows: DataFrame) -> DataFrame:
        return model.predict(rows)


class Blend:
    """Weights of some forecasts, none negative and one in sum, that are best in squares: from
    the running cross moments, a small system a block."""

    keys: tuple[str, ...] = ()

    def __init__(self, forecasts: Sequence[str], y: str):
        self.xs, self.y = list(forecasts), y

    def fit_blocks(self, rows: DataFrame, blocks: DataFrame, at: str) -> DataFrame:
        own = rows.dropna(subset=[*self.xs, self.y])
        m = upto(M.moments(own, self.xs, self.y, at), blocks, [], at)
        k, xs = len(self.xs), self.xs

        def weights(batches):
            for t in batches:
                out = []
                for r in t.to_pylist():
                    if r["one__one"]:
                        a = np.array([[r[f"{xs[min(i, j)]}__{xs[max(i, j)]}"] for j in range(k)] for i in range(k)])
                        out.append({c: r[c] for c in ("block", "lo", "hi")} | {"trained": int(r["one__one"])} | {f"b_{x}": float(v) for x, v in zip(xs, simplex(a, np.array([r[f"{x}__y"] for x in xs])), strict=True)})
                yield pa.RecordBatch.from_pylist(out, schema)

        ddl = f"block int, lo long, hi long, trained long, {', '.join(f'b_{x} double' for x in xs)}"
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(ddl))
        return m.withColumns({"lo": F.col("lo").cast("long"), "hi": F.col("hi").cast("long")}).mapInArrow(weights, ddl)

    def forecast(self) -> Column:
        return sum((F.col(f"b_{x}") * F.col(x) for x in self.xs), F.lit(0.0))


def simplex(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """w that makes w'aw - 2 b'w least with w >= 0 and sum 1: an active-set walk. A weight that
    would pass zero leaves; one whose slope calls for it comes back."""
    k = len(b)
    a = a + np.eye(k) * 1e-12 * max(1.0, np.trace(a) / k)
    active = [int(np.argmin(np.diag(a) - 2 * b))]
    w = np.zeros(k)
    w[active] = 1.0
    for _ in range(50 * k):
        n = len(active)
        system = np.zeros((n + 1, n + 1))
        system[:n, :n], system[:n, n], system[n, :n] = 2 * a[np.ix_(active, active)], 1, 1
        to = np.linalg.solve(system, np.append(2 * b[active], 1.0))
        step = np.zeros(k)
        step[active] = to[:n]
        if (to[:n] < -1e-12).any():
            move = step - w
            down = [i for i in active if move[i] < 0]
            part = min(1.0, *(w[i] / -move[i] for i in down))
            w = w + part * move
            gone = min(down, key=lambda i: w[i])
            w[gone] = 0.0
            active.remove(gone)
            continue
        w = np.maximum(step, 0)
        slope = 2 * (b - a @ w) - to[n]
        slope[active] = -np.inf
        if slope.max() <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        active = sorted([*active, int(slope.argmax())])
    return w / w.sum()


def walk_forward(rows: DataFrame, estimator, *, first: int, step: int, embargo: int, min_train: int = 1, at: str = "ix", threads: int = 4) -> DataFrame:
    """``rows`` of the blocks with block, trained (training rows) and pred."""
    blocks = M.blocks(rows.select(F.col(at).alias("ix")), first, step, embargo)
    if hasattr(estimator, "fit_blocks"):
        found = F.broadcast(estimator.fit_blocks(rows, blocks, at).filter(F.col("trained") >= min_train))  # a row a block and key
        inside = (F.col(f"r.{at}") >= F.col("m.lo")) & (F.col(f"r.{at}") < F.col("m.hi"))
        for c in estimator.keys:
            inside &= F.col(f"r.{c}").eqNullSafe(F.col(f"m.{c}"))
        drop = [F.col(f"m.{c}") for c in ("lo", "hi", *estimator.keys)]
        met = rows.alias("r").join(found.alias("m"), inside).drop(*drop)
        return met.withColumn("pred", estimator.forecast()).select(*[F.col(c) for c in rows.columns], "block", "trained", "pred")
    table = staged(rows.repartitionByRange(at).sortWithinPartitions(at), "walk")
    sizes = {r.ix: r.n for r in table.groupBy(F.col(at).alias("ix")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a session
    spans = blocks.orderBy("block").collect()  # a row a block

    def one(b):
        trained = sum(n for ix, n in sizes.items() if ix is not None and ix <= b.train_to)
        if trained < min_train:
            return None
        model = estimator.fit(table.filter(F.col(at) <= b.train_to))
        ahead = table.filter((F.col(at) >= b.lo) & (F.col(at) < b.hi))
        return estimator.predict(model, ahead).withColumns({"block": F.lit(b.block), "trained": F.lit(trained).cast("long")})

    with ThreadPoolExecutor(threads) as pool:
        parts = [p for p in pool.map(inheritable_thread_target(rows.sparkSession)(one), spans) if p is not None]
    if not parts:
        return rows.limit(0).select("*", F.lit(None).cast("int").alias("block"), F.lit(None).cast("long").alias("trained"), F.lit(None).cast("double").alias("pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*rows.columns, "block", "trained", "pred")
