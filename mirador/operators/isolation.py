"""Isolation scores: how few random cuts set a row apart.

Trees are grown on the driver from a bounded sample (``trees`` x ``sample`` rows drawn from
at most ``pool`` rows, chosen by hash); each cuts a random feature between its extremes until
a row is alone or the depth of a balanced tree is reached. Every row is scored: the trees,
arrays of cuts, go to all tasks. A missing feature counts as 0, the middle of robust scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usual_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of a row in a random tree of n rows."""
    n = np.asarray(n, float)
    out = np.where(n == 2, 1.0, 0.0)
    many = n > 2
    m = np.where(many, n, 3)
    return np.where(many, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, out)


@dataclass
class Tree:
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray
    below: np.ndarray
    depth: np.ndarray  # of a leaf: its depth and the usual one of what is left in it

    def path(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            at[rows] = self.below[here] + (x[rows, self.feature[here]] > self.cut[here])
        return self.depth[at]


def grow(x: np.ndarray, rng: np.random.Generator) -> Tree:
    most = int(np.ceil(np.log2(max(2, len(x)))))
    feature, cut, below, depth = [-1], [0.0], [0], [0.0]
    queue = [(0, np.arange(len(x)), 0)]
    while queue:
        node, rows, level = queue.pop()
        low, high = x[rows].min(0), x[rows].max(0)
        open_ = np.flatnonzero(high > low)
        if level >= most or len(rows) < 2 or not len(open_):
            depth[node] = level + float(usual_depth(len(rows)))
            continue
        f = int(rng.choice(open_))
        v = float(rng.uniform(low[f], high[f]))
        over = x[rows, f] > v
        feature[node], cut[node], below[node] = f, v, len(feature)
        for part in (rows[~over], rows[over]):
            queue.append((len(feature), part, level + 1))
            feature.append(-1), cut.append(0.0), below.append(0), depth.append(0.0)
    return Tree(*map(np.array, (feature, cut, below, depth)))


@dataclass
class Forest:
    xs: list[str]
    trees: list[Tree]
    sample: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean depth / usual depth): near 1 for rows that few cuts set apart."""
        if not self.trees:
            return np.full(len(x), np.nan)
        mean = np.mean([t.path(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)
        return 2.0 ** (-mean / max(float(usual_depth(self.sample)), 1e-12))

    def score(self, rows: DataFrame, name: str = "isolation") -> DataFrame:
        """``rows`` with the score; null where no tree was grown."""
        schema = rows.withColumn(name, F.lit(None).cast("double")).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.nan_to_num(np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in self.xs]))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(self.scores(x), pa.float64(), from_pandas=True)], [*b.schema.names, name])

        return rows.mapInArrow(run, schema)


def fit(rows: DataFrame, xs: Sequence[str], by: Sequence[str], *, trees: int = 50, sample: int = 256, pool: int = 50_000, seed: int = 0) -> Forest:
    """``by`` names the columns whose hash chooses the pool."""
    drawn = rows.select(*[F.col(c).cast("double").alias(c) for c in xs], F.xxhash64(*by).alias("_h")).orderBy("_h").limit(pool).drop("_h").toArrow()
    x = np.nan_to_num(np.column_stack([drawn[c].to_numpy().astype(float) for c in xs])) if drawn.num_rows else np.zeros((0, len(xs)))
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    return Forest(list(xs), [grow(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(trees)] if size > 1 else [], size)
