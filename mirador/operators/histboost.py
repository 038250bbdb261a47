"""Boosted trees whose every step is a Spark aggregation, for any loss with a gradient.

Features are cut to bins by their quantiles once. A level of a tree is one aggregation of
gradient sums by node, feature and bin, summed in the map; what reaches the driver has at
most 2 ** depth nodes x features x bins rows, whatever the table's size. The values of the
leaves are one more aggregation: the mean, a quantile, or a clipped mean of what is left.

Losses: "l2"; "l1" (median leaves); "quantile" at ``alpha``; "huber" clipped at ``alpha``.
Quantiles are Spark's approximate ones, within 1 / ACCURACY of the rank (exact on tables of
fewer rows). Rows without a target aren't trained on; a missing feature is a bin of its own
below all others. A table without rows gives a model that predicts null.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged

ACCURACY = 10_000


def gradient(rest: Column, loss: str, alpha: float) -> Column:
    """Of the loss by the forecast, negated, where ``rest`` is left."""
    if loss == "l2":
        return rest
    if loss == "l1":
        return F.signum(rest)
    if loss == "quantile":
        return F.when(rest >= 0, alpha).otherwise(alpha - 1)
    if loss == "huber":
        return F.greatest(F.lit(-alpha), F.least(F.lit(alpha), rest))
    raise ValueError(f"unknown loss {loss}")


def _values(rows: DataFrame, loss: str, alpha: float, by: Column) -> dict[int, float]:
    """The best constant for each group of ``rest``."""
    if loss == "l2":
        best = F.avg("rest")
    else:
        best = F.percentile_approx("rest", alpha if loss == "quantile" else 0.5, ACCURACY)
    found = {r.node: r.v for r in rows.groupBy(by.alias("node")).agg(best.alias("v")).collect()}
    if loss == "huber" and found:
        over = F.col("rest") - _choose(by, found)
        step = rows.groupBy(by.alias("node")).agg(F.avg(gradient(over, "huber", alpha)).alias("v"))
        found = {r.node: found[r.node] + r.v for r in step.collect()}
    return found


def _choose(node: Column, values: dict[int, float]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(node == k, float(v)) if out is None else out.when(node == k, float(v))
    return F.lit(None).cast("double") if out is None else out


@dataclass
class Tree:
    """Node k is cut at (feature, bin) into 2k + 1 (bins up to it) and 2k + 2; values by leaf."""

    cuts: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def node(self, bins: Column, at: int = 0) -> Column:
        if at not in self.cuts:
            return F.lit(at)
        feature, most = self.cuts[at]
        return F.when(F.get(bins, F.lit(feature)) <= most, self.node(bins, 2 * at + 1)).otherwise(self.node(bins, 2 * at + 2))

    def value(self, bins: Column, at: int = 0) -> Column:
        if at not in self.cuts:
            return F.lit(float(self.values[at]))
        feature, most = self.cuts[at]
        return F.when(F.get(bins, F.lit(feature)) <= most, self.value(bins, 2 * at + 1)).otherwise(self.value(bins, 2 * at + 2))


@dataclass
class Model:
    xs: list[str]
    edges: list[list[float]]
    start: float | None
    rate: float
    trees: list[Tree]

    def bins(self) -> Column:
        """0 for a missing value, else one more than the edges below it."""
        one = lambda x, e: F.when(F.col(x).isNull() | F.isnan(x), 0).otherwise(1 + F.size(F.filter(F.array(*map(F.lit, e)).cast("array<double>"), lambda v: v < F.col(x))))
        return F.array(*[one(x, e) for x, e in zip(self.xs, self.edges, strict=True)])

    def predict(self, rows: DataFrame, name: str = "pred", keep: int = 8) -> DataFrame:
        """``rows`` with the forecast; trees are added ``keep`` at a time, so no expression grows
        with their number."""
        if self.start is None:
            return rows.withColumn(name, F.lit(None).cast("double"))
        out = rows.withColumns({"_bins": self.bins(), name: F.lit(self.start)})
        for k in range(0, len(self.trees), keep):
            out = out.withColumn(name, sum((self.rate * t.value(F.col("_bins")) for t in self.trees[k : k + keep]), F.col(name)))
        return out.drop("_bins")


def _cut(found: list, min_rows: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of a node's best cut, from its (feature, bin, sum, rows); the first
    feature and lowest bin where gains tie."""
    best = None
    features = sorted({r.feature for r in found})
    for f in features:
        own = sorted((r for r in found if r.feature == f), key=lambda r: r.bin)
        total, n = sum(r.g for r in own), sum(r.n for r in own)
        g = left = 0.0
        for r in own[:-1]:
            g, left = g + r.g, left + r.n
            if left < min_rows or n - left < min_rows:
                continue
            gain = g * g / left + (total - g) ** 2 / (n - left) - total * total / n
            if gain > 1e-12 * max(1.0, abs(total)) and (best is None or gain > best[0] * (1 + 1e-12)):
                best = (gain, f, r.bin)
    return best


def fit(train: DataFrame, xs: Sequence[str], y: str, *, loss: str = "l2", alpha: float = 0.5, trees: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, min_rows: int = 20, keep: int = 4) -> Model:
    xs = list(xs)
    own = train.select(*[F.col(x).cast("double").alias(x) for x in xs], F.col(y).cast("double").alias("_y")).filter("_y is not null and not isnan(_y)")
    cuts = [k / bins for k in range(1, bins)]
    valid = lambda x: F.when(~F.isnan(x), F.col(x))
    found = own.agg(*[F.percentile_approx(valid(x), cuts, ACCURACY).alias(f"e{k}") for k, x in enumerate(xs)]).first()
    model = Model(xs, [sorted(set(found[f"e{k}"] or [])) for k in range(len(xs))], None, rate, [])
    start = _values(own.select(F.col("_y").alias("rest")), loss, alpha, F.lit(0))
    if not start:
        return model
    model.start = start[0]
    table = staged(own.select(model.bins().alias("bins"), (F.col("_y") - model.start).alias("rest")), "boost")
    for k in range(trees):
        tree = Tree()
        open_ = [0]
        g = gradient(F.col("rest"), loss, alpha)
        for _ in range(depth):
            rows = table.select(tree.node(F.col("bins")).alias("node"), g.alias("g"), "bins").filter(F.col("node").isin(open_))
            sums = rows.select("node", "g", F.posexplode("bins").alias("feature", "bin")).groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")).collect()
            best = {n: _cut([r for r in sums if r.node == n], min_rows) for n in open_}
            tree.cuts |= {n: (f, b) for n, c in best.items() if c for _, f, b in [c]}
            open_ = [m for n, c in best.items() if c for m in (2 * n + 1, 2 * n + 2)]
            if not open_:
                break
        if not tree.cuts:
            break
        tree.values = _values(table, loss, alpha, tree.node(F.col("bins")))
        model.trees.append(tree)
        table = table.withColumn("rest", F.col("rest") - rate * tree.value(F.col("bins")))
        if (k + 1) % keep == 0 and k + 1 < trees:
            table = staged(table, "boost")
    return model
