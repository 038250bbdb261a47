"""Gaussian hidden Markov chains over ordered series: fitted by expectation-maximisation from
several starts, filtered forward in one pass.

A series is one group: a row a session, so its length is bounded by the calendar. Series,
training prefixes and starts are groups of their own and run in parallel; within a group the
recursions are scaled, so no likelihood underflows, and cost a fixed number of small matrix
products a session.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIT = "start int, rows long, steps int, loglik double, trace array<double>, pi array<double>, move array<array<double>>, mean array<array<double>>, var array<array<double>>, centre array<double>, scale array<double>"


def log_density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Rows by states, independent features."""
    far = ((x[:, None, :] - mean) ** 2 / var).sum(2)
    return -0.5 * (far + np.log(2 * np.pi * var).sum(1))


def forward(x, pi, move, mean, var):
    """(filtered probabilities, scales, densities over their row's largest, log likelihood)."""
    logs = log_density(x, mean, var)
    top = logs.max(1)
    dens = np.exp(logs - top[:, None])
    here, scale = np.empty_like(dens), np.empty(len(x))
    ahead = pi
    for t, d in enumerate(dens):
        joint = ahead * d
        scale[t] = joint.sum()
        here[t] = joint / scale[t]
        ahead = here[t] @ move
    return here, scale, dens, float(np.log(scale).sum() + top.sum())


def backward(dens: np.ndarray, scale: np.ndarray, move: np.ndarray) -> np.ndarray:
    out = np.ones_like(dens)
    for t in range(len(dens) - 1, 0, -1):
        out[t - 1] = move @ (dens[t] * out[t]) / scale[t]
    return out


def weighted(x: np.ndarray, share: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of each state under the rows' shares; no variance under the floor."""
    weight = (share.sum(0) + 1e-9)[:, None]
    mean = share.T @ x / weight
    return mean, np.maximum(share.T @ (x * x) / weight - mean * mean, floor)


def first_shares(x: np.ndarray, states: int, start: int, key: int, seed: int) -> np.ndarray:
    """Start 0 cuts the rows into equal parts by the ``key`` feature; the others are random."""
    if start == 0:
        place = np.argsort(np.argsort(x[:, key]))
        return np.eye(states)[np.minimum(place * states // len(x), states - 1)]
    return np.random.default_rng([seed, start]).dirichlet(np.ones(states), size=len(x))


def climb(x: np.ndarray, share: np.ndarray, *, steps: int, floor: float, least: float):
    """Expectation-maximisation from the shares of a start: the parameters, and the log
    likelihood of each step. It ends once a step gains less than ``least`` of it."""
    k = share.shape[1]
    mean, var = weighted(x, share, floor)
    apart = 0.05 / max(k - 1, 1)
    pi, move, trace = np.full(k, 1 / k), np.full((k, k), apart) + np.eye(k) * (0.95 - apart), []
    move /= move.sum(1, keepdims=True)  # of one state, 1
    for _ in range(steps):
        here, scale, dens, ll = forward(x, pi, move, mean, var)
        later = backward(dens, scale, move)
        share = here * later
        share /= share.sum(1, keepdims=True)
        pairs = here[:-1].T @ (dens[1:] * later[1:] / scale[1:, None]) * move
        pi = (share[0] + 1e-6) / (share[0] + 1e-6).sum()
        move = pairs / pairs.sum(1, keepdims=True)
        mean, var = weighted(x, share, floor)
        trace.append(ll)
        if len(trace) > 1 and ll - trace[-2] < least * abs(ll):
            break
    return pi, move, mean, var, trace


def fit(series: DataFrame, features: Sequence[str], *, by: Sequence[str], order: str, states: int, key: str, starts: int = 5, steps: int = 200, floor: float = 1e-3, least: float = 1e-6, min_rows: int = 30, seed: int = 0) -> DataFrame:
    """``by``, start, rows, steps, loglik, trace and the parameters, a row a series and start.

    Features are standardized by the series' own mean and deviation (kept as centre and
    scale); states are in rising order of the mean of ``key``. Rows with a null feature are
    left out; a series of under ``min_rows`` others gives no fit.
    """
    features, at = list(features), list(features).index(key)

    def run(table: pa.Table) -> pa.Table:
        own = {c: table[c][0].as_py() for c in [*by, "start"]}
        table = table.sort_by(order)
        x = np.column_stack([table[f].to_numpy() for f in features]).astype(float)
        rows = []
        if len(x) >= max(min_rows, 2):
            centre, scale = x.mean(0), x.std(0) + 1e-9
            z = (x - centre) / scale
            pi, move, mean, var, trace = climb(z, first_shares(z, states, own["start"], at, seed), steps=steps, floor=floor, least=least)
            up = np.argsort(mean[:, at], kind="stable")
            rows.append(own | {"rows": len(x), "steps": len(trace), "loglik": trace[-1], "trace": trace, "pi": pi[up].tolist(), "move": move[np.ix_(up, up)].tolist(), "mean": mean[up].tolist(), "var": var[up].tolist(), "centre": centre.tolist(), "scale": scale.tolist()})
        return pa.Table.from_pylist(rows, schema)

    usable = series.select(*by, order, *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=features)
    each = usable.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))))
    keys = ", ".join(f"{c} {usable.schema[c].dataType.simpleString()}" for c in by)
    out = f"{keys}, {FIT}" if keys else FIT
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(out))
    return each.groupBy(*by, "start").applyInArrow(run, out)


def best(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """The start of the highest likelihood of each series, the earlier one where two tie."""
    place = F.row_number().over(W.partitionBy(*(by or [F.lit(1)])).orderBy(F.desc("loglik"), "start"))
    return fits.withColumn("_place", place).filter("_place = 1").drop("_place")


def filtered(series: DataFrame, fits: DataFrame, features: Sequence[str], *, by: Sequence[str], order: str) -> DataFrame:
    """``by``, ``order`` and p, the probability of each state given the rows up to this one;
    one fit a series (``by`` names at least one column), time linear in its length."""
    features, keys = list(features), list(by)

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        names = [*keys, order]
        if not (rows.num_rows and found.num_rows):
            return schema.empty_table()
        rows = rows.sort_by(order)
        m = {c: np.array(found[c][0].as_py()) for c in ("pi", "move", "mean", "var", "centre", "scale")}
        x = np.column_stack([rows[f].to_numpy() for f in features]).astype(float)
        p = forward((x - m["centre"]) / m["scale"], m["pi"], m["move"], m["mean"], m["var"])[0]
        return pa.table([*[rows[c] for c in names], pa.array(p.tolist(), pa.list_(pa.float64()))], schema=schema)

    usable = series.select(*keys, order, *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=features)
    out = ", ".join(f"{c} {usable.schema[c].dataType.simpleString()}" for c in [*keys, order]) + ", p array<double>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(out))
    return usable.groupBy(*keys).cogroup(fits.groupBy(*keys)).applyInArrow(run, out)


def given(pi, move, mean, var) -> dict:
    """Parameters as a row of fits, without scaling."""
    return {"pi": list(pi), "move": [list(r) for r in move], "mean": [list(r) for r in mean], "var": [list(r) for r in var], "centre": [0.0] * len(mean[0]), "scale": [1.0] * len(mean[0])}
