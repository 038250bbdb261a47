"""Isotonic calibration refitted in time.

Outcomes are summed by score and by the first refit that may use them; scores are rounded
to a grid, which bounds the sums of a key. A key's sums are then added refit by refit to
one sorted list, and each refit pools its adjacent violators: scores whose means fall are
joined until all rise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pooled(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The rising means nearest in weighted squares to hits / n."""
    means, weights, sizes = [], [], []
    for h, k in zip(hits, n, strict=True):
        mean, weight, size = h / k, k, 1
        while means and means[-1] >= mean:
            weight_ = weights.pop()
            mean, weight, size = (means.pop() * weight_ + mean * weight) / (weight_ + weight), weight_ + weight, size + sizes.pop()
        means.append(mean)
        weights.append(weight)
        sizes.append(size)
    return np.repeat(means, sizes)


def refits(rows: DataFrame, blocks: DataFrame, *, score: str, y: str, at: str, by: Sequence[str], grid: int = 256, min_rows: int = 1) -> DataFrame:
    """(by, block, score, n, raw, iso): at each block the calibrated value of every score seen
    in rows with ``at`` <= the block's train_to; blocks with under ``min_rows`` give none.
    ``score`` is in 0..1 and rounded to 1 / ``grid``; ``y`` 0 or 1; null ones are left out."""
    keys = list(by)
    spans = blocks.select("block", F.col("train_to").alias("_to"), F.coalesce(F.lag("train_to").over(W.orderBy("block")), F.lit(-1)).alias("_from"))
    own = rows.dropna(subset=[score, y]).withColumn("_g", F.floor(F.col(score) * grid + 0.5).cast("int"))
    part = own.join(F.broadcast(spans), (F.col(at) <= F.col("_to")) & (F.col(at) > F.col("_from")))
    sums = part.groupBy(*keys, "block", "_g").agg(F.sum(y).cast("double").alias("hits"), F.count(F.lit(1)).cast("double").alias("n"))
    last = blocks.agg(F.max("block")).first()[0]

    def run(table: pa.Table) -> pa.Table:
        own = {c: table[c][0].as_py() for c in keys}
        block, g, hits, n = (table[c].to_numpy() for c in ("block", "_g", "hits", "n"))
        total, seen, out = np.zeros(grid + 1), np.zeros(grid + 1), []
        for b in range(int(block.min()), last + 1):
            new = block == b
            np.add.at(total, g[new], hits[new])
            np.add.at(seen, g[new], n[new])
            at_ = np.flatnonzero(seen)
            if seen.sum() < min_rows:
                continue
            iso = pooled(total[at_], seen[at_])
            out += [own | {"block": b, "score": p / grid, "n": int(k), "raw": h / k, "iso": v} for p, k, h, v in zip(at_.tolist(), seen[at_], total[at_], iso, strict=True)]
        return pa.Table.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys], "block int, score double, n long, raw double, iso double"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return sums.groupBy(*keys).applyInArrow(run, ddl)


def apply(rows: DataFrame, curves: DataFrame, *, score: str, by: Sequence[str]) -> DataFrame:
    """``rows`` (with block) and ``calibrated``: between two scores of the curve the line between
    them, beyond its ends the end's value; null where the block has no curve. A curve is an
    array of at most grid + 1 points."""
    keys = [*by, "block"]
    curve = curves.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("score", "iso"))).alias("_curve"))
    met = rows.join(F.broadcast(curve), keys, "left")
    s = F.col(score)
    below = F.element_at(F.filter("_curve", lambda p: p["score"] <= s), -1)
    above = F.get(F.filter("_curve", lambda p: p["score"] >= s), F.lit(0))
    share = F.coalesce(F.try_divide(s - below["score"], above["score"] - below["score"]), F.lit(0.0))
    line = below["iso"] + (above["iso"] - below["iso"]) * share
    below_any, above_any = F.exists("_curve", lambda p: p["score"] <= s), F.exists("_curve", lambda p: p["score"] >= s)
    ends = F.when(~below_any, F.get("_curve", F.lit(0))["iso"]).when(~above_any, F.element_at("_curve", -1)["iso"]).otherwise(line)
    return met.withColumn("calibrated", F.when(F.col("_curve").isNotNull() & s.isNotNull(), ends)).drop("_curve")
