"""How new a text is: its distance from the nearest earlier one of its symbol within a window.

Time is cut in buckets as wide as the window, so an item meets its own bucket and the one
before. A bucket of a symbol is cut into blocks of members and chunks of askers, and a unit
of work is a block and a chunk: a symbol with a third of all items is many units. A unit
returns one number an asker, not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def novelty(items: DataFrame, *, window: int, block: int = 2048) -> DataFrame:
    """``items`` (id, symbol, at in seconds, v an array of doubles of one length) to (id,
    novelty, seen): 1 less the highest inner product with items of the symbol strictly
    earlier and at most ``window`` seconds before, within 0 and 1; 1 where there is none.
    Items without a symbol, a time or a vector have none and are not met."""
    own = items.select("id", "symbol", F.col("at").cast("long").alias("at"), F.col("v").cast("array<double>").alias("v"))
    whole = own.filter("symbol is not null and at is not null and v is not null").withColumn("bucket", F.floor(F.col("at") / window))
    sizes = whole.groupBy("symbol", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    part = lambda n: F.pmod(F.xxhash64("id", "at"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # askers of a bucket go to its members and to those of the bucket before
    asks = whole.join(sizes.withColumnRenamed("parts", "own"), ["symbol", "bucket"]).withColumn("chunk", part("own"))
    asks = asks.withColumn("met", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1))).drop("bucket", "own")
    asks = asks.join(sizes.select("symbol", F.col("bucket").alias("met"), "parts"), ["symbol", "met"]).withColumn("block", every("parts"))
    asks = asks.select("id", "symbol", "at", "v", "met", "block", F.concat_ws(":", F.floor(F.col("at") / window).cast("string"), F.col("chunk").cast("string")).alias("unit"))
    units = asks.select("symbol", "met", "block", "unit").distinct()
    members = whole.join(sizes, ["symbol", "bucket"]).withColumn("block", part("parts")).withColumnRenamed("bucket", "met")
    members = members.select("symbol", "met", "block", "at", "v").join(units, ["symbol", "met", "block"])
    key = ["symbol", "met", "block", "unit"]
    # the two sides come from the same rows, so one has names of its own
    members = members.select(*[F.col(c).alias(f"m_{c}") for c in (*key, "at", "v")])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"id": pa.array([], pa.int64()), "top": pa.array([], pa.float64()), "seen": pa.array([], pa.int64())})
        at, then = left["at"].to_numpy()[:, None], right["m_at"].to_numpy()[None, :]
        near = (then < at) & (then >= at - window)
        dot = np.where(near, _matrix(left["v"]) @ _matrix(right["m_v"]).T, -np.inf)
        some = near.any(1)
        return pa.table({"id": left["id"].to_numpy()[some], "top": dot.max(1)[some], "seen": near.sum(1)[some].astype(np.int64)})

    found = asks.groupBy(*key).cogroup(members.groupBy(*[f"m_{c}" for c in key])).applyInArrow(meet, "id long, top double, seen long")
    best = found.groupBy("id").agg(F.max("top").alias("top"), F.sum("seen").alias("seen"))
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("top")))
    out = own.select("id", (F.col("symbol").isNotNull() & F.col("at").isNotNull() & F.col("v").isNotNull()).alias("ok")).join(best, "id", "left")
    return out.select("id", F.when(F.col("ok"), F.coalesce(new, F.lit(1.0))).alias("novelty"), F.coalesce("seen", F.lit(0)).alias("seen"))
