"""Average cost, an ordered fold that no aggregate can express, and orders carried over bars.

The fold streams sorted fills, so a task holds one book's totals and never its fills.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_fills(rows: Iterable[tuple[str, int, int, int | None]]) -> tuple[int, float, float, int, int]:
    """(side, shares, cents, fee) in order to (quantity, average cents, realized cents, fees, fills without a fee).

    Adding to a position moves its average; reducing realizes against it; a flip through
    zero realizes the whole and opens the rest at the new price.
    """
    qty, avg, realized, fees, missing = 0, 0.0, 0.0, 0, 0
    for side, shares, cents, fee in rows:
        price = cents / shares
        move = shares if side == "BOT" else -shares
        if qty == 0 or (qty > 0) == (move > 0):
            avg = (avg * abs(qty) + price * shares) / (abs(qty) + shares)
        else:
            closed = min(abs(qty), shares)
            realized += closed * (price - avg) * (1 if qty > 0 else -1)
            if shares > abs(qty):
                avg = price
        qty += move
        if qty == 0:
            avg = 0.0
        if fee is None:
            missing += 1
        else:
            fees += fee
    return qty, avg, realized, fees, missing


def average_cost(fills: DataFrame, keys: list[str]) -> DataFrame:
    """A book per key: qty, avg_cents, realized_cents (before fees), fees, missing_fees. The
    shuffle sorts each key's fills, and a task streams them past one book at a time."""
    types = {f.name: f.dataType.simpleString() for f in fills.schema.fields}
    totals = {"qty": pa.int64(), "avg_cents": pa.float64(), "realized_cents": pa.float64(), "fees": pa.int64(), "missing_fees": pa.int64()}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", qty long, avg_cents double, realized_cents double, fees long, missing_fees long"
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                kinds[:] = [b.schema.field(c).type for c in keys]
                yield from zip(*(b.column(c).to_pylist() for c in [*keys, "side", "shares", "cents", "fee"]), strict=True)

        books = ((*key, *fold_fills(r[k:] for r in own)) for key, own in groupby(rows(), key=lambda r: r[:k]))
        while some := list(islice(books, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), [*kinds, *totals.values()], strict=True)], [*keys, *totals])

    own = fills.select(*keys, "time", "l_orderkey", "l_linenumber", "side", "shares", "cents", "fee")
    return own.repartition(*keys).sortWithinPartitions(*keys, "time", "l_orderkey", "l_linenumber").mapInArrow(run, schema)


def trailing_fills(bars: DataFrame, percent: float) -> DataFrame:
    """Per symbol the bars it has, and the session and price at which a sell placed on its
    first bar and trailing ``percent`` under the highest price since (that bar's close, then
    highs) fills. A gap below the stop fills at the open. Until it fills the stop depends on
    earlier bars alone, so a running maximum gives it."""
    w = W.partitionBy("symbol").orderBy("session")
    since = F.when(F.row_number().over(w) == 1, F.col("c")).otherwise(F.col("h"))
    b = bars.withColumn("_since", since).withColumn("_stop", F.max("_since").over(w.rowsBetween(W.unboundedPreceding, -1)) * (1 - percent / 100))
    b = b.withColumn("_fill", F.when(F.col("o") <= F.col("_stop"), F.col("o")).when(F.col("l") <= F.col("_stop"), F.col("_stop")))
    hit = F.when(F.col("_fill").isNotNull(), F.struct("session", F.col("_fill").alias("price")))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.min(hit).alias("f")).select("symbol", "bars", "f.session", "f.price")
