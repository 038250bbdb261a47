"""Structured Streaming forms of the ledger and of windowed counts.

Each ``*_stream`` function turns a streaming DataFrame into another; the ``run_*`` functions
drive a finite table through it with an available-now trigger and return what it wrote.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stateful import rocks

#: Micro-batches of a ledger.
BATCHES = 4
_LAST = ("time", "symbol", "side", "shares", "cents", "fee", "l_partkey", "l_discount")


def _folder(spark: SparkSession, label: str) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir. Where that is unset,
    one of this machine, which will do only for a local master."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mirador-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def latest_stream(fills: DataFrame) -> DataFrame:
    """The latest record of each execution, updated as records arrive. Only one struct per
    execution is state, and a maximum does not care for the order of arrival."""
    rank = F.struct(*[F.struct(F.col(c).isNotNull().alias("set"), F.col(c).alias("v")).alias(c) for c in _LAST])
    return fills.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.struct(rank.alias("rank"), F.col("sleeve").alias("sleeve"))).alias("last"))


def run_positions(spark: SparkSession, fills: DataFrame) -> DataFrame:
    """In BATCHES micro-batches at most, however many files there are: a batch costs a commit
    of every part of the state. The state, an entry an execution, is RocksDB's, on disk."""
    source, out = _folder(spark, "fills"), _folder(spark, "latest")
    fills.write.parquet(source)
    files = len(spark.read.schema(fills.schema).parquet(source).inputFiles())
    stream = spark.readStream.schema(fills.schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(source)

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that runs twice overwrites its own folder
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    with rocks(spark):
        q = latest_stream(stream).writeStream.outputMode("update").option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()
    # of the updates of an execution the last epoch's holds
    rows = spark.read.option("basePath", out).parquet(out)
    last = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max_by("last", "epoch").alias("last")).select("last.sleeve", *[F.col(f"last.rank.{c}.v").alias(c) for c in _LAST])
    sign = F.when(F.col("side") == "BOT", 1).otherwise(-1)
    return last.groupBy("sleeve", "symbol").agg(F.sum(sign * F.col("shares")).alias("qty"), F.sum(-sign * F.col("cents") - F.coalesce("fee", F.lit(0))).alias("cash_cents"), F.count(F.when(F.col("fee").isNull(), 1)).alias("missing_fees"))


def window_stream(events: DataFrame, late: str = "1 hour", width: str = "1 hour", step: str | None = None) -> DataFrame:
    """Counts by type in tumbling windows, or in sliding ones that start every ``step``."""
    own = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    return own.groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))


def run_windows(spark: SparkSession, events: DataFrame, **options) -> DataFrame:
    source, out = _folder(spark, "events"), _folder(spark, "windows")
    events.repartitionByRange(4, "ts").write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    windows = window_stream(stream, **options)
    # there without any event too
    spark.createDataFrame([], windows.schema).write.parquet(f"{out}/epoch=-1")

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that runs twice overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    # append mode would end without the windows that the watermark has not closed
    q = windows.writeStream.outputMode("update").option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    # of the updates of a window the last epoch's holds
    rows = spark.read.option("basePath", out).parquet(out)
    last = rows.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "top"), "epoch").alias("last"))
    return last.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "last.n", "last.top")
