"""Streams with state of their own and timers.

``look_reports``: what a sleeve hears at each look: every execution once, at the first look
after it. Executions come out of order and again and again (a poll overlaps the one before);
a timer at the look's time, in event time, closes it once the watermark has passed, so the
result does not depend on how records were cut into batches.

``bar_store``: a symbol's history from updates that overlap it. A close that differs from
the one held by more than ``tolerance`` means that the whole history was re-based by a
dividend or split: what isn't in the update is dropped, to be fetched again.

State is one entry a symbol, or a sleeve and open look, however many records came. Both need
the RocksDB state store, which the ``run_*`` functions set for their query and set back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.staging import shared_folder, staged

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REPORT = "sleeve string, look timestamp, n long, cents long, first_id long"
BAR = "symbol long, session date, c double, rebased boolean"


class _Reports(StatefulProcessor):
    def __init__(self, every_ms: int):
        self.every = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.looks = handle.getMapState("looks", "look long", "ids array<long>, cents long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            pdf = pdf[pdf["exec_id"].notna()]
            at = pdf["ts"].astype("datetime64[ns]").astype("int64") // 1_000_000
            for look, part in pdf.groupby((at // self.every + 1) * self.every):
                look = int(look)
                if look <= now:  # reported already
                    continue
                ids, cents = self.looks.getValue((look,)) if self.looks.containsKey((look,)) else ([], 0)
                if not len(ids):
                    self.handle.registerTimer(look)
                new = part[~part["exec_id"].isin(list(ids))].drop_duplicates("exec_id")
                self.looks.updateValue((look,), ([*map(int, ids), *map(int, new["exec_id"])], int(cents) + int(new["cents"].sum())))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        look = expiredTimerInfo.getExpiryTimeInMs()
        ids, cents = self.looks.getValue((look,))
        self.looks.removeKey((look,))
        yield pd.DataFrame({"sleeve": [key[0]], "look": [pd.Timestamp(look, unit="ms")], "n": [len(ids)], "cents": [int(cents)], "first_id": [min(map(int, ids))]})

    def close(self) -> None:
        pass


def look_reports(executions: DataFrame, *, every_minutes: int = 180, late: str = "1 hour") -> DataFrame:
    """``executions`` (sleeve, exec_id, ts, cents) to reports; rows without exec_id only move
    the clock. A record for a look that the watermark has passed is dropped."""
    own = executions.select("sleeve", "exec_id", F.col("ts").cast("timestamp").alias("ts"), "cents").withWatermark("ts", late)
    return own.groupBy("sleeve").transformWithStateInPandas(_Reports(every_minutes * 60_000), REPORT, "Append", "EventTime")


class _Bars(StatefulProcessor):
    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getValueState("bars", "days array<int>, closes array<double>, rebased boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, float] = {}
        for pdf in rows:
            new |= dict(zip(pdf.sort_values("version")["day"].astype(int), pdf.sort_values("version")["c"], strict=True))
        days, closes, before = self.bars.get() if self.bars.exists() else ([], [], False)
        held = dict(zip(map(int, days), map(float, closes), strict=True))
        moved = any(d in held and c and abs(c / held[d] - 1) > self.tolerance for d, c in new.items() if held.get(d))
        held = new if moved else held | new
        self.bars.update(([*held], [float(c) for c in held.values()], bool(before or moved)))
        out = pd.DataFrame({"session": pd.to_datetime(pd.Series([*held], dtype="int64"), unit="D").dt.date, "c": [*held.values()]})
        yield out.assign(symbol=int(key[0]), rebased=bool(before or moved))[["symbol", "session", "c", "rebased"]]

    def close(self) -> None:
        pass


def bar_store(updates: DataFrame, *, tolerance: float = 0.0005) -> DataFrame:
    """``updates`` (symbol, session, c, version) to a symbol's whole history, each time it
    changes. Within a batch the higher version of a session holds."""
    own = updates.select("symbol", F.unix_date("session").alias("day"), "c", "version")
    return own.groupBy("symbol").transformWithStateInPandas(_Bars(tolerance), BAR, "Update", "None")


@contextmanager
def rocks(spark: SparkSession):
    """RocksDB keeps the state; all parts on an executor share a bounded memory."""
    own = {STORE: ROCKS, f"{_ROCKSDB}.boundedMemoryUsage": "true", f"{_ROCKSDB}.changelogCheckpointing.enabled": "true"}
    was = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_ROCKSDB = "spark.sql.streaming.stateStore.rocksdb"
#: Files of a micro-batch.
FILES = 4


def drive(spark: SparkSession, source: str, schema, plan: Callable[[DataFrame], DataFrame], out: str, state: str, mode: str) -> None:
    """FILES files a micro-batch from ``source`` through ``plan`` to a folder a batch in ``out``,
    as far as there are files; goes on from the checkpoint ``state`` when called again."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).option("latestFirst", "false").parquet(source)
    with rocks(spark):
        result = plan(stream)

        def write(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")  # a batch that runs twice overwrites itself

        q = result.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
        q.awaitTermination()


def feed(rows: DataFrame, folder: str, part: str) -> None:
    """Files of ``rows`` in the order of the number in column ``part``, FILES a number, some
    of them empty where rows are few. ``rows`` are made in as many tasks as they need."""
    spark = rows.sparkSession
    rows = staged(rows, "feed")
    for n in [r[0] for r in rows.select(part).distinct().orderBy(part).collect()]:
        own = rows.filter(F.col(part) == n).drop(part)
        before = _files(spark, folder)
        own.repartition(FILES).write.mode("append").parquet(folder)
        for _ in range(before + FILES - _files(spark, folder)):
            spark.createDataFrame([], own.schema).coalesce(1).write.mode("append").parquet(folder)


def _files(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(path)) if fs.exists(path) else 0


def run_look_reports(spark: SparkSession, executions: DataFrame, files: int = 6, **options) -> DataFrame:
    """A finite table through the stream: in files by time, each with the last hour of the one
    before it again, and in it the records up to half an hour out of order; then a tick a day
    later, which closes every look."""
    source, out, state = (shared_folder(spark, f"looks-{x}") for x in ("in", "out", "state"))
    own = executions.select("sleeve", "exec_id", F.col("ts").cast("timestamp").alias("ts"), "cents")
    ends = own.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    schema = own.schema
    spark.createDataFrame([], REPORT).write.parquet(f"{out}/epoch=-1")
    if ends.a is not None:
        width = max(1.0, (ends.b - ends.a).total_seconds() / files)
        seen = F.unix_seconds("ts") - int(ends.a.timestamp()) + F.pmod(F.xxhash64("exec_id"), F.lit(1800))
        part = lambda s: F.least(F.lit(files - 1), F.floor(s / width)).cast("int")
        again = F.array_distinct(F.array(part(seen), part(seen + 1800)))
        feed(own.withColumn("part", F.explode(again)), source, "part")
        tick = F.lit(ends.b) + F.expr("interval 1 day")
        for _ in range(2):  # the second lets the clock of the first pass
            feed(own.limit(1).select(F.lit("").alias("sleeve"), F.lit(None).cast(schema["exec_id"].dataType).alias("exec_id"), tick.alias("ts"), F.lit(0).cast(schema["cents"].dataType).alias("cents"), F.lit(files).alias("part")), source, "part")
        drive(spark, source, schema, lambda s: look_reports(s, **options), out, state, "append")
    return spark.read.schema(REPORT).parquet(f"{out}/epoch=*")


def run_bar_store(spark: SparkSession, updates: DataFrame, **options) -> DataFrame:
    """``updates`` with a number ``part``, a file and batch each, through the stream: the last
    history of each symbol."""
    source, out, state = (shared_folder(spark, f"bars-{x}") for x in ("in", "out", "state"))
    spark.createDataFrame([], BAR).write.parquet(f"{out}/epoch=-1")
    feed(updates, source, "part")
    drive(spark, source, updates.drop("part").schema, lambda s: bar_store(s, **options), out, state, "update")
    rows = spark.read.option("basePath", out).schema(f"{BAR}, epoch int").parquet(out)
    last = rows.groupBy("symbol").agg(F.max("epoch").alias("epoch"))
    return rows.join(last, ["symbol", "epoch"]).drop("epoch")
