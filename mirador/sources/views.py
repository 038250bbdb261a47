"""Domain views over the driver's tables (bars, panels, fills, headlines ...), and readers
for the file layouts the domain uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import r6, ratio


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ticks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("symbol"), "ts", "event_id", F.col("value").alias("price"), "event_type", "props")


def bars_of(rows: DataFrame, *by) -> DataFrame:
    """Open, high, low, close and count per group, in (ts, event_id) order; one partial aggregation."""
    at = F.struct("ts", "event_id")
    return rows.groupBy(*by).agg(F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.count(F.lit(1)).alias("v"))


def bars_daily(spark: SparkSession, d: str) -> DataFrame:
    return bars_of(ticks(spark, d), "symbol", F.to_date("ts").alias("session"))


def weekly(spark: SparkSession, d: str) -> DataFrame:
    """Panel of nations by week: price, high, low, volume."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("p"))
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("symbol"))
    week = F.to_date(F.date_trunc("week", "l_shipdate")).alias("session")
    own = li.join(sup, "l_suppkey").groupBy("symbol", week)
    return own.agg(r6(F.avg("p")).alias("price"), r6(F.max("p")).alias("h"), r6(F.min("p")).alias("l"), F.sum("l_quantity").cast("long").alias("v"))


def calendar(panel: DataFrame) -> DataFrame:
    """(session, ix) with ix dense from 0. The calendar is a small dimension."""
    return panel.select("session").distinct().withColumn("ix", (F.row_number().over(W.orderBy("session")) - 1).cast("long"))


def aligned(panel: DataFrame) -> DataFrame:
    """Every symbol on every session; missing bars are nulls. Two small dimensions make the
    grid, which is as large as the dense panel itself."""
    grid = F.broadcast(calendar(panel)).crossJoin(panel.select("symbol").distinct())
    return grid.join(panel, ["symbol", "session"], "left")


def indexed(panel: DataFrame) -> DataFrame:
    return panel.join(calendar(panel), "session")


def regions(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, region): industry of a nation."""
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("symbol"), F.col("n_regionkey").alias("region"))


def fills(spark: SparkSession, d: str) -> DataFrame:
    """Executions: several records may share an exec_id; the latest holds."""
    li = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("sleeve"))
    return li.join(orders, "l_orderkey").select(
        "l_orderkey", "l_linenumber", F.col("l_shipdate").alias("time"), "sleeve", F.col("l_suppkey").alias("symbol"), F.when(F.col("l_returnflag") == "R", "SLD").otherwise("BOT").alias("side"),
        F.col("l_quantity").cast("long").alias("shares"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("cents"), F.when(F.col("l_tax") > 0, F.floor(F.col("l_tax") * 100 + 0.5).cast("long")).alias("fee"), "l_partkey", "l_discount",
    )


def bar_files(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars from one JSON file a symbol: {symbol, bars: [{date, open, ...}]}."""
    schema = "symbol string, what string, fetched string, bars array<struct<date:string,open:double,high:double,low:double,close:double,volume:double>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select("symbol", F.explode("bars").alias("b"))
    ok = lambda c: F.when(~F.isnan(c), c)
    return rows.select("symbol", F.to_date("b.date", "yyyyMMdd").alias("session"), *[ok(F.col(f"b.{n}")).alias(n[0]) for n in ("open", "high", "low", "close", "volume")])


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only logs; lines that don't parse are kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """Parquet by partition columns; dynamic overwrite replaces only the partitions written."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
