"""Every catalog query with SQL against DuckDB at the smallest size."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mirador.plans import catalog
from tests.oracle import duck, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream_equals_batch(spark):
    from pyspark.sql import functions as F

    from mirador.plans.ledger import latest_fills

    got = {tuple(r) for r in catalog.QUERIES["stream_dedup_ledger"](spark, SF).collect()}
    sign = F.when(F.col("side") == "BOT", 1).otherwise(-1)
    want = latest_fills(spark, SF).groupBy("sleeve", "symbol").agg(F.sum(sign * F.col("shares")), F.sum(-sign * F.col("cents") - F.coalesce("fee", F.lit(0))), F.count(F.when(F.col("fee").isNull(), 1)))
    assert got == {tuple(r) for r in want.collect()}


def test_stream_windows_are_true(spark):
    rows = catalog.QUERIES["stream_window_looks"](spark, SF).collect()
    assert rows
    hours = spark.read.parquet(f"{SF}/events.parquet").selectExpr("date_trunc('hour', ts) h", "event_type").groupBy("h", "event_type").count().collect()
    truth = {(r.h, r.event_type): r["count"] for r in hours}
    assert all(truth[(r.hour, r.event_type)] == r.n for r in rows)


def test_stream_windows_are_whole(spark):
    from mirador.streaming.ledger import run_windows

    events = spark.read.parquet(f"{SF}/events.parquet")
    assert sum(r.n for r in catalog.QUERIES["stream_window_looks"](spark, SF).collect()) == events.count()
    few = events.limit(5).withColumn("ts", F.lit(dt.datetime(2024, 1, 1, 0, 30)).cast("timestamp_ntz"))
    assert sum(r.n for r in run_windows(spark, few).collect()) == 5
    assert run_windows(spark, events.limit(0)).count() == 0
