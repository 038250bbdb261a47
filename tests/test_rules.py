"""Small hand-computed cases."""

import datetime as dt

from pyspark.sql import functions as F

from mirador.functions.scalars import bar_fill, commission, ratio
from mirador.operators import ledger, rolling, temporal, xsection


def test_average_cost_open_add_reduce_flip():
    qty, avg, realized, fees, missing = ledger.fold_fills([("BOT", 10, 1000, 5), ("BOT", 10, 2000, None), ("SLD", 5, 1000, 1), ("SLD", 20, 4000, 1)])
    assert (qty, avg) == (-5, 200.0)
    assert realized == 5 * (200 - 150) + 15 * (200 - 150)
    assert (fees, missing) == (7, 1)


def test_average_cost_closed_is_flat():
    assert ledger.fold_fills([("SLD", 4, 400, 0), ("BOT", 4, 200, 0)])[:3] == (0, 0.0, 200.0)


def test_trailing_stop_gap_touch_and_none(spark):
    def fill(*bars):
        df = spark.createDataFrame([(1, n, *map(float, b)) for n, b in enumerate(bars)], "symbol int, session int, o double, h double, l double, c double")
        r = ledger.trailing_fills(df, 20).first()
        return r and (r.session, r.price)

    assert fill((0, 0, 0, 100), (70, 75, 60, 72)) == (1, 70)
    assert fill((0, 0, 0, 100), (95, 110, 85, 100), (100, 101, 80, 90)) == (2, 88.0)
    assert fill((0, 0, 0, 100), (95, 99, 90, 95)) == (None, None)


def test_zero_prices_give_nulls(spark):
    r = spark.createDataFrame([(1.0, 0.0), (4.0, 2.0)], "a double, b double").select(ratio(F.col("a"), F.col("b")).alias("q")).collect()
    assert [x.q for x in r] == [None, 2.0]


def test_exponential_average_over_many_blocks(spark):
    xs = [None if i % 97 == 5 else (i * 37 % 101) / 7 for i in range(2000)]
    got = [r.e for r in rolling.ema(spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "symbol int, ix long, x double"), "x", 20, "e").orderBy("ix").collect()]
    want, e = [], None
    for x in xs:
        if x is not None:
            e = x if e is None else e * (1 - 2 / 21) + x * 2 / 21
        want.append(e)
    assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9


def test_fills_within_a_bar(spark):
    cases = [
        ("LMT", True, 10.0, None, 9.0), ("LMT", True, 8.5, None, 8.5), ("LMT", True, 5.0, None, None), ("LMT", False, 8.0, None, 9.0), ("STP", True, None, 8.0, 9.0), ("STP", True, None, 11.0, 11.0),
        ("STP", False, None, 8.5, 8.5), ("STP LMT", True, 10.0, 11.0, 10.0), ("STP LMT", True, 7.0, 11.0, None), ("MOC", True, None, None, 10.0), ("LOC", False, 11.0, None, None), ("MKT", True, None, None, 9.0),
    ]
    df = spark.createDataFrame(cases, "kind string, buy boolean, lim double, stop double, want double")
    bar = [F.lit(x) for x in (9.0, 12.0, 8.0, 10.0)]
    for r in df.withColumn("got", bar_fill(F.col("kind"), F.col("buy"), F.col("lim"), F.col("stop"), *bar)).collect():
        assert r.got == r.want, r


def test_commission_cap(spark):
    r = spark.range(1).select(commission(F.lit(10.0), F.lit(2.0)).alias("a"), commission(F.lit(10.0), F.lit(2.0), cap=None).alias("b")).first()
    assert (r.a, r.b) == (0.2, 1.0)


def test_asof_is_strict(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([(1, t(5)), (1, t(1)), (2, t(5))], "k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, t(1), "a"), (1, t(5), "b")], "k int, ts timestamp_ntz, v string")
    got = {(r.k, r.ts.second): r.asof_v for r in temporal.asof(left, right, "k", "ts", ["v"]).collect()}
    assert got == {(1, 5): "a", (1, 1): None, (2, 5): None}
    got = {(r.k, r.ts.second): r.asof_v for r in temporal.asof(left, right, "k", "ts", ["v"], strict=False).collect()}
    assert got == {(1, 5): "b", (1, 1): "a", (2, 5): None}


def test_guards_differ_on_missing_values(spark):
    df = spark.createDataFrame([(1, i, None if i == 2 else float(i)) for i in range(4)], "symbol int, ix long, r double")
    rows = df.select("ix", rolling.full(F.sum("r"), 3).alias("full"), rolling.strict(F.sum("r"), F.col("r"), 3).alias("strict"), rolling.at_least(F.sum("r"), F.col("r"), 3, 2).alias("two")).orderBy("ix").collect()
    assert [r.full for r in rows] == [None, None, 1.0, 4.0]
    assert [r.strict for r in rows] == [None] * 4
    assert [r.two for r in rows] == [None, 1.0, 1.0, 4.0]


def test_rank_ties_go_by_key(spark):
    df = spark.createDataFrame([("s", k, 1.0) for k in range(11)], "session string, symbol int, x double")
    got = [r.p for r in df.select("symbol", xsection.rank_pct("x").alias("p")).orderBy("symbol").collect()]
    assert got[0] == -0.5 and got[-1] == 0.5


def test_median_of_earlier_values(spark):
    xs = [3.0, None, 1.0, 2.0, 2.0, 9.0]
    df = spark.createDataFrame([(k, i, None if x is None else x * k) for k in (1, 2) for i, x in enumerate(xs)], "k int, i int, x double")
    rows = rolling.earlier_median(df, ["k"], ["i"], "x", "m").orderBy("k", "i").collect()
    want = [(None, 0), (3.0, 1), (3.0, 1), (2.0, 2), (2.0, 3), (2.0, 4)]
    assert [(r.m, r.m_n) for r in rows] == [(m if m is None else m * k, n) for k in (1, 2) for m, n in want]


def test_offsets_change_with_the_clocks(spark, tmp_path):
    from zoneinfo import ZoneInfo

    from mirador.plans import catalog

    times = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=7 * n) for n in range(1250)]
    times = [t for t in times if not (t.date() in (dt.date(2024, 3, 10), dt.date(2024, 11, 3)) and t.hour in (1, 2))]
    spark.createDataFrame(list(enumerate(times)), "event_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.offset_hours, r.utc) for r in catalog.QUERIES["time_zones"](spark, str(tmp_path)).collect()}
    for n, t in enumerate(times):
        hours = -t.replace(tzinfo=ZoneInfo("America/New_York")).utcoffset() // dt.timedelta(hours=1)
        assert got[n] == (hours, t + dt.timedelta(hours=hours)), t


def test_normal_distribution_is_close():
    import math

    import duckdb

    from mirador.plans.rules import normal_cdf

    for x in (-3.5, -1.0, 0.0, 0.3, 2.2):
        got = duckdb.connect().execute(f"SELECT {normal_cdf('x')} FROM (SELECT {x}::DOUBLE AS x)").fetchone()[0]
        assert abs(got - 0.5 * (1 + math.erf(x / 2**0.5))) < 2e-7


def test_elimination_solves_a_system(spark):
    from mirador.operators import models

    a, b = [[4.0, 1.0, 0.5], [1.0, 3.0, -1.0], [0.5, -1.0, 2.0]], [1.0, 2.0, 3.0]
    r = models.solve(spark.range(1), [[F.lit(v) for v in row] for row in a], [F.lit(v) for v in b], ["x", "y", "z"]).first()
    for row, v in zip(a, b, strict=True):
        assert abs(row[0] * r.x + row[1] * r.y + row[2] * r.z - v) < 1e-12


def test_probabilities_of_a_zero_value(spark, tmp_path):
    from mirador.plans import catalog
    from tests.oracle import _sorted

    t = dt.datetime(2024, 1, 1)
    events = [(n, t, 1, k, v, "{}") for n, (k, v) in enumerate([("error", 0.0), ("view", 0.0), ("view", 40.0), ("error", 100.0)])]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    df = catalog.QUERIES["rules_probability"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES['rules_probability']})").fetchall()
    got = df.collect()
    assert _sorted(map(tuple, got)) == _sorted(want)
    assert {r.event_id: r.touch for r in got if r.event_id < 2} == {0: 0.0, 1: 0.0}


def _restless(batches):
    """Rows in another order each time they are asked for."""
    import random

    rows = [r for b in batches for r in b.to_pylist()]
    random.SystemRandom().shuffle(rows)
    import pyarrow as pa

    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("grp", pa.int64()), ("member", pa.string()), ("reward", pa.float64())]))


def test_the_median_is_never_above_itself(spark, monkeypatch):
    from mirador.plans import relational

    rows = [(g, m, (1 + k * 7919 % 997) / 100 + n * 5) for g in range(60) for n, m in enumerate("abcde") for k in range(40)]
    df = spark.createDataFrame(rows, "grp long, member string, reward double").repartition(4)
    monkeypatch.setattr(relational, "looks", lambda spark, d: df.mapInArrow(_restless, df.schema))
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = relational.selection_above_median(spark, "").collect()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    assert {(r.grp, r.member) for r in got} == {(g, m) for g in range(60) for m in "de"} and len(got) == 120
