"""Streams with timers over several batches: late and repeated records, restarts."""

import datetime as dt

from pyspark.sql import functions as F

from mirador.sources.staging import shared_folder
from mirador.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "sleeve string, exec_id long, ts timestamp, cents long, part int"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def tick(hours, part):
    return ("", None, at(hours), 0, part)


def reports(spark, out):
    rows = spark.read.schema(stateful.REPORT).parquet(f"{out}/epoch=*").collect()
    got = {(r.sleeve, (r.look - T0).total_seconds() / 3600): (r.n, r.cents, r.first_id) for r in rows}
    assert len(got) == len(rows)  # a look is told once
    return got


def run(spark, batches, folders=None):
    source, out, state = folders or (shared_folder(spark, x) for x in ("in", "out", "state"))
    for rows in batches:
        df = spark.createDataFrame(rows, SCHEMA)
        stateful.feed(df, source, "part")
        schema = df.drop("part").schema
    stateful.drive(spark, source, schema, lambda s: stateful.look_reports(s, every_minutes=180, late="1 hour"), out, state, "append")
    return source, out, state


FIRST = [
    ("a", 1, at(0.5), 100, 0), ("a", 2, at(2.9), 10, 0), ("b", 3, at(2), 7, 0),
    ("a", 1, at(0.5), 100, 1), ("a", 4, at(3.5), 1, 1), ("a", 5, at(2.7), 1000, 1),  # a repeat, and one out of order but in time
]
LAST = [
    ("a", 4, at(3.5), 1, 2), ("b", 6, at(8), 9, 2),  # the clock goes to 7:00, which closes the looks of 3:00 and 6:00
    ("a", 7, at(2), 5, 3), ("b", 3, at(2), 7, 3), ("a", 8, at(7.5), 3, 3),  # too late; a repeat after its report; in time
    tick(40, 4), tick(41, 5),
]
WANT = {("a", 3.0): (3, 1110, 1), ("b", 3.0): (1, 7, 3), ("a", 6.0): (1, 1, 4), ("b", 9.0): (1, 9, 6), ("a", 9.0): (1, 3, 8)}


def test_reports_of_late_and_repeated_records(spark):
    _, out, _ = run(spark, [FIRST, LAST])
    assert reports(spark, out) == WANT


def test_reports_go_on_after_a_restart(spark):
    folders = run(spark, [FIRST])
    assert reports(spark, folders[1]) == {}  # no look is closed yet
    folders = run(spark, [LAST[:2]], folders)
    run(spark, [LAST[2:]], folders)
    assert reports(spark, folders[1]) == WANT


def test_reports_of_nothing(spark):
    none = spark.createDataFrame([], "sleeve string, exec_id long, ts timestamp_ntz, cents long")
    assert stateful.run_look_reports(spark, none).count() == 0


def test_histories_start_anew_on_another_basis(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [(1, day(k), 100.0 + k, 0, 0) for k in range(4)] + [(2, day(k), 50.0, 0, 0) for k in range(3)]
    rows += [(1, day(3), 103.0, 1, 1), (1, day(4), 104.0, 1, 1), (2, day(2), 50.02, 1, 1)]  # 0.04 % is the same basis
    rows += [(1, day(4), 52.0, 2, 2), (1, day(5), 53.0, 2, 2), (1, day(5), 52.5, 3, 2)]  # a split; the later version holds
    got = stateful.run_bar_store(spark, spark.createDataFrame(rows, "symbol long, session date, c double, version int, part int")).collect()
    assert sorted((r.symbol, r.session, r.c, r.rebased) for r in got) == [(1, day(4), 52.0, True), (1, day(5), 52.5, True), (2, day(0), 50.0, False), (2, day(1), 50.0, False), (2, day(2), 50.02, False)]


def test_the_store_setting_is_put_back(spark):
    was = spark.conf.get(stateful.STORE)
    stateful.run_bar_store(spark, spark.createDataFrame([(1, dt.date(2024, 1, 1), 1.0, 0, 0)], "symbol long, session date, c double, version int, part int")).select(F.count("*")).collect()
    assert spark.conf.get(stateful.STORE) == was


def test_a_number_is_fed_in_several_files(spark, tmp_path):
    for n in (0, 1):
        stateful.feed(spark.createDataFrame([(i, n) for i in range(50 - 49 * n)], "i long, part int"), f"file://{tmp_path}/in", "part")
        assert stateful._files(spark, f"file://{tmp_path}/in") == stateful.FILES * (n + 1)
    assert spark.read.parquet(f"{tmp_path}/in").count() == 51


def test_batches_of_a_ledger_do_not_grow_with_its_files(spark, monkeypatch):
    from mirador.streaming import ledger

    seen, old = [], ledger._folder
    monkeypatch.setattr(ledger, "_folder", lambda s, label: seen.append(old(s, label)) or seen[-1])
    fills = spark.createDataFrame([(i, 1, dt.date(2024, 1, 1), "a", i % 3, "BOT", 2, 10, None, 1, 0.0) for i in range(60)], "l_orderkey long, l_linenumber int, time date, sleeve string, symbol long, side string, shares long, cents long, fee long, l_partkey long, l_discount double").repartition(24)
    got = ledger.run_positions(spark, fills).collect()
    assert sorted((r.symbol, r.qty, r.cash_cents) for r in got) == [(k, 40, -200) for k in range(3)]
    assert spark.read.option("basePath", seen[1]).parquet(seen[1]).select("epoch").distinct().count() <= 4
