"""The data source of one file a symbol: what it reads, and what it leaves alone."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mirador.sources.store import bars


@pytest.fixture
def folder(tmp_path):
    for k, symbol in enumerate(["AAA", "BRK B", "CCC"]):
        rows = [{"date": f"202401{d:02d}", "open": 1.0 * d, "high": 2.0 * d, "low": 0.5 * d, "close": 1.5 * d, "volume": float("nan") if d == 3 else 10 * k} for d in (2, 3, 4)]
        (tmp_path / f"{symbol.replace(' ', '_')}.json").write_text(json.dumps({"symbol": symbol, "what": "TRADES" if k else "ADJUSTED_LAST", "bars": rows}))
    (tmp_path / "notes.txt").write_text("not a symbol")
    (tmp_path / "EMPTY.json").write_text(json.dumps({"symbol": "EMPTY", "bars": None}))
    return tmp_path


def test_a_store_as_rows(spark, folder):
    rows = bars(spark, str(folder)).collect()
    assert len(rows) == 9 and {r.symbol for r in rows} == {"AAA", "BRK B", "CCC"}
    assert {(r.o, r.h, r.l, r.c, r.v) for r in rows if r.symbol == "CCC" and r.session == dt.date(2024, 1, 3)} == {(3.0, 6.0, 1.5, 4.5, None)}
    assert {r.symbol for r in bars(spark, str(folder), "ADJUSTED_LAST").collect()} == {"AAA"}
    assert bars(spark, f"file://{folder}").count() == 9


def test_only_files_of_the_symbols_are_opened(spark, folder):
    (folder / "CCC.json").write_text("{broken")
    asked = bars(spark, str(folder)).filter(F.col("symbol").isin("AAA", "BRK B", "ZZZ"))
    assert {(r.symbol, r.n) for r in asked.groupBy("symbol").agg(F.count("*").alias("n")).collect()} == {("AAA", 3), ("BRK B", 3)}
    assert bars(spark, str(folder)).filter("symbol = 'AAA'").filter("symbol = 'BRK B'").count() == 0
    with pytest.raises(Exception, match="JSONDecodeError"):
        bars(spark, str(folder)).count()


def test_sessions_are_pushed(spark, folder):
    df = bars(spark, str(folder))
    assert df.filter("session >= date'2024-01-03' and session < date'2024-01-04' and symbol = 'AAA'").count() == 1
    assert df.filter("session = date'2024-01-04'").count() == 3 and df.filter("session > date'2024-01-03' and session <= date'2024-01-09'").count() == 3
    assert df.filter("c > 5 and symbol = 'AAA'").count() == 1  # Spark's own filter after the source
    plan = df.filter("symbol = 'AAA' and session >= date'2024-01-03'")._jdf.queryExecution().executedPlan().toString()
    assert "bar_store" in plan and "AAA" not in plan and ">=" not in plan  # what is left to Spark is that neither is null
    left = df.filter("c > 5")._jdf.queryExecution().executedPlan().toString()
    assert "> 5.0" in left
