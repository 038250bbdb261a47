"""Readers against small files of each layout."""

import datetime as dt
import json

import pytest

from mirador.sources import files


def put(folder, name, value):
    path = folder / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def bar(date, o=1.0, h=2.0, low=0.5, c=1.5, v=10.0):
    return {"date": date, "open": o, "high": h, "low": low, "close": c, "volume": v}


def test_daily_bars_keep_the_later_and_drop_today(spark, tmp_path):
    path = put(tmp_path, "a.json", {"symbol": "A", "what": "TRADES", "fetched": "2024-01-04T09:00", "bars": [bar("20240102"), bar("20240102", c=9.0), bar("20240103", o=-1.0), bar("20240104"), bar("oops")]})
    rows = {r.session: r for r in files.daily_bars(spark, path).collect()}
    assert set(rows) == {dt.date(2024, 1, 2), dt.date(2024, 1, 3)}
    assert rows[dt.date(2024, 1, 2)].c == 9.0 and rows[dt.date(2024, 1, 3)].o is None


def test_implied_vol_and_quotes(spark, tmp_path):
    iv = put(tmp_path, "iv.json", {"symbol": "A", "what": "OPTION_IMPLIED_VOLATILITY", "fetched": "", "bars": [bar("20240102", c=0.3), bar("20240103", c=7.0)]})
    assert [(r.session.day, r.iv) for r in files.implied_vol(spark, iv).collect()] == [(2, 0.3)]
    ba = put(tmp_path, "ba.json", {"symbol": "A", "what": "BID_ASK", "fetched": "", "bars": [bar("20240102", o=1.0, c=1.1), bar("20240103", o=2.0, c=1.0)]})
    assert [(r.bid, r.ask) for r in files.bid_ask(spark, ba).collect()] == [(1.0, 1.1)]


def test_intraday_slots(spark, tmp_path):
    path = put(tmp_path, "i.json", {"symbol": "A", "bars": [bar("20240102 09:30:00 US/Eastern"), bar("20240102 15:30:00 US/Eastern"), bar("20240102 16:00:00 US/Eastern"), bar("20240102 09:45:00 US/Eastern")]})
    assert sorted(r.slot for r in files.intraday_bars(spark, path).collect()) == [0, 12]


def test_universe(spark, tmp_path):
    d = files.industries(spark, put(tmp_path, "d.json", {"A": {"industry": "x", "stock_type": "COMMON"}, "F": {"stock_type": "ETF"}, "N": {}}))
    stocks, funds = files.universe(d)
    assert sorted(r.symbol for r in stocks.collect()) == ["A", "N"] and [r.symbol for r in funds.collect()] == ["F"]


def test_filings(spark, tmp_path):
    text = "symbols,accessionNumber,form,items,filingDate,accepted_utc,session,first_session\nA|B,1,8-K,\"2.02,9.01\",2024-01-02,2024-01-02T21:05:00Z,after_close,2024-01-03\nC,2,8-K,,2024-01-02,,during,2024-01-02\n"
    rows = files.filings(spark, put(tmp_path, "f.csv", text)).collect()
    assert sorted((r.symbol, tuple(r.codes), r.accepted.hour) for r in rows) == [("A", ("2.02", "9.01"), 21), ("B", ("2.02", "9.01"), 21)]


def test_headlines_are_unique(spark, tmp_path):
    h = {"time": "2024-01-02T10:00:00Z", "provider": "P", "article_id": "1", "headline": "!!Hot", "meta": "K:0.5"}
    path = put(tmp_path, "h.json", {"symbol": "A", "headlines": [h, h | {"time": "2024-01-02T11:00:00Z"}, h | {"article_id": "2"}]})
    rows = files.headlines(spark, path).collect()
    assert len(rows) == 2 and {r.headline for r in rows} == {"Hot"} and all(r.ts.hour == 10 for r in rows)


def test_calendar_overrides_and_vintages(spark, tmp_path):
    c = put(tmp_path, "c.json", {"events": [{"id": "a", "key": "cpi", "date": "2024-01-10", "status": "planned", "first_release": {"yoy": 3.1}}, {"id": "b", "key": "nfp", "date": "2024-01-05"}]})
    o = spark.createDataFrame([("a", "2024-01-11", "released")], "id string, date string, status string")
    rows = {r.id: r for r in files.macro_calendar(spark, c, o).collect()}
    assert (rows["a"].date.day, rows["a"].status, rows["a"].first_release) == (11, "released", {"yoy": 3.1}) and rows["b"].date.day == 5
    v = files.vintages(spark, put(tmp_path, "v.csv", "obs_date,value,realtime_start,realtime_end\n2024-01-01,.,2024-02-01,2024-02-28\n2024-01-01,1.5,2024-03-01,9999-12-31\n")).collect()
    assert [(r.value, r.end) for r in v] == [(None, dt.date(2024, 2, 28)), (1.5, None)]


def test_ledger_and_sleeves(spark, tmp_path):
    lines = [{"exec_id": "1", "ref": "tt-alpha-one-7", "symbol": "A", "side": "BOT", "shares": 1, "price": 2}, {"exec_id": "1", "ref": "tt-alpha-one-7", "symbol": "A", "side": "BOT", "shares": 1, "price": 2, "commission": 0.5}]
    path = put(tmp_path, "fills.jsonl", "\n".join(map(json.dumps, lines)) + '\n{"exec_id": "2", "sym')
    rows = files.ledger(spark, path).collect()
    assert [(r.exec_id, r.commission, r.sleeve) for r in rows] == [("1", 0.5, "alpha-one")]
    s = files.sleeves(spark, put(tmp_path, "s.json", {"alpha": {"start_cash": 100, "start": "2024-01-02", "model": "m"}})).first()
    assert (s.sleeve, s.start_cash, s.start.day) == ("alpha", 100.0, 2)


def test_looks(spark, tmp_path):
    look = {"time": "t", "sleeve": "s", "state": {"value": 5.0}, "trace": [{"step": 1, "tool": "quotes"}, {"step": 2, "tool": "news", "error": "x"}], "call": {"place": [{"symbol": "A", "action": "BUY", "quantity": 1}], "cancel": ["r1"], "notes": "n"}}
    own, orders, calls = files.looks(spark, put(tmp_path, "l.json", look))
    assert [(r.value, r.cancels) for r in own.collect()] == [(5.0, 1)] and [r.symbol for r in orders.collect()] == ["A"] and [r.tool for r in calls.orderBy("n").collect()] == ["quotes", "news"]


def test_histories_name_their_errors(spark, tmp_path):
    b = lambda s, o=1.0, h=2.0, low=0.5, c=1.5: {"session": s, "open": o, "high": h, "low": low, "close": c, "volume": 1.0}
    path = put(tmp_path, "x.json", {"A": {"currency": "USD", "bars": [b("2024-01-02"), b("2024-01-02"), b("2024-01-03", h=1.0), b("2024-01-04", o=0.0)]}})
    assert [r.error for r in files.histories(spark, path).orderBy("k").collect()] == [None, "order", "range", "price"]


def test_append_and_write_once(spark, tmp_path):
    df = spark.range(2)
    for _ in range(2):
        files.append(df, str(tmp_path / "log"))
    assert files.json_log(spark, str(tmp_path / "log"), "id long").count() == 4
    files.write_once(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_once(df, str(tmp_path / "once"))
