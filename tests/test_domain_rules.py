"""The domain's rules against values worked by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from mirador.functions import rules as R
from mirador.operators.admission import admit, walk
from mirador.plans.panels import look_states
from mirador.plans.providers import conventions, shifted_to_utc


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r.asDict() for r in df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()]


def near(a, b):
    return a is b is None or (a is not None and b is not None and abs(a - b) < 1e-6)


def test_calendar_of_a_holiday_week(spark):
    day = lambda m, d: dt.date(2001, m, d)
    rows = [(day(7, 2),), (day(7, 4),), (day(7, 6),), (day(7, 7),), (day(7, 3),)]
    got = values(spark, rows, "d date", left=R.sessions_left(F.col("d")), goal=R.goal_day(F.col("d")), after=R.next_session(F.col("d")), before=R.previous_session(F.col("d")), close=R.close_minute(F.col("d")))
    assert [r["left"] for r in got] == [4, 2, 1, 0, 3]  # Wednesday the 4th is off; a Saturday's goal is itself
    assert [r["goal"] for r in got] == [day(7, 6)] * 3 + [day(7, 7), day(7, 6)]
    assert [r["after"] for r in got] == [day(7, 3), day(7, 5), day(7, 9), day(7, 9), day(7, 5)]
    assert [r["before"] for r in got] == [day(6, 29), day(7, 3), day(7, 5), day(7, 6), day(7, 2)]
    assert [r["close"] for r in got] == [960, 960, 960, 960, 780]


def test_looks_and_labels(spark):
    at = dt.date(2001, 7, 3)
    rows = [(at, m) for m in (535, 545, 569, 570, 779, 780, 1000)] + [(dt.date(2001, 7, 4), 600)]
    got = values(spark, rows, "d date, m int", slot=R.slot(F.col("m")), label=R.session_label(F.col("d"), F.col("m")), reacts=R.reacts(F.col("d"), F.col("m")))
    assert [r["slot"] for r in got] == [535, 540, 540, 570, 750, 780, 930, 600]
    assert [r["label"] for r in got] == ["before_open"] * 3 + ["during"] * 2 + ["after_close"] * 2 + ["closed_day"]
    assert [r["reacts"] for r in got] == [at] * 5 + [dt.date(2001, 7, 5)] * 3


def test_odds(spark):
    share = values(spark, [(x,) for x in (-1.0, 0.0, 1.0, 9.0)], "x double", v=R.truncated_share(F.col("x")))
    assert all(near(a["v"], b) for a, b in zip(share, [0.0, 0.0, 0.5160585, 1.0], strict=True))
    credit = values(spark, [(0.01, 0.02), (0.02, 0.02), (0.03, 0.02), (0.05, 0.02), (None, 0.02), (0.01, 0.0)], "d double, r double", v=R.stop_credit(F.col("d"), F.col("r")))
    assert all(near(a["v"], b) for a, b in zip(credit, [1.0, 1.0, 0.5, 0.0, 0.0, 0.0], strict=True))
    touch = values(spark, [(0.2, -0.03, 5.0), (0.2, -0.03, 20.0)], "v double, x double, h double", v=R.touch_probability(F.col("v"), F.col("x"), F.col("h")))
    phi = lambda z: 0.5 * (1 + math.erf(z / 2**0.5))
    assert all(near(a["v"], 2 * phi(math.log(0.97) / (0.2 / 252**0.5 * h**0.5))) for a, h in zip(touch, (5, 20), strict=True))
    assert [r["v"] for r in values(spark, [(x,) for x in (0.04, 3.26, 4.99, 5.3, 7.2)], "x double", v=R.nice(F.col("x")))] == [0.1, 3.3, 5.0, 5.5, 7.0]


def test_costs(spark):
    rows = [(600e6, 2.0), (600e6, 4.0), (60e6, 10.0), (60e6, 11.0), (5e6, 50.0), (5e6, 50.1), (4e6, 1.0), (None, 1.0), (1e9, None)]
    assert [r["t"] for r in values(spark, rows, "a double, s double", t=R.tier(F.col("a"), F.col("s")))] == ["A", "B", "B", "C", "C", "D", "D", "D", "D"]
    sizes = values(spark, [(x,) for x in (5e8, 5e7, 5e6, 5e5, 1.0, None)], "a double", s=R.size_class(F.col("a")))
    assert [r["s"] for r in sizes] == ["very liquid", "liquid", "moderate", "thin", "very thin", "unknown"]
    lit = F.lit
    got = values(spark, [(0,)], "z int", **R.order_cost(lit(100.0), lit(30.0), {"lo": lit(3.0), "med": lit(4.0), "hi": lit(6.0)}, lit(3e8), lit(0.02), lit(0.016)), move=R.move_usd(lit(3000.0), lit(2.0)))[0]
    want = {"impact_lo": 0.126491, "impact_med": 0.316228, "impact_hi": 0.632456, "fee_bps": 6.666667, "cost_lo": 9.919649, "cost_bps": 11.299122, "cost_hi": 13.931578, "cost_usd": 3.389737, "break_even": 0.070620, "share_of_volume": 0.001, "move": 30.0}
    assert all(abs(got[k] - v) < 2e-6 for k, v in want.items())
    unknown = values(spark, [(0,)], "z int", **R.order_cost(lit(100.0), lit(30.0), {"lo": lit(3.0), "med": lit(4.0), "hi": lit(6.0)}, lit(0.0), lit(0.02), lit(0.0)))[0]
    assert unknown["impact_med"] is None and unknown["break_even"] is None and abs(unknown["cost_bps"] - 10.666667) < 2e-6
    fee = values(spark, [(10.0, 2.0), (1000.0, 50.0), (5.0, 100.0)], "q double, p double", v=R.commission_round_trip(F.col("q"), F.col("p")))
    assert all(near(a["v"], b) for a, b in zip(fee, [0.4, 10.0, 2.0], strict=True))


ORDERS = [  # kind, buy, quantity, limit, stop, trail, held, last, range, minute: acts, distance
    (("MKT", True, 10, None, None, None, 0, 100.0, 0.01, 540), (True, None)),
    (("MKT", True, 9, None, None, None, 0, 100.0, 0.01, 540), (False, None)),
    (("LMT", True, 20, 99.0, None, None, 0, 100.0, 0.01, 540), (True, 1.0)),
    (("LMT", True, 20, 99.0, None, None, 0, 100.0, 0.01, 630), (False, 1.0)),
    (("LMT", True, 20, 99.5, None, None, 0, 100.0, 0.01, 630), (True, 0.5)),
    (("LMT", True, 10, 99.5, None, None, 0, 100.0, 0.01, 630), (False, 0.5)),  # $995
    (("STP", False, 50, None, 98.0, None, 100, 100.0, 0.01, 930), (True, 2.0)),
    (("STP", False, 50, None, 97.0, None, 100, 100.0, 0.01, 930), (False, 3.0)),
    (("STP", False, 40, None, 98.0, None, 100, 100.0, 0.01, 540), (False, 2.0)),  # under half
    (("STP", False, 40, None, 99.5, None, 100, 100.0, 0.01, 540), (True, 0.5)),  # but near
    (("STP", True, 50, None, 102.0, None, -100, 100.0, 0.01, 930), (True, 2.0)),
    (("TRAIL", False, 50, None, None, 1.9, 100, 100.0, 0.01, 540), (True, 1.9)),
    (("TRAIL", False, 50, None, None, 2.1, 100, 100.0, 0.01, 540), (False, 2.1)),
    (("TRAIL", False, 50, None, None, 1.9, 0, 100.0, 0.01, 540), (False, 1.9)),
    (("STP LMT", False, 50, 97.5, 98.0, None, 100, 100.0, 0.01, 540), (True, 2.0)),
    (("STP LMT", False, 50, 98.5, 98.0, None, 100, 100.0, 0.01, 540), (False, 2.0)),  # limit over the stop
    (("STP LMT", False, 50, 96.9, 98.0, None, 100, 100.0, 0.01, 540), (False, 2.0)),  # more than a range under it
    (("STP", False, 50, None, 95.0, None, 100, 100.0, None, 540), (True, 5 / 3)),  # 3 % where no range is known
    (("MKT", True, 10, None, None, None, 0, None, 0.01, 540), (False, None)),
]


def test_orders_that_act(spark):
    names = ["kind", "buy", "quantity", "limit", "stop", "trail_pct", "held", "last", "range1", "minute"]
    acts, far = R.substantive(*[F.col(n) for n in names])
    schema = "kind string, buy boolean, quantity int, limit double, stop double, trail_pct double, held int, last double, range1 double, minute int"
    got = values(spark, [o for o, _ in ORDERS], schema, acts=acts, far=far)
    for (order, (want, distance)), r in zip(ORDERS, got, strict=True):
        assert r["acts"] is want and near(r["far"], distance), order
    line = values(spark, [(m,) for m in (500, 540, 629, 630, 780, 929, 930)], "m int", v=R.near_line(F.col("m")))
    assert [r["v"] for r in line] == [1.0, 1.0, 1.0, 0.6, 0.4, 0.4, 0.2]
    lit = F.lit
    levels = values(spark, [("TRAIL", True), ("TRAIL", False), ("STP LMT", True), ("LOC", True), ("MOC", True)], "k string, b boolean", v=R.working_level(F.col("k"), F.col("b"), lit(9.0), lit(11.0), lit(2.0), lit(10.0)))
    assert all(near(a["v"], b) for a, b in zip(levels, [10.2, 9.8, 11.0, 9.0, None], strict=True))


def test_admission_in_turn(spark):
    orders = [(1, 1, 1, "SELL", 30, 50.0), (1, 2, 1, "SELL", 11, 50.0), (1, 3, 2, "BUY", 100, 30.0), (1, 4, 2, "BUY", 80, 30.0), (1, 5, 2, "BUY", 80, 30.0), (1, 6, 3, "BUY", 20, 30.0), (1, 7, 3, "BUY", 1, 30.0), (1, 8, 3, "BUY", 1, 30.0)]
    orders += [(2, 1, 9, "BUY", 60, 40.0), (2, 2, 8, "BUY", 20, 40.0), (2, 3, 1, "BUY", 20, 40.0), (3, 1, 5, "BUY", 10, 40.0), (3, 2, 1, "BUY", 10, 40.0), (3, 3, 1, "SELL", 10, 40.0)]
    book = lambda *rows: [dict(zip(("symbol", "quantity", "close"), r, strict=True)) for r in rows]
    accounts = [(1, 9000.0, book((1, 40, 50.0))), (2, 99000.0, book((9, 60, 45.0), (7, 100, 40.0))), (3, 99000.0, book(*((s, 1, 10.0) for s in (1, 2, 3, 4))))]
    df = spark.createDataFrame(orders, "account int, place int, symbol long, side string, quantity long, limit double")
    own = spark.createDataFrame(accounts, "account int, cash double, book array<struct<symbol:bigint,quantity:bigint,close:double>>")
    got = {(r.account, r.place): r.code for r in admit(df, own).collect()}
    assert [got[1, k] for k in range(1, 9)] == [None, "INSUFFICIENT_UNRESERVED_OWNED_INVENTORY", "MAX_ORDER_NOTIONAL", None, None, None, "MAX_ORDER_RATE", "MAX_ORDER_RATE"]
    assert [got[2, k] for k in range(1, 4)] == ["MAX_SYMBOL_NOTIONAL", None, None]  # 2,700 held and 2,400 more; then a gross of 8,300
    assert [got[3, k] for k in range(1, 4)] == ["MAX_POSITIONS", None, "INSUFFICIENT_UNRESERVED_OWNED_INVENTORY"]
    poor = own.withColumn("cash", F.lit(3000.0))
    assert {(r.account, r.place): r.code for r in admit(df, poor).collect()}[1, 5] == "CASH_OR_MINIMUM_CASH"


def test_orders_walk_the_book(spark):
    schema = "account int, place int, symbol long, buy boolean, quantity long, limit double, stop double, quote double"
    orders = [
        (1, 1, 7, True, 100, 50.0, None, 49.0),  # 5,000 of 10,000 x 2 allowed
        (1, 2, 8, False, 120, None, 100.0, None),  # 12,000 short: 17,000 gross
        (1, 3, 9, True, 40, None, None, 100.0),  # 21,000 gross: refused
        (1, 4, 7, False, 150, None, None, 60.0),  # flips to -50 at 60: 15,000
        (1, 5, 9, True, 40, None, None, 100.0),  # now 12,000 + 50 x 50 + 4,000
        (1, 6, 5, True, 10, None, None, None),  # no price at all: never refused
        (2, 1, 3, False, 10, None, None, None),  # at the position's own mark; reduces
    ]
    accounts = [(1, 10000.0, 10000.0, []), (2, -500.0, 100.0, [{"symbol": 3, "quantity": 30, "mark": 10.0}])]
    own = spark.createDataFrame(accounts, "account int, cash double, value double, book array<struct<symbol:bigint,quantity:bigint,mark:double>>")
    got = {(r.account, r.place): r for r in walk(spark.createDataFrame(orders, schema), own).collect()}
    assert [(got[1, k].q0, got[1, k].q1, got[1, k].p, got[1, k].adds, got[1, k].margin) for k in range(1, 7)] == [(0, 100, 50.0, True, False), (0, -120, 100.0, True, False), (0, 40, 100.0, True, True), (100, -50, 60.0, False, False), (0, 40, 100.0, True, False), (0, 10, None, True, False)]
    assert (got[1, 1].share, got[1, 1].share0, got[1, 1].notional) == (0.5, 0.0, 5000.0) and got[1, 6].share is None
    r = got[2, 1]
    assert (r.q0, r.q1, r.p, r.adds, r.margin, r.share) == (30, 20, 10.0, False, False, 2.0)


def test_states_of_a_look(spark):
    def states(look, *events):
        ev = [dict(zip(("key", "t", "z"), e, strict=True)) for e in events]
        r = look_states(spark.createDataFrame([(look, ev)], "look int, ev array<struct<key:string,t:int,z:double>>")).first()
        return r.state, r.state_z

    assert states(0) == (0, 0)
    assert states(8, ("fomc", 840, 0.0), ("am1", 510, 2.0)) == (2, 2)  # 13:30, before the decision
    assert states(9, ("fomc", 840, 0.0), ("am1", 510, 2.0)) == (1, 1)
    assert [states(k, ("am1", 510, 2.0)) for k in (0, 1, 2, 5, 6)] == [(3, 8), (3, 8), (4, 4), (4, 4), (5, 5)]
    assert states(1, ("am1", 510, 0.9)) == (3, 3) and states(0, ("am1", 570, 2.0)) == (6, 6)  # at 09:30 it is no morning release
    assert [states(k, ("other", 600, 0.0))[0] for k in (0, 1, 2, 3, 4)] == [6, 6, 6, 6, 0]  # an hour before and after
    assert states(6, ("am2", 510, 9.0)) == (7, 7) and states(0, ("am2", 510, 9.0), ("other", 590, 0.0)) == (6, 6)


def test_shifted_times_lead_back(spark):
    rows = [("2024-08-02 00:30:26", "2024-08-01 20:30:26"), ("2024-01-10 02:00:00", "2024-01-09 21:00:00"), ("2024-03-10 11:00:00", "2024-03-10 07:00:00"), ("2024-03-10 09:59:59", "2024-03-10 04:59:59")]
    got = values(spark, rows, "raw string, want string", u=shifted_to_utc(F.to_timestamp("raw")).cast("string"), want=F.col("want"))
    assert all(r["u"] == r["want"] for r in got)


def test_conventions_by_vote(spark):
    t = lambda s: dt.datetime.fromisoformat(s)
    rows = [(1, t("2024-08-02T00:30:26"), t("2024-08-01T20:30:26")), (1, t("2024-08-03T00:00:00"), None), (2, t("2024-08-01T20:30:26"), t("2024-08-01T20:30:26")), (3, t("2024-08-01T20:30:26"), None), (4, t("2024-08-01T20:30:27"), t("2024-08-01T20:30:26"))]
    df = spark.createDataFrame(rows, "user_id int, raw timestamp, known timestamp")
    assert {r.user_id: r.convention for r in conventions(df).collect()} == {1: "shifted", 2: "utc", 3: None, 4: None}


@pytest.mark.parametrize(("text", "money", "whole", "time"), [
    ("1e3", True, False, False), (" 12.50 ", True, False, False), ("-7", True, False, False), (".5", True, False, False), ("5.", True, False, False), ("NaN", False, False, False), ("Infinity", False, False, False), ("1,000", False, False, False), ("12", True, True, False), ("012", True, False, False), ("0", True, False, False), ("true", False, False, False), (None, False, False, False),
    ("2024-01-05T10:00:00Z", False, False, True), ("2024-01-05T10:00:00.123456-05:00", False, False, True), ("2024-01-05 10:00+0530", False, False, True), ("2024-01-05T10:00:00", False, False, False), ("2024-02-30T10:00:00Z", False, False, False), ("2024-01-05T24:00:00Z", False, False, False),
])
def test_fields(spark, text, money, whole, time):
    got = values(spark, [(text,)], "t string", m=R.is_money(F.col("t")), w=R.is_positive_whole(F.col("t")), z=R.is_zoned_time(F.col("t")))[0]
    assert (got["m"], got["w"], got["z"]) == (money, whole, time)


def test_canonical_json(spark):
    from mirador.functions.text import canonical_json

    rows = ['{ "b" : [1, {"d": 2.50, "c": null}], "a": "\\u00e9\\n" }', '{"a": 1, "a": 2}', '{"x": {"a": 1, "a": 1}}', '{"a": NaN}', "[]", "", None, '{"a": 1', '{"a": -Infinity}', "3"]
    got = [r["c"] for r in values(spark, [(r,) for r in rows], "t string", c=canonical_json("t"))]
    assert got == ['{"a":"é\\n","b":[1,{"c":null,"d":2.5}]}', None, None, None, "[]", None, None, None, None, "3"]
