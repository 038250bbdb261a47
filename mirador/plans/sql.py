"""The domain views as SQL common table expressions, for the oracles."""


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6 + 0.0)"


TICKS = "ticks AS (SELECT user_id AS symbol, ts, event_id, value AS price, event_type, props FROM events)"
BARS = f"""{TICKS}, bars AS (SELECT symbol, ts::DATE AS session, arg_min(price, ts) AS o, max(price) AS h, min(price) AS l,
arg_max(price, ts) AS c, count(*)::BIGINT AS v FROM ticks GROUP BY ALL)"""
WEEKLY = f"""weekly AS (SELECT s_nationkey AS symbol, date_trunc('week', l_shipdate)::DATE AS session,
{r6('avg(l_extendedprice / l_quantity)')} AS price, {r6('max(l_extendedprice / l_quantity)')} AS h,
{r6('min(l_extendedprice / l_quantity)')} AS l, sum(l_quantity)::BIGINT AS v
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
CAL = "cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS ix FROM (SELECT DISTINCT session FROM weekly))"
#: The weekly panel aligned to the calendar, missing cells null.
GRID = f"""{WEEKLY}, {CAL}, grid AS (SELECT s.symbol, cal.session, cal.ix::BIGINT AS ix, price, h, l, v FROM cal
CROSS JOIN (SELECT DISTINCT symbol FROM weekly) s LEFT JOIN weekly w ON w.symbol = s.symbol AND w.session = cal.session)"""
#: With one-week log returns.
RET = f"""{GRID}, ret AS (SELECT *, ln(price / lag(price) OVER by_symbol) AS r FROM grid WINDOW by_symbol AS (PARTITION BY symbol ORDER BY ix))"""
FILLS = """fills AS (SELECT l_orderkey, l_linenumber, l_shipdate AS time, o_orderpriority AS sleeve, l_suppkey AS symbol,
CASE WHEN l_returnflag = 'R' THEN 'SLD' ELSE 'BOT' END AS side, l_quantity::BIGINT AS shares,
floor(l_extendedprice * 100 + 0.5)::BIGINT AS cents, CASE WHEN l_tax > 0 THEN floor(l_tax * 100 + 0.5)::BIGINT END AS fee,
l_partkey, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
latest AS (SELECT * FROM fills QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
ORDER BY time DESC, symbol DESC, side DESC, shares DESC, cents DESC, fee DESC NULLS LAST, l_partkey DESC, l_discount DESC) = 1)"""
#: Daily bars aligned to their calendar, and bars of three hours by event type.
BGRID = f"""{BARS}, bcal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS ix FROM (SELECT DISTINCT session FROM bars)), bgrid AS (SELECT s.symbol, bcal.session, bcal.ix::BIGINT AS ix, o, h, l, c, v
FROM bcal CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.session = bcal.session)"""
SLOTS = f"""{TICKS}, slots AS (SELECT event_type AS symbol, ts::DATE AS session, (hour(ts) // 3)::INT AS slot, arg_min(price, ts) AS o, max(price) AS h, min(price) AS l, arg_max(price, ts) AS c, count(*)::BIGINT AS v FROM ticks GROUP BY ALL)"""


def frame(n: int, end: int = 0) -> str:
    """ROWS of the n rows ending ``end`` rows after this one."""
    bound = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"(PARTITION BY symbol ORDER BY ix ROWS BETWEEN {bound(end - n + 1)} AND {bound(end)})"
