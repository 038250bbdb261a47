"""Row rules: clocks, costs, odds, orders, admission, fields, bands. The rules are column
expressions of ``functions.rules``; their SQL is written apart."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.scalars import normal_cdf as phi
from ..functions.scalars import r6
from ..operators.admission import admit, walk
from ..sources import views as V
from . import sql as S
from .catalog import query
from .stages import apply, div, rules

# --- clocks and calendars: an order's day, and its key as a minute of the day ---------------

_OFF = "(month({0}) = 1 AND day({0}) = 1) OR (month({0}) = 7 AND day({0}) = 4) OR (month({0}) = 12 AND day({0}) = 25)"
_OPEN = f"(isodow({{0}}) <= 5 AND NOT ({_OFF}))"


def _near_day(step: str) -> str:
    """The nearest session one to seven days on."""
    day = f"(d {step} k::INT)"
    return f"(SELECT {'min' if step == '+' else 'max'}({day}) FROM (SELECT unnest(range(1, 8)) AS k) WHERE {_OPEN.format(day)})"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderkey % 1440)::INT AS m FROM orders), days AS (SELECT DISTINCT d FROM o),
k AS (SELECT d, {_OPEN.format('d')} AS open_day, CASE WHEN isodow(d) <= 5 THEN d + (5 - isodow(d))::INT ELSE d END AS goal_day, {_near_day('+')} AS next_day, {_near_day('-')} AS prev_day, CASE WHEN strftime(d, '%m%d') IN ('0703', '1224') THEN 780 ELSE 960 END AS close_at FROM days),
j AS (SELECT k.*, (SELECT count(*) FROM (SELECT unnest(range(0, 5)) AS n) WHERE k.d + n::INT <= k.goal_day AND {_OPEN.format('(k.d + n::INT)')}) AS sessions_left FROM k),
l AS (SELECT o_orderkey, m, j.*, CASE WHEN NOT open_day THEN 'closed_day' WHEN m < 570 THEN 'before_open' WHEN m < close_at THEN 'during' ELSE 'after_close' END AS label FROM o JOIN j ON j.d = o.d)
SELECT o_orderkey, m, printf('%02d:%02d', m // 60, m % 60) AS hhmm, least(13, greatest(0, (m - 570) // 30))::INT AS bars_done, CASE WHEN m < 540 THEN m ELSE least(930, m // 30 * 30) END::INT AS slot, close_at::INT AS close_at, open_day, label, CASE WHEN label IN ('before_open', 'during') THEN d ELSE next_day END AS reacts, prev_day, goal_day,
CASE WHEN isodow(d) >= 6 THEN d + (8 - isodow(d))::INT ELSE d - (isodow(d) - 1)::INT END AS monday, 'Q' || quarter(d) AS quarter_label, year(d) || CASE WHEN month(d) < 7 THEN 'H1' ELSE 'H2' END AS half_label, (date_trunc('quarter', d) - INTERVAL 3 MONTH)::DATE AS quarter_ago, (date_trunc('month', d) - INTERVAL 1 YEAR)::DATE AS year_ago,
sessions_left::INT AS sessions_left, label = 'after_close' AND m >= close_at + 240 AS late FROM l""")
def rules_time(spark, d):
    """Minutes, completed half-hour bars, the look that was due, closing time and label, the
    sessions around a day, its week's goal and the sessions left to it."""
    o = V.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderkey") % 1440).cast("int").alias("m"))
    day, m, dow = F.col("d"), F.col("m"), F.weekday("d")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    label = R.session_label(day, m)
    return o.select(
        "o_orderkey", "m", F.concat(two(F.floor(m / 60)), F.lit(":"), two(m % 60)).alias("hhmm"), F.greatest(F.lit(0), F.least(F.lit(13), F.floor((m - 570) / 30))).cast("int").alias("bars_done"), R.slot(m).alias("slot"), R.close_minute(day).alias("close_at"),
        R.trading_day(day).alias("open_day"), label.alias("label"), R.reacts(day, m).alias("reacts"), R.previous_session(day).alias("prev_day"), R.goal_day(day).alias("goal_day"), F.date_add(day, F.when(dow >= 5, 7 - dow).otherwise(-dow)).alias("monday"), F.concat(F.lit("Q"), F.quarter(day)).alias("quarter_label"),
        F.concat(F.year(day), F.when(F.month(day) <= 6, "H1").otherwise("H2")).alias("half_label"), F.to_date(F.add_months(F.date_trunc("quarter", day), -3)).alias("quarter_ago"), F.to_date(F.add_months(F.date_trunc("month", day), -12)).alias("year_ago"), R.sessions_left(day).alias("sessions_left"),
        ((label == "after_close") & (m >= R.close_minute(day) + 240)).alias("late"),
    )


# --- costs ---------------------------------------------------------------------------------

_COST_IN = {"px": div("l_extendedprice", "l_quantity"), "q": "l_quantity", "spread": "1 + 400 * l_tax", "adv": "l_partkey * 400000e0", "sigma": "l_discount / 4", "span": "l_tax * 50"}


@query(f"""WITH i AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _COST_IN.items())} FROM lineitem), p AS (SELECT *, q * px AS notional, sqrt(q * px / nullif(adv, 0)) AS root, least(greatest(1, q / 200), q * px / 100) AS one FROM i),
c AS (SELECT *, 20000 * one / notional AS fee_bps, CASE WHEN sigma <> 0 THEN 10000 * sigma * root END AS full_impact FROM p), t AS (SELECT *, spread + coalesce(full_impact, 0) + fee_bps AS cost_bps FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN adv >= 500e6 AND spread <= 3 THEN 'A' WHEN adv >= 50e6 AND spread <= 10 THEN 'B' WHEN adv >= 5e6 AND spread <= 50 THEN 'C' ELSE 'D' END AS tier,
CASE WHEN adv IS NULL THEN 'unknown' WHEN adv >= 500e6 THEN 'very liquid' WHEN adv >= 50e6 THEN 'liquid' WHEN adv >= 5e6 THEN 'moderate' WHEN adv >= 0.5e6 THEN 'thin' ELSE 'very thin' END AS size_class, {S.r6('2 * one')} AS both_sides, {S.r6('fee_bps')} AS fee_bps,
{S.r6('full_impact * 0.5')} AS impact_med, {S.r6('0.8 * spread + 0.4 * coalesce(full_impact, 0) + fee_bps')} AS cost_lo, {S.r6('cost_bps')} AS cost_bps, {S.r6('1.5 * spread + 2 * coalesce(full_impact, 0) + fee_bps')} AS cost_hi, {S.r6('cost_bps * notional / 1e4')} AS cost_usd, {S.r6('CASE WHEN sigma <> 0 THEN cost_bps / (0.8 * sigma * 1e4) END')} AS break_even, {S.r6('100 * (notional / nullif(adv, 0))')} AS share_of_volume, {S.r6('notional * span / 200')} AS move_usd FROM t""")
def rules_costs(spark, d):
    """Commissions, liquidity tiers, square-root impact and the round trip's cost at a low,
    middle and high spread; the share of a usual day's move that it takes, and that move in dollars."""
    i = apply(V.table(spark, d, "lineitem"), _COST_IN)
    px, q, spread, adv, sigma = (F.col(c) for c in ("px", "q", "spread", "adv", "sigma"))
    c = R.order_cost(px, q, {"lo": 0.8 * spread, "med": spread, "hi": 1.5 * spread}, adv, sigma, 0.8 * sigma)
    numbers = {"both_sides": R.commission_round_trip(q, px), **{k: c[k] for k in ("fee_bps", "impact_med", "cost_lo", "cost_bps", "cost_hi", "cost_usd", "break_even", "share_of_volume")}, "move_usd": R.move_usd(q * px, F.col("span"))}
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", R.tier(adv, spread).alias("tier"), R.size_class(adv).alias("size_class"), *[r6(v).alias(k) for k, v in numbers.items()])


# --- odds ----------------------------------------------------------------------------------


def normal_cdf(x: str) -> str:
    """By the rational approximation of the error function, to seven decimals."""
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2e0)))"
    # fixed values of the approximation
    poly = f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"
    erf = f"(1 - {poly} * exp(-({x}) * ({x}) / 2))"
    return f"(0.5 * (1 + CASE WHEN ({x}) < 0 THEN -1 ELSE 1 END * {erf}))"


_ODDS = {"x": "(value - 100) / 40", "p": "(event_id % 101) / 100e0", "y": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END", "bid": "(event_id % 90) / 100e0", "ask": "(event_id % 90) / 100e0 + (event_id % 30) / 100e0", "last": "CASE WHEN event_id % 3 = 0 THEN (event_id % 90) / 100e0 + 0.01 END", "dist": "value / 2000", "range1": "CASE WHEN event_id % 9 > 0 THEN 0.01 * (event_id % 9) END", "vol": "value / 400", "drop_": "-0.01 * (1 + event_id % 9)", "given": "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 1.5 ELSE (event_id % 101) / 100e0 END"}


@query(f"""WITH i AS (SELECT event_id, value, {', '.join(f'{e} AS {n}' for n, e in _ODDS.items())} FROM events), c AS (SELECT *, exp(x * x / -2) / sqrt(2 * pi()) AS pdf, {normal_cdf('x')} AS cdf, ln(1 + drop_) * sqrt(252e0 / 5) / vol AS z FROM i)
SELECT event_id, {S.r6('pdf')} AS pdf, {S.r6('cdf')} AS cdf, {S.r6('CASE WHEN x > 0 THEN least(1, 1 - 2 * x * pdf + 2 * (1 - cdf) * (x * x - 1)) ELSE 0 END')} AS kept,
{S.r6('CASE WHEN range1 > 0 THEN greatest(0, least(1, 2 - dist / range1)) ELSE 0 END')} AS credit, {S.r6(f"least(1, 2 * {normal_cdf('z')})")} AS touch, {S.r6('CASE WHEN ask - bid <= 0.15 OR last IS NULL THEN (bid + ask) / 2 ELSE last END')} AS quote_p, {S.r6('CASE WHEN given >= 0 AND given <= 1 THEN 1 - power(given - y, 2) END')} AS reward, {S.r6('CASE WHEN given >= 0 AND given <= 1 THEN 1 - power(given - y, 2) ELSE 0 END')} AS score,
{S.r6('CASE y WHEN 1 THEN -ln(greatest(0.01, p)) ELSE -ln(greatest(0.01, 1 - p)) END')} AS logloss, {S.r6('greatest(0.1, CASE WHEN value < 5 THEN floor(value * 10 + 0.5) / 10 ELSE floor(value * 2 + 0.5) / 2 END)')} AS nice FROM c""")
def rules_probability(spark, d):
    """Normal density and distribution, what a stop leaves of the downside, its credit by
    distance, the chance that a random walk falls so far, a quote's probability, the reward
    and score of a stated one, log loss, and round figures."""
    i = apply(V.table(spark, d, "events"), _ODDS)
    x, y, p, given = (F.col(c) for c in ("x", "y", "p", "given"))
    fits = given.between(0, 1)
    reward = F.when(fits, 1 - (given - y) * (given - y))
    quote = F.when(F.col("ask") - F.col("bid") <= 0.15, (F.col("bid") + F.col("ask")) / 2).otherwise(F.coalesce("last", (F.col("bid") + F.col("ask")) / 2))
    out = {"pdf": R.normal_pdf(x), "cdf": phi(x), "kept": R.truncated_share(x), "credit": R.stop_credit(F.col("dist"), F.col("range1")), "touch": R.touch_probability(F.col("vol"), F.col("drop_"), F.lit(5.0)), "quote_p": quote, "reward": reward, "score": F.coalesce(reward, F.lit(0.0)), "logloss": -(y * F.ln(F.greatest(F.lit(0.01), p)) + (1 - y) * F.ln(F.greatest(F.lit(0.01), 1 - p))), "nice": R.nice(F.col("value"))}
    return i.select("event_id", *[r6(v).alias(k) for k, v in out.items()])


# --- orders --------------------------------------------------------------------------------

_ORDER = {
    "side": "CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END", "kind": "CASE WHEN o_orderkey % 6 = 0 THEN 'MKT' WHEN o_orderkey % 6 = 1 THEN 'LMT' WHEN o_orderkey % 6 = 2 THEN 'STP' WHEN o_orderkey % 6 = 3 THEN 'STP LMT' WHEN o_orderkey % 6 = 4 THEN 'TRAIL' ELSE 'MOC' END", "qty": "o_orderkey % 40 + 1", "held": "(o_custkey % 81) - 40", "last": "50 + o_custkey % 100", "off": "(o_orderkey % 17 - 8) / 200e0", "m": "(o_orderkey % 420 + 540)::INT", "r1": "0.01 + (o_custkey % 5) / 100e0",
}
_PRICED = {**_ORDER, "lim": "CASE WHEN o_orderkey % 6 IN (1, 3) THEN (50 + o_custkey % 100) * (1 + (o_orderkey % 17 - 8) / 200e0) END", "stp": "CASE WHEN o_orderkey % 6 IN (2, 3) THEN (50 + o_custkey % 100) * (1 - (o_orderkey % 13 - 6) / 200e0) END", "trail": "CASE WHEN o_orderkey % 6 = 4 THEN (1 + o_orderkey % 9) * 1e0 END"}


@query(f"""WITH o AS (SELECT o_orderkey, {', '.join(f'{e} AS {n}' for n, e in _PRICED.items())} FROM orders),
a AS (SELECT *, held + CASE side WHEN 'BUY' THEN qty ELSE -qty END AS after, CASE WHEN m >= 930 THEN 0.2 WHEN m >= 780 THEN 0.4 WHEN m >= 630 THEN 0.6 ELSE 1.0 END AS line, CASE kind WHEN 'LMT' THEN lim WHEN 'STP' THEN stp WHEN 'STP LMT' THEN stp WHEN 'TRAIL' THEN CASE side WHEN 'SELL' THEN last - last * trail / 100 ELSE last + last * trail / 100 END END AS level FROM o),
b AS (SELECT *, CASE WHEN kind = 'TRAIL' THEN trail / 100 / r1 ELSE abs(level - last) / last / r1 END AS far, kind IN ('STP', 'STP LMT', 'TRAIL') AND held <> 0 AND abs(after) < abs(held) AND 2 * least(qty, abs(held)) >= abs(held) AND least(qty, abs(held)) * last >= 1000 AS guards, kind = 'STP LMT' AND NOT ((CASE side WHEN 'SELL' THEN stp - lim ELSE lim - stp END) BETWEEN 0 AND last * r1) AS apart FROM a)
SELECT o_orderkey, side, kind, CASE WHEN kind IN ('STP', 'STP LMT', 'TRAIL') THEN 'stop' ELSE kind END AS family, held <> 0 AND held * (after - held) < 0 AS exit_side, after, held * after < 0 AS flips, {S.r6('level')} AS level, {S.r6('far')} AS ranges, {S.r6('line')} AS line,
CASE WHEN kind = 'TRAIL' OR (guards AND NOT apart) THEN guards AND far <= 2 WHEN apart THEN FALSE ELSE qty * CASE WHEN kind IN ('LMT', 'STP', 'STP LMT') THEN level ELSE last END >= 1000 AND (far IS NULL OR far <= line) END AS substantive FROM b""")
def rules_orders(spark, d):
    """What an order does: exit or entry, its working level and its distance in usual ranges,
    the distance allowed at that minute, and whether it counts as acting."""
    o = apply(V.table(spark, d, "orders"), _PRICED)
    c = {n: F.col(n) for n in ("kind", "qty", "lim", "stp", "trail", "held", "last", "r1", "m")}
    buy = F.col("side") == "BUY"
    acts, far = R.substantive(c["kind"], buy, c["qty"], c["lim"], c["stp"], c["trail"], c["held"], c["last"], c["r1"], c["m"])
    after = c["held"] + F.when(buy, c["qty"]).otherwise(-c["qty"])
    return o.select("o_orderkey", "side", "kind", F.when(c["kind"].isin(*R.STOPS), "stop").otherwise(c["kind"]).alias("family"), ((c["held"] != 0) & ((c["held"] > 0) != buy)).alias("exit_side"), after.alias("after"), ((c["held"] > 0) & (after < 0) | (c["held"] < 0) & (after > 0)).alias("flips"), r6(R.working_level(c["kind"], buy, c["lim"], c["stp"], c["trail"], c["last"])).alias("level"), r6(far).alias("ranges"), r6(R.near_line(c["m"])).alias("line"), acts.alias("substantive"))


_DECISION = {"n": "l_linenumber", "sym": "l_suppkey % 3", "side": "CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END", "kind": "CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_partkey % 2 = 0 THEN 'STP' ELSE 'TRAIL' END WHEN l_partkey % 3 = 0 THEN 'LMT' ELSE 'MKT' END", "held": "((l_orderkey + l_suppkey % 3) % 5 - 2) * 20", "qty": "l_quantity::INT"}


@query(f"""WITH o AS (SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, {', '.join(f'{e} AS {n}' for n, e in _DECISION.items())} FROM lineitem),
s AS (SELECT *, CASE side WHEN 'BUY' THEN qty ELSE -qty END AS signed, kind IN ('STP', 'TRAIL') AS is_stop, row_number() OVER (PARTITION BY l_orderkey, sym ORDER BY n, l_partkey, l_suppkey, l_shipdate, qty, side, kind) AS k FROM o),
b AS (SELECT *, held + coalesce(sum(signed) OVER (PARTITION BY l_orderkey, sym ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS q0 FROM s),
e AS (SELECT l_orderkey, sym, arg_min(q0, k) FILTER (NOT is_stop) + sum(signed) FILTER (NOT is_stop) AS leaves FROM b GROUP BY ALL),
f AS (SELECT b.l_orderkey, b.sym, CASE WHEN is_stop THEN (coalesce(leaves, q0) > 0 AND side = 'SELL') OR (coalesce(leaves, q0) < 0 AND side = 'BUY') ELSE kind = 'LMT' AND q0 <> 0 AND abs(q0 + signed) < abs(q0) END AS guards FROM b JOIN e ON e.l_orderkey = b.l_orderkey AND e.sym = b.sym)
SELECT l_orderkey, count(*)::BIGINT AS orders, count(*) FILTER (guards)::BIGINT AS guarding, bool_or(guards) AS protective FROM f GROUP BY l_orderkey""")
def decision_protective(spark, d):
    """Whether a decision protects: a stop on the exit side of the position that its other
    orders leave, or a limit that reduces what was held when it came."""
    o = apply(V.table(spark, d, "lineitem"), _DECISION).withColumns({"signed": F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")), "stop": F.col("kind").isin(*R.STOPS)})
    own = W.partitionBy("l_orderkey", "sym")
    k = own.orderBy("n", "l_partkey", "l_suppkey", "l_shipdate", "qty", "side", "kind")
    b = o.withColumns({"k": F.row_number().over(k), "q0": F.col("held") + F.coalesce(F.sum("signed").over(k.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    other = lambda c: F.when(~F.col("stop"), c)
    leaves = F.min(other(F.struct("k", "q0"))).over(own)["q0"] + F.sum(other(F.col("signed"))).over(own)
    side = F.coalesce(leaves, F.col("q0"))
    guards = F.when(F.col("stop"), F.when(F.col("side") == "SELL", side > 0).otherwise(side < 0)).otherwise((F.col("kind") == "LMT") & (F.col("q0") != 0) & (F.abs(F.col("q0") + F.col("signed")) < F.abs("q0")))
    return b.withColumn("g", guards).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("orders"), F.count(F.when(F.col("g"), 1)).alias("guarding"), F.bool_or("g").alias("protective"))


_QUEUE = {"n": "l_linenumber", "sym": "l_suppkey % 6", "side": "CASE WHEN l_returnflag = 'R' THEN 'SELL' ELSE 'BUY' END", "qty": "1 + l_partkey % 45", "px": "floor(l_extendedprice / l_quantity) / 20"}
_HELD, _CLOSE = "((o_orderkey + {0}) % 4 * 15)", "(20 + 5 * {0})"


@query(f"""WITH RECURSIVE o AS (SELECT l_orderkey, {', '.join(f'{e} AS {n}' for n, e in _QUEUE.items())}, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_extendedprice, l_quantity) AS k FROM lineitem),
a AS (SELECT o_orderkey, 2000 + o_totalprice / 100 AS cash, list_filter([{', '.join(f"{{'s': {s}, 'q': {_HELD.format(s)}, 'c': {_CLOSE.format(s)}}}" for s in range(6))}], lambda h: h.q > 0) AS book FROM orders),
r AS (SELECT o_orderkey, 0::BIGINT AS k, cash, book, [] ::STRUCT(s BIGINT, side VARCHAR, q BIGINT, px DOUBLE)[] AS queue, NULL::VARCHAR AS code FROM a
UNION ALL SELECT o_orderkey, k, cash, book, CASE WHEN code IS NULL THEN list_append(queue, {{'s': sym, 'side': side, 'q': qty, 'px': px}}) ELSE queue END, code FROM (SELECT r.o_orderkey, o.k, cash, book, queue, sym, side, qty, px, CASE WHEN len(queue) >= 4 THEN 'MAX_ORDER_RATE'
WHEN side = 'SELL' THEN CASE WHEN qty + coalesce(list_sum(list_transform(list_filter(queue, lambda x: x.s = sym AND x.side = 'SELL'), lambda x: x.q)), 0) > coalesce(list_sum(list_transform(list_filter(book, lambda h: h.s = sym), lambda h: h.q)), 0) THEN 'INSUFFICIENT_UNRESERVED_OWNED_INVENTORY' END
WHEN qty * px > 2500 THEN 'MAX_ORDER_NOTIONAL' WHEN cash - coalesce(list_sum(list_transform(list_filter(queue, lambda x: x.side = 'BUY'), lambda x: x.q * x.px + greatest(1, 0.005 * x.q))), 0) - qty * px - greatest(1, 0.005 * qty) < 500 THEN 'CASH_OR_MINIMUM_CASH'
WHEN coalesce(list_sum(list_transform(list_filter(book, lambda h: h.s = sym), lambda h: h.q * h.c)), 0) + coalesce(list_sum(list_transform(list_filter(queue, lambda x: x.side = 'BUY' AND x.s = sym), lambda x: x.q * x.px)), 0) + qty * px > 5000 THEN 'MAX_SYMBOL_NOTIONAL'
WHEN coalesce(list_sum(list_transform(book, lambda h: h.q * h.c)), 0) + coalesce(list_sum(list_transform(list_filter(queue, lambda x: x.side = 'BUY'), lambda x: x.q * x.px)), 0) + qty * px > 9000 THEN 'MAX_GROSS_NOTIONAL'
WHEN NOT list_contains(list_concat(list_transform(book, lambda h: h.s), list_transform(list_filter(queue, lambda x: x.side = 'BUY'), lambda x: x.s)), sym) AND len(list_distinct(list_concat(list_transform(book, lambda h: h.s), list_transform(list_filter(queue, lambda x: x.side = 'BUY'), lambda x: x.s)))) >= 4 THEN 'MAX_POSITIONS' END AS code FROM r JOIN o ON o.l_orderkey = r.o_orderkey AND o.k = r.k + 1))
SELECT o_orderkey, k::INT AS place, code FROM r WHERE k > 0""")
def capacity_codes(spark, d):
    """An account's orders of a session, one after another: the first rule that refuses each,
    null where it joins the queue, which reserves cash and shares from those that follow."""
    o = apply(V.table(spark, d, "lineitem"), _QUEUE)
    a = V.table(spark, d, "orders")
    book = F.filter(F.array(*[F.struct(F.lit(s).cast("long").alias("symbol"), F.expr(_HELD.format(s)).cast("long").alias("quantity"), F.expr(_CLOSE.format(s)).cast("double").alias("close")) for s in range(6)]), lambda h: h["quantity"] > 0)
    accounts = a.select(F.col("o_orderkey").alias("account"), (2000 + F.col("o_totalprice") / 100).alias("cash"), book.alias("book"))
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice", "l_quantity"))
    asked = o.select(F.col("l_orderkey").alias("account"), place.alias("place"), F.col("sym").cast("long").alias("symbol"), "side", F.col("qty").cast("long").alias("quantity"), F.col("px").alias("limit"))
    return admit(asked, accounts).select(F.col("account").alias("o_orderkey"), "place", "code")


_WALK = {"n": "l_linenumber", "sym": "l_suppkey % 5", "buy": "l_returnflag <> 'R'", "qty": "1 + l_partkey % 30", "lim": "CASE WHEN l_partkey % 3 = 0 THEN floor(l_extendedprice / l_quantity) / 10 END", "stp": "CASE WHEN l_partkey % 3 = 1 THEN floor(l_extendedprice / l_quantity) / 12 END", "quote": "CASE WHEN l_suppkey % 5 <> 4 THEN 60e0 + l_suppkey % 5 END"}
_POS, _MARK = "((o_orderkey + {0}) % 3 - 1) * 25", "(55 + 3 * {0})"


@query(f"""WITH RECURSIVE o AS (SELECT l_orderkey, {', '.join(f'{e} AS {n}' for n, e in _WALK.items())}, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_returnflag, l_extendedprice, l_quantity) AS k FROM lineitem),
a AS (SELECT o_orderkey, 1000 + o_totalprice / 100 AS cash, list_filter([{', '.join(f"{{'s': {s}::BIGINT, 'q': ({_POS.format(s)})::BIGINT, 'm': {_MARK.format(s)}::DOUBLE}}" for s in range(3))}], lambda h: h.q <> 0) AS book FROM orders), b AS (SELECT *, cash + coalesce(list_sum(list_transform(book, lambda h: h.q * h.m)), 0) AS nav FROM a),
r AS (SELECT o_orderkey, 0::BIGINT AS k, nav, book, NULL::BIGINT AS q0, NULL::BIGINT AS q1, NULL::DOUBLE AS p, NULL::BOOLEAN AS adds, NULL::BOOLEAN AS margin FROM b
UNION ALL SELECT o_orderkey, k, nav, CASE WHEN margin THEN book ELSE list_append(list_filter(book, lambda h: h.s <> sym), {{'s': sym, 'q': q1, 'm': coalesce(mark, p)}}) END, q0, q1, p, adds, margin FROM (SELECT *, p IS NOT NULL AND adds AND coalesce(list_sum(list_transform(list_filter(book, lambda h: h.s <> sym), lambda h: abs(h.q) * coalesce(h.m, p))), 0) + abs(q1) * p > 2 * greatest(nav, 0) AS margin
FROM (SELECT *, q0 + signed AS q1, abs(q0 + signed) > abs(q0) AS adds, coalesce(lim, stp, quote, mark) AS p FROM (SELECT r.o_orderkey, o.k, nav, book, sym, CASE WHEN buy THEN qty ELSE -qty END AS signed, lim, stp, quote, coalesce(list_filter(book, lambda h: h.s = sym)[1].q, 0) AS q0, list_filter(book, lambda h: h.s = sym)[1].m AS mark FROM r JOIN o ON o.l_orderkey = r.o_orderkey AND o.k = r.k + 1))))
SELECT r.o_orderkey, k::INT AS place, q0, q1, {S.r6('p')} AS p, adds, margin, {S.r6('abs(q1) * p / nav')} AS share, {S.r6('abs(q0) * p / nav')} AS share0, {S.r6('abs(q1 - q0) * p')} AS notional FROM r WHERE k > 0""")
def order_walk(spark, d):
    """A decision's orders one after another: the position before and after each, its price,
    whether it adds, and whether margin refuses it, which leaves the book to the next as it was."""
    o = apply(V.table(spark, d, "lineitem"), _WALK)
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_extendedprice", "l_quantity"))
    asked = o.select(F.col("l_orderkey").alias("account"), place.alias("place"), F.col("sym").cast("long").alias("symbol"), "buy", F.col("qty").cast("long").alias("quantity"), F.col("lim").alias("limit"), F.col("stp").alias("stop"), "quote")
    book = F.filter(F.array(*[F.struct(F.lit(s).cast("long").alias("symbol"), F.expr(_POS.format(s)).cast("long").alias("quantity"), F.expr(_MARK.format(s)).cast("double").alias("mark")) for s in range(3)]), lambda h: h["quantity"] != 0)
    a = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("account"), (1000 + F.col("o_totalprice") / 100).alias("cash"), book.alias("book"))
    a = a.withColumn("value", F.aggregate("book", F.col("cash"), lambda s, h: s + h["quantity"] * h["mark"]))
    got = walk(asked, a)
    return got.select(F.col("account").alias("o_orderkey"), "place", "q0", "q1", r6(F.col("p")).alias("p"), "adds", "margin", *[r6(F.col(c)).alias(c) for c in ("share", "share0", "notional")])


# --- fields given as text ------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \t\n\r]*[0-9][^ \t\n\r]*')) AS raw FROM documents), s AS (SELECT doc_id, rtrim(raw, '.,;:!?)') AS x FROM t),
k AS (SELECT doc_id, x, regexp_full_match(x, '[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?') AS money, regexp_full_match(x, '[1-9][0-9]*') AS whole, regexp_full_match(x, '[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3])(:[0-5][0-9]){0,1}(:[0-5][0-9]([.,][0-9]{1,6})?)?(Z|[-+]([01][0-9]|2[0-3]):?[0-5][0-9])') AND try_cast(left(x, 10) AS DATE) IS NOT NULL AS time FROM s)
SELECT doc_id, count(*)::BIGINT AS n, count(*) FILTER (money)::BIGINT AS n_money, count(*) FILTER (whole)::BIGINT AS n_whole, count(*) FILTER (time)::BIGINT AS n_time, sum(CASE WHEN whole AND length(x) <= 9 THEN x::BIGINT END)::BIGINT AS total FROM k GROUP BY doc_id""")
def rules_validation(spark, d):
    """The figures in a text, checked as fields: amounts, positive whole numbers, timestamps
    with a zone; and the sum of the whole numbers of up to nine digits."""
    t = V.table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r]*[0-9][^ \t\n\r]*"), F.lit(0))).alias("raw"))
    x = F.rtrim(F.col("raw"), F.lit(".,;:!?)"))
    k = t.select("doc_id", x.alias("x"))
    x = F.col("x")
    n = lambda c: F.count(F.when(c, 1))
    whole = R.is_positive_whole(x)
    return k.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), n(R.is_money(x)).alias("n_money"), n(whole).alias("n_whole"), n(R.is_zoned_time(x)).alias("n_time"), F.sum(F.when(whole & (F.length(x) <= 9), F.expr("try_cast(x as bigint)"))).alias("total"))


@query("""SELECT event_id, list_has_all(json_keys(props), ['k']) AS has_required, len(list_filter(json_keys(props), lambda c: c NOT IN ('k', 'note'))) > 0 AS has_others, regexp_full_match(json_extract_string(props, '$.k'), '[1-9][0-9]*') AS k_is_positive,
CASE WHEN NOT list_has_all(json_keys(props), ['k']) THEN 'missing field' WHEN len(list_filter(json_keys(props), lambda c: c NOT IN ('k', 'note'))) > 0 THEN 'unsupported field' WHEN NOT regexp_full_match(json_extract_string(props, '$.k'), '[1-9][0-9]*') THEN 'positive whole number required' END AS error FROM events""")
def props_fields(spark, d):
    """An object's fields against the required and the allowed ones, and its number checked."""
    e = V.table(spark, d, "events")
    keys = F.json_object_keys("props")
    has, others = F.array_contains(keys, "k"), F.size(F.array_except(keys, F.array(F.lit("k"), F.lit("note")))) > 0
    positive = R.is_positive_whole(F.get_json_object("props", "$.k"))
    error = F.when(~has, "missing field").when(others, "unsupported field").when(~positive, "positive whole number required")
    return e.select("event_id", has.alias("has_required"), others.alias("has_others"), positive.alias("k_is_positive"), error.alias("error"))


# --- bands and transforms ------------------------------------------------------------------

rules(
    "rules_bands",
    "Residuals and bands on level and ratio scale, clipped multipliers, and the transforms of a published figure against its earlier value.",
    "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"],
    {"p": "l_extendedprice / 1000", "y": "l_extendedprice / 1000 * (1 + l_discount - l_tax)", "ref": "l_quantity", "lo_q": "0.9 - l_tax", "hi_q": "1.1 + l_discount", "level": "l_linenumber % 2 = 0", "how": "CASE WHEN l_partkey % 4 = 0 THEN 'lin' WHEN l_partkey % 4 = 1 THEN 'chg' WHEN l_partkey % 4 = 2 THEN 'chg_k' ELSE 'pch' END"},
    {"resid": f"CASE WHEN level THEN y - p ELSE {div('y', 'p')} END", "lo": "CASE WHEN level THEN p + lo_q - 1 ELSE p * lo_q END", "hi": "CASE WHEN level THEN p + hi_q - 1 ELSE p * hi_q END", "mult": f"least(6e0, greatest(0.5, {div('y', 'ref')}))", "shown": f"CASE WHEN how = 'lin' THEN floor(y * 10 + 0.5) / 10 WHEN how = 'chg' THEN floor((y - ref) * 10 + 0.5) / 10 WHEN how = 'chg_k' THEN floor((y - ref) * 1000 + 0.5) ELSE floor(({div('y', 'ref')} - 1) * 1000 + 0.5) / 10 END"},
    {"inside": "y BETWEEN least(lo, hi) AND greatest(lo, hi)", "phrase": "CASE WHEN shown > 0 THEN 'rose' WHEN shown < 0 THEN 'fell' ELSE 'unchanged' END"},
    plain=("how", "inside", "phrase"), rounded=("resid", "lo", "hi", "mult", "shown"),
)

# --- texts and classes ---------------------------------------------------------------------

rules(
    "macro_texts",
    "A release as a headline: what it is, how it changed, what was expected where that was priced before the release, and its line for display; missing figures as na.",
    "events", ["event_id"],
    {"name": "CASE WHEN event_type = 'error' THEN 'CPI' WHEN event_type = 'signup' THEN 'Payrolls' ELSE 'Survey' END", "x": "floor((value - 80) * 10 + 0.5) / 10", "expected": "CASE WHEN event_id % 3 = 0 THEN NULL ELSE floor((value - 90) * 10 + 0.5) / 10 END", "priced": "event_id % 4 <> 0", "minute": "minute(ts)"},
    {"change": "CASE WHEN x > 0 THEN concat('rose ', x::VARCHAR(12)) WHEN x < 0 THEN concat('fell ', abs(x)::VARCHAR(12)) ELSE 'unchanged' END", "expectation": "CASE WHEN expected IS NOT NULL AND priced THEN concat(' vs ', expected::VARCHAR(12), ' expected') ELSE '' END", "shown": "coalesce(expected::VARCHAR(12), 'na')", "public": "CASE WHEN minute = 30 THEN 'timed' WHEN hour(ts) < 10 THEN 'ten' ELSE 'as dated' END"},
    {"headline": "concat(name, ' ', change, expectation)", "line": "concat(lpad(hour(ts)::VARCHAR(2), 2, '0'), ':', lpad(minute::VARCHAR(2), 2, '0'), ' ', name, ' | ', shown)"},
    {"surprise": "CASE WHEN expected IS NOT NULL AND priced THEN x - expected END"},
    plain=("headline", "line", "public"), rounded=("surprise",),
)

rules(
    "fund_classes",
    "A fund's group from its name, with exclusions; whether a row is flagged; the failure class of an error text; and the rule of the tape.",
    "part", ["p_partkey"],
    {"long_name": "CASE WHEN p_partkey % 8 = 0 THEN 'iShares 20+ Year Treasury Bond' WHEN p_partkey % 8 = 1 THEN 'High Yield Corporate Bond' WHEN p_partkey % 8 = 2 THEN 'Japanese Yen Trust' WHEN p_partkey % 8 = 3 THEN 'Bond Covered Call Strategy' WHEN p_partkey % 8 = 4 THEN 'Gold Shares' WHEN p_partkey % 8 = 5 THEN 'Senior Loan Fund' ELSE 'S&P 500 Trust' END", "stock_type": "CASE WHEN p_size % 5 = 0 THEN 'COMMON' ELSE 'ETF' END", "error": "CASE WHEN p_partkey % 6 = 0 THEN 'HTTP 503 from gateway' WHEN p_partkey % 6 = 1 THEN 'timed out after 90 s' WHEN p_partkey % 6 = 2 THEN 'quantity must be positive' WHEN p_partkey % 6 = 3 THEN 'unknown tool: foo' END", "note": "CASE WHEN p_partkey % 7 = 0 THEN 'warning: stale' WHEN p_partkey % 7 = 1 THEN 'tier D' ELSE '' END"},
    {"fund_group": "CASE WHEN stock_type <> 'ETF' THEN NULL WHEN rlike(long_name, '(?i)covered call|leveraged|inverse') THEN NULL WHEN rlike(long_name, '(?i)treasury') THEN 'rates' WHEN rlike(long_name, '(?i)high yield|corporate|loan') THEN 'credit' WHEN rlike(long_name, '(?i)yen|euro|dollar|sterling') THEN 'fx' WHEN rlike(long_name, '(?i)bond') THEN 'rates' END", "failure": "CASE WHEN error IS NULL THEN NULL WHEN rlike(error, '(?i)HTTP 5[0-9][0-9]|timed out|connection') THEN 'framework' ELSE 'model' END", "flagged": "rlike(note, 'warning|tier D')", "any_of": "(p_size > 40 OR p_retailprice > 1500)"},
    plain=("fund_group", "failure", "flagged", "any_of"),
)
