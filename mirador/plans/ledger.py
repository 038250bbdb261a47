"""The event-sourced ledger: fills to positions, cash, costs, risk and order matching."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import bar_fill, commission, order_code, r6, ratio, spread_bps
from ..operators import ledger as L
from ..operators import temporal as T
from ..sources import views as V
from . import sql as S
from .bars import weekly_returns
from .catalog import query

_LAST = ["time", "symbol", "side", "shares", "cents", "fee", "l_partkey", "l_discount"]


def latest_fills(spark, d):
    return T.latest_wins(V.fills(spark, d), ["l_orderkey", "l_linenumber"], [F.desc_nulls_last(c) for c in _LAST])


@query(f"WITH {S.FILLS} SELECT l_orderkey, l_linenumber, time, sleeve, symbol, side, shares, cents, fee FROM latest")
def latest_wins_dedupe(spark, d):
    """One record an execution: the last."""
    return latest_fills(spark, d).select("l_orderkey", "l_linenumber", "time", "sleeve", "symbol", "side", "shares", "cents", "fee")


@query(f"""WITH {S.FILLS} SELECT sleeve, symbol, sum(CASE WHEN side = 'BOT' THEN shares ELSE -shares END)::BIGINT AS qty,
sum(CASE WHEN side = 'BOT' THEN -cents ELSE cents END - coalesce(fee, 0))::BIGINT AS cash_cents, count(*) FILTER (fee IS NULL)::BIGINT AS missing_fees FROM latest WHERE time < TIMESTAMP '1999-01-01' GROUP BY ALL""")
def positions_at(spark, d):
    """Positions and cash from the fills before a date, in exact cents."""
    f = latest_fills(spark, d).filter("time < timestamp_ntz'1999-01-01'")
    sign = F.when(F.col("side") == "BOT", 1).otherwise(-1)
    return f.groupBy("sleeve", "symbol").agg(F.sum(sign * F.col("shares")).alias("qty"), F.sum(-sign * F.col("cents") - F.coalesce("fee", F.lit(0))).alias("cash_cents"), F.count(F.when(F.col("fee").isNull(), 1)).alias("missing_fees"))


@query(f"""WITH {S.FILLS}, a AS (SELECT symbol, sum(shares)::BIGINT AS bought FROM latest WHERE side = 'BOT' GROUP BY symbol), b AS (SELECT symbol, sum(shares)::BIGINT AS sold FROM latest WHERE side = 'SLD' AND symbol % 3 <> 0 GROUP BY symbol)
SELECT coalesce(a.symbol, b.symbol) AS symbol, bought, sold, CASE WHEN b.symbol IS NULL THEN 'only_bought' WHEN a.symbol IS NULL THEN 'only_sold' WHEN bought = sold THEN 'equal' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.symbol = b.symbol""")
def reconcile_full_outer(spark, d):
    """Two books side by side, missing rows told apart from differing ones."""
    f = latest_fills(spark, d)
    a = f.filter("side = 'BOT'").groupBy("symbol").agg(F.sum("shares").alias("bought"))
    b = f.filter("side = 'SLD' and symbol % 3 <> 0").groupBy("symbol").agg(F.sum("shares").alias("sold"))
    state = F.when(F.col("sold").isNull(), "only_bought").when(F.col("bought").isNull(), "only_sold").when(F.col("bought") == F.col("sold"), "equal").otherwise("differs")
    return a.join(b, "symbol", "full").select("symbol", "bought", "sold", state.alias("state"))


@query(f"""WITH {S.FILLS}, div AS (SELECT p_partkey % 100 + 1 AS symbol, DATE '1996-01-01' + (p_partkey % 1500)::INT AS ex_date, p_size AS cents_per_share FROM part WHERE p_partkey % 7 = 0 QUALIFY row_number() OVER (PARTITION BY symbol, ex_date ORDER BY p_partkey) = 1)
SELECT sleeve, f.symbol, ex_date, sum(CASE WHEN side = 'BOT' THEN shares ELSE -shares END)::BIGINT AS quantity, (sum(CASE WHEN side = 'BOT' THEN shares ELSE -shares END) * any_value(cents_per_share))::BIGINT AS amount_cents
FROM latest f JOIN div ON div.symbol = f.symbol AND f.time < ex_date GROUP BY sleeve, f.symbol, ex_date HAVING sum(CASE WHEN side = 'BOT' THEN shares ELSE -shares END) <> 0""")
def dividend_credit(spark, d):
    """Each dividend once: the quantity held the day before the ex-date times the amount. A
    running position and an as-of lookup, so no fill meets every dividend."""
    p = V.table(spark, d, "part").filter("p_partkey % 7 = 0").select((F.col("p_partkey") % 100 + 1).alias("symbol"), F.date_add(F.lit("1996-01-01").cast("date"), (F.col("p_partkey") % 1500).cast("int")).alias("ex_date"), F.col("p_size").alias("per"), "p_partkey")
    div = T.latest_wins(p, ["symbol", "ex_date"], [F.asc("p_partkey")]).withColumn("ts", F.col("ex_date").cast("timestamp_ntz"))
    f = latest_fills(spark, d)
    sign = F.when(F.col("side") == "BOT", F.col("shares")).otherwise(-F.col("shares"))
    moves = f.groupBy("sleeve", "symbol", F.col("time").alias("ts")).agg(F.sum(sign).alias("q"))
    sleeves = moves.select("sleeve", "symbol").distinct()
    asks = sleeves.join(div, "symbol").select("sleeve", "symbol", "ts", F.lit(0).cast("long").alias("q"), "ex_date", "per")
    both = asks.unionByName(moves, allowMissingColumns=True)
    w = W.partitionBy("sleeve", "symbol").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    at = both.withColumn("tie", F.sum(F.when(F.col("per").isNull(), F.col("q"))).over(W.partitionBy("sleeve", "symbol", "ts"))).withColumn("quantity", F.sum("q").over(w) - F.coalesce("tie", F.lit(0)))
    return at.filter("per is not null and quantity <> 0").select("sleeve", "symbol", "ex_date", "quantity", (F.col("quantity") * F.col("per")).alias("amount_cents"))


@query(f"""WITH RECURSIVE {S.FILLS}, n AS (SELECT sleeve, symbol, CASE WHEN side = 'BOT' THEN shares ELSE -shares END AS move, shares, cents / shares AS price, fee,
row_number() OVER (PARTITION BY sleeve, symbol ORDER BY time, l_orderkey, l_linenumber) AS k FROM latest),
b AS (SELECT sleeve, symbol, 0::BIGINT AS k, 0::BIGINT AS qty, 0::DOUBLE AS avg, 0::DOUBLE AS realized, 0::BIGINT AS fees, 0::BIGINT AS missing FROM n WHERE k = 1
UNION ALL SELECT n.sleeve, n.symbol, n.k, b.qty + n.move,
CASE WHEN b.qty + n.move = 0 THEN 0 WHEN b.qty = 0 OR (b.qty > 0) = (n.move > 0) THEN (b.avg * abs(b.qty) + n.price * n.shares) / (abs(b.qty) + n.shares) WHEN n.shares > abs(b.qty) THEN n.price ELSE b.avg END,
b.realized + CASE WHEN b.qty <> 0 AND (b.qty > 0) <> (n.move > 0) THEN least(abs(b.qty), n.shares) * (n.price - b.avg) * sign(b.qty) ELSE 0 END, b.fees + coalesce(n.fee, 0), b.missing + (n.fee IS NULL)::INT
FROM b JOIN n ON n.sleeve = b.sleeve AND n.symbol = b.symbol AND n.k = b.k + 1)
SELECT sleeve, symbol, qty, {S.r6('avg')} AS avg_cents, {S.r6('realized')} AS realized_cents, fees, {S.r6('realized - fees')} AS net_cents, missing AS missing_fees FROM b QUALIFY k = max(k) OVER (PARTITION BY sleeve, symbol)""")
def avg_cost_book(spark, d):
    """Average cost, flips through zero, realized profit before and after fees: an ordered fold a book."""
    b = L.average_cost(latest_fills(spark, d), ["sleeve", "symbol"])
    return b.select("sleeve", "symbol", "qty", r6(F.col("avg_cents")).alias("avg_cents"), r6(F.col("realized_cents")).alias("realized_cents"), "fees", r6(F.col("realized_cents") - F.col("fees")).alias("net_cents"), "missing_fees")


_NAV = f"""{S.FILLS}, day AS (SELECT sleeve, time::DATE AS session, sum(CASE WHEN side = 'BOT' THEN -cents ELSE cents END)::BIGINT AS flow FROM latest GROUP BY ALL),
nav AS (SELECT sleeve, session, 100000000000 + sum(flow) OVER (PARTITION BY sleeve ORDER BY session) AS nav FROM day)"""


@query(f"""WITH {_NAV}, t AS (SELECT *, max(nav) OVER (PARTITION BY sleeve ORDER BY session) AS top, lag(nav) OVER (PARTITION BY sleeve ORDER BY session) AS before FROM nav)
SELECT sleeve, session, nav::BIGINT AS nav, {S.r6('nav / nullif(before, 0) - 1')} AS daily, {S.r6('min(nav / nullif(top, 0) - 1) OVER (PARTITION BY sleeve ORDER BY session)')} AS max_drawdown FROM t""")
def nav_curve(spark, d):
    """Daily value of each sleeve, its daily change and largest drawdown so far."""
    f = latest_fills(spark, d)
    flow = F.sum(F.when(F.col("side") == "BOT", -F.col("cents")).otherwise(F.col("cents")))
    day = f.groupBy("sleeve", F.to_date("time").alias("session")).agg(flow.alias("flow"))
    w = W.partitionBy("sleeve").orderBy("session")
    nav = day.withColumn("nav", F.lit(100000000000) + F.sum("flow").over(w))
    nav = nav.withColumns({"down": ratio(F.col("nav"), F.max("nav").over(w)) - 1, "daily": ratio(F.col("nav"), F.lag("nav").over(w)) - 1})
    return nav.select("sleeve", "session", "nav", r6(F.col("daily")).alias("daily"), r6(F.min("down").over(w)).alias("max_drawdown"))


@query("""WITH p AS (SELECT c_custkey, c_nationkey, c_acctbal, sum(greatest(c_acctbal, 0)) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS run, sum(greatest(c_acctbal, 0)) OVER (PARTITION BY c_nationkey) AS total FROM customer)
SELECT c_custkey, c_nationkey, CASE WHEN run - greatest(c_acctbal, 0) < total * 0.25 THEN 'CUT' ELSE 'KEEP' END AS plan FROM p WHERE c_acctbal > 0 AND abs(run - greatest(c_acctbal, 0) - total * 0.25) > 1e-6""")
def margin_cut_plan(spark, d):
    """Largest positions first until a quarter of the exposure is cut."""
    c, x = V.table(spark, d, "customer"), F.greatest("c_acctbal", F.lit(0.0))
    w = W.partitionBy("c_nationkey")
    p = c.withColumns({"before": F.sum(x).over(w.orderBy(F.desc("c_acctbal"), "c_custkey").rowsBetween(W.unboundedPreceding, 0)) - x, "total": F.sum(x).over(w)})
    p = p.filter("c_acctbal > 0 and abs(before - total * 0.25) > 1e-6")
    return p.select("c_custkey", "c_nationkey", F.when(F.col("before") < F.col("total") * 0.25, "CUT").otherwise("KEEP").alias("plan"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, {S.r6('least(greatest(l_quantity * 0.005, 1.0), l_extendedprice * 0.01)')} AS fee, {S.r6('greatest(l_quantity * 0.005, 1.0)')} AS fee_no_cap,
{S.r6('CASE WHEN l_discount > 0 AND l_discount / (1 - l_discount / 2) * 1e4 <= 2000 THEN l_discount / (1 - l_discount / 2) * 1e4 END')} AS spread FROM lineitem""")
def commission_costs(spark, d):
    """Commission with and without the one-per-cent cap, and spreads in basis points."""
    li = V.table(spark, d, "lineitem")
    q, p = F.col("l_quantity"), ratio(F.col("l_extendedprice"), F.col("l_quantity"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    return li.select(*keys, r6(commission(q, p)).alias("fee"), r6(commission(q, p, cap=None)).alias("fee_no_cap"), r6(spread_bps(1 - F.col("l_discount"), F.lit(1.0))).alias("spread"))


_ORDER = """o AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'buy ' WHEN 1 THEN 'SELL' WHEN 2 THEN 'hold' ELSE 'Buy' END AS action, CASE WHEN o_orderkey % 7 = 0 THEN 1.5 WHEN o_orderkey % 11 = 0 THEN -1.0 ELSE (o_orderkey % 50)::DOUBLE + 1 END AS qty,
CASE o_orderkey % 4 WHEN 0 THEN 'lmt' WHEN 1 THEN 'MKT' WHEN 2 THEN 'STP LMT' ELSE 'ICE' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS lim, CASE WHEN o_orderkey % 13 = 0 THEN 'IOC' ELSE 'day' END AS tif FROM orders)"""


@query(f"""WITH {_ORDER} SELECT o_orderkey, CASE WHEN upper(trim(action)) NOT IN ('BUY', 'SELL') THEN 'BAD_ACTION' WHEN NOT (qty > 0 AND qty = floor(qty)) THEN 'BAD_QUANTITY'
WHEN upper(kind) NOT IN ('MKT', 'LMT', 'STP', 'STP LMT', 'TRAIL', 'MOC', 'MOO', 'LOC') THEN 'BAD_TYPE' WHEN upper(kind) IN ('LMT', 'STP LMT', 'LOC') AND NOT coalesce(lim > 0, FALSE) THEN 'NO_LIMIT'
WHEN upper(tif) NOT IN ('DAY', 'GTC') THEN 'BAD_TIF' ELSE 'OK' END AS code FROM o""")
def order_validate_codes(spark, d):
    """The first failed rule of each order."""
    k = F.col("o_orderkey")
    o = V.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 5 == 0, "buy ").when(k % 5 == 1, "SELL").when(k % 5 == 2, "hold").otherwise("Buy").alias("action"),
        F.when(k % 7 == 0, 1.5).when(k % 11 == 0, -1.0).otherwise((k % 50).cast("double") + 1).alias("qty"),
        F.when(k % 4 == 0, "lmt").when(k % 4 == 1, "MKT").when(k % 4 == 2, "STP LMT").otherwise("ICE").alias("kind"),
        F.when(k % 3 != 0, F.col("o_totalprice")).alias("lim"),
        F.when(k % 13 == 0, "IOC").otherwise("day").alias("tif"),
    )
    return o.select("o_orderkey", order_code(F.col("action"), F.col("qty"), F.col("kind"), F.col("lim"), F.col("tif")).alias("code"))


_KINDS = ("MKT", "MOO", "MOC", "LOC", "LMT", "STP", "STP LMT")
_FILL_SQL = """CASE WHEN kind IN ('MKT', 'MOO') THEN o WHEN kind = 'MOC' THEN c WHEN kind = 'LOC' THEN CASE WHEN (buy AND c <= lim) OR (NOT buy AND c >= lim) THEN c END
WHEN kind = 'LMT' THEN CASE WHEN buy THEN CASE WHEN o <= lim THEN o WHEN l <= lim THEN lim END ELSE CASE WHEN o >= lim THEN o WHEN h >= lim THEN lim END END
WHEN kind = 'STP' THEN hit WHEN kind = 'STP LMT' AND hit IS NOT NULL THEN CASE WHEN buy THEN CASE WHEN hit <= lim THEN hit WHEN l <= lim THEN lim END ELSE CASE WHEN hit >= lim THEN hit WHEN h >= lim THEN lim END END END"""


@query(f"""WITH {S.BARS}, a AS (SELECT symbol, session, o, h, l, c, (symbol + v) % 2 = 0 AS buy, ['MKT', 'MOO', 'MOC', 'LOC', 'LMT', 'STP', 'STP LMT'][((symbol + day(session)) % 7 + 1)::INT] AS kind,
lag(c) OVER (PARTITION BY symbol ORDER BY session) AS p FROM bars), b AS (SELECT *, p * CASE WHEN buy THEN 0.98 ELSE 1.02 END AS lim, p * CASE WHEN buy THEN 1.02 ELSE 0.98 END AS stop FROM a WHERE p IS NOT NULL),
f AS (SELECT *, CASE WHEN buy THEN CASE WHEN o >= stop THEN o WHEN h >= stop THEN stop END ELSE CASE WHEN o <= stop THEN o WHEN l <= stop THEN stop END END AS hit FROM b)
SELECT symbol, session, kind, buy, {S.r6(_FILL_SQL)} AS fill FROM f""")
def single_bar_fill(spark, d):
    """Where each type of order fills within the day's bar."""
    b = V.bars_daily(spark, d)
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    b = b.withColumns({"buy": (F.col("symbol") + F.col("v")) % 2 == 0, "kind": F.element_at(kinds, ((F.col("symbol") + F.dayofmonth("session")) % 7 + 1).cast("int")), "p": F.lag("c").over(W.partitionBy("symbol").orderBy("session"))}).filter("p is not null")
    b = b.withColumns({"lim": F.col("p") * F.when(F.col("buy"), 0.98).otherwise(1.02), "stop": F.col("p") * F.when(F.col("buy"), 1.02).otherwise(0.98)})
    fill = bar_fill(F.col("kind"), F.col("buy"), F.col("lim"), F.col("stop"), F.col("o"), F.col("h"), F.col("l"), F.col("c"))
    return b.select("symbol", "session", "kind", "buy", r6(fill).alias("fill"))


@query(f"""WITH {S.BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS k FROM bars),
s AS (SELECT *, 0.8 * max(CASE WHEN k = 1 THEN c ELSE h END) OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop FROM n),
f AS (SELECT *, CASE WHEN o <= stop THEN o WHEN l <= stop THEN stop END AS fill FROM s)
SELECT symbol, count(*)::BIGINT AS bars, min(session) FILTER (fill IS NOT NULL) AS session, {S.r6('arg_min(fill, k) FILTER (fill IS NOT NULL)')} AS price FROM f GROUP BY symbol""")
def market_episode(spark, d):
    """Trailing-stop episodes: one order a symbol, carried over its bars until it fills."""
    return L.trailing_fills(V.bars_daily(spark, d), 20.0).select("symbol", "bars", "session", r6(F.col("price")).alias("price"))


@query(f"""WITH {S.RET}, m AS (SELECT ix, avg(r) AS m FROM ret GROUP BY ix), w AS (SELECT symbol, (symbol % 5 - 2)::DOUBLE AS w FROM (SELECT DISTINCT symbol FROM ret))
SELECT ix, {S.r6('sum(w * r)')} AS pnl, {S.r6('sum(w) * any_value(m)')} AS hedge, {S.r6('sum(w * r) - sum(w) * any_value(m)')} AS hedged, {S.r6('sum(abs(w))')} AS gross, {S.r6('sum(w)')} AS net
FROM ret JOIN w USING (symbol) JOIN m USING (ix) WHERE r IS NOT NULL GROUP BY ix""")
def hedge_pnl(spark, d):
    """Profit of fixed weights, the part a market hedge takes out, gross and net exposure."""
    p = weekly_returns(spark, d)
    p = p.join(p.groupBy("ix").agg(F.avg("r").alias("m")), "ix").filter("r is not null").withColumn("w", (F.col("symbol") % 5 - 2).cast("double"))
    pnl, hedge = F.sum(F.col("w") * F.col("r")), F.sum("w") * F.first("m")
    return p.groupBy("ix").agg(r6(pnl).alias("pnl"), r6(hedge).alias("hedge"), r6(pnl - hedge).alias("hedged"), r6(F.sum(F.abs("w"))).alias("gross"), r6(F.sum("w")).alias("net"))


@query(f"""WITH {S.RET}, e AS (SELECT symbol, ix, r - avg(r) OVER (PARTITION BY ix) AS e FROM ret WHERE r IS NOT NULL AND ix >= (SELECT max(ix) - 60 FROM ret))
SELECT a.symbol AS a, b.symbol AS b, count(*)::BIGINT AS n, {S.r6('covar_samp(a.e, b.e) * 1e4')} AS cov FROM e a JOIN e b ON a.ix = b.ix AND a.symbol <= b.symbol GROUP BY ALL HAVING count(*) >= 20""")
def resid_cov_pairs(spark, d):
    """Covariances of residual returns over the last 60 sessions (pairs of a small universe, by session)."""
    return _cov(spark, d).select("a", "b", "n", r6(F.col("cov") * 1e4).alias("cov"))


def _cov(spark, d):
    p = weekly_returns(spark, d)
    last = F.broadcast(p.agg((F.max("ix") - 60).alias("since")))
    e = p.join(last).filter("ix >= since and r is not null").select("symbol", "ix", (F.col("r") - F.avg("r").over(W.partitionBy("ix"))).alias("e"))
    x, y = e.select(F.col("symbol").alias("a"), "ix", F.col("e").alias("ea")), e.select(F.col("symbol").alias("b"), "ix", F.col("e").alias("eb"))
    return x.join(y, "ix").filter("a <= b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("ea", "eb").alias("cov")).filter("n >= 20")


@query(f"""WITH {S.RET}, e AS (SELECT symbol, ix, r - avg(r) OVER (PARTITION BY ix) AS e FROM ret WHERE r IS NOT NULL AND ix >= (SELECT max(ix) - 60 FROM ret)),
v AS (SELECT a.symbol AS a, b.symbol AS b, covar_samp(a.e, b.e) AS cov FROM e a JOIN e b ON a.ix = b.ix AND a.symbol <= b.symbol GROUP BY ALL HAVING count(*) >= 20)
SELECT {S.r6('sum((a % 5 - 2) * (b % 5 - 2) * cov * CASE WHEN a = b THEN 1 ELSE 2 END) * 1e4')} AS variance, {S.r6('sum(CASE WHEN a = b THEN (a % 5 - 2) * (a % 5 - 2) * cov END) * 1e4')} AS idio FROM v""")
def portfolio_variance(spark, d):
    wa, wb = F.col("a") % 5 - 2, F.col("b") % 5 - 2
    same = F.col("a") == F.col("b")
    return _cov(spark, d).agg(r6(F.sum(wa * wb * F.col("cov") * F.when(same, 1).otherwise(2)) * 1e4).alias("variance"), r6(F.sum(F.when(same, wa * wa * F.col("cov"))) * 1e4).alias("idio"))
