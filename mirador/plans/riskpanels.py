"""The full risk and anomaly panels over weekly bars of nations; their SQL is written apart."""

import math

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import r6, ratio
from ..operators import rolling as R
from ..operators import xsection as X
from ..sources import views as V
from ..sources.staging import staged
from . import sql as S
from .catalog import query

#: The symbol that stands for the market.
INDEX = 0
WINDOWS = (1, 5, 22, 60)
#: First and last session back of the stretch a quarter or half a year before a target.
ECHOES = {"echo63_20": (41, 64), "echo126_20": (104, 127), "echo63_1": (60, 64), "echo126_1": (123, 127), "echo63_5": (56, 64), "echo126_5": (119, 127)}

_BARS = """wticks AS (SELECT s_nationkey AS symbol, date_trunc('week', l_shipdate)::DATE AS session, l_extendedprice / l_quantity AS p, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS tie, l_tax FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
wbars AS (SELECT symbol, session, arg_min(p, tie) AS o, max(p) AS h, min(p) AS l, arg_max(p, tie) AS c, count(*) AS v, sum(floor(l_tax * 100 + 0.5)::BIGINT) / count(*) / 100 AS tax FROM wticks GROUP BY ALL),
wcal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS ix FROM (SELECT DISTINCT session FROM wbars)), g AS (SELECT s.symbol, k.session, k.ix, o, h, l, c, v, tax FROM wcal k CROSS JOIN (SELECT DISTINCT symbol FROM wbars) s LEFT JOIN wbars b ON b.symbol = s.symbol AND b.session = k.session)"""


def weekly_bars(spark, d):
    """Open, high, low, close, count and mean tax of a nation's week, on the common calendar."""
    li = V.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("p"), "l_tax")
    sup = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("symbol"))
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "p")
    week = F.to_date(F.date_trunc("week", "l_shipdate")).alias("session")
    bars = li.join(sup, "l_suppkey").groupBy("symbol", week).agg(F.min_by("p", at).alias("o"), F.max("p").alias("h"), F.min("p").alias("l"), F.max_by("p", at).alias("c"), F.count(F.lit(1)).alias("v"), (F.sum(F.floor(F.col("l_tax") * 100 + 0.5)) / F.count(F.lit(1)) / 100).alias("tax"))
    return V.aligned(staged(bars, "bars"))


def _ln(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def _half_full(value: Column, n: int, end: int = 0) -> Column:
    """Mean of n sessions that exist, half of them with a value."""
    w = R.frame(n, end)
    return value if n == 1 else F.when((F.count(F.lit(1)).over(w) == n) & (F.count(value).over(w) >= n // 2), F.avg(value).over(w))


def _full(agg: Column, n: int, end: int = 0) -> Column:
    w = R.frame(n, end)
    return F.when(F.count(F.lit(1)).over(w) == n, agg.over(w))


def risk(spark, d):
    c = F.col
    g = weekly_bars(spark, d)
    before = F.lag("c").over(R.by())
    g = g.withColumns({"lr": _ln(c("c"), before), "hl": _ln(c("h"), c("l")), "co": _ln(c("c"), c("o"))})
    daily = {"cc": c("lr") * c("lr"), "pk": c("hl") * c("hl") / (4 * math.log(2)), "gk": 0.5 * c("hl") * c("hl") - (2 * math.log(2) - 1) * c("co") * c("co"), "rs": _ln(c("h"), c("c")) * _ln(c("h"), c("o")) + _ln(c("l"), c("c")) * _ln(c("l"), c("o")), "ov": _ln(c("o"), before) * _ln(c("o"), before)}
    g = g.withColumns(daily).withColumn("absr", F.abs("lr"))
    log_vol = lambda v: F.ln(F.greatest(F.sqrt(F.greatest(v, F.lit(0.0)) * 252), F.lit(0.01)))
    g = g.withColumns({f"v_{b}{n}": _half_full(c(b), n) for b in daily for n in WINDOWS})
    g = g.withColumns({f"l{b}{n}": F.when(c(f"v_{b}{n}").isNotNull(), log_vol(c(f"v_{b}{n}"))) for b in daily for n in WINDOWS})
    day = W.partitionBy("session")
    of_index = lambda n: F.max(F.when(c("symbol") == INDEX, c(n))).over(day)
    g = g.withColumns({f"mkt_{n}": of_index(n) for n in ("lcc5", "lcc22", "lgk5", "lgk22")} | {"mr": of_index("lr"), "xs_lgk5": F.percentile(F.when(c("symbol") != INDEX, c("lgk5")), 0.5).over(day)})
    g = g.withColumn("sig20", _full(F.stddev_samp("lr"), 20))
    back = lambda a, b: W.partitionBy("symbol").orderBy("ix").rowsBetween(-b, -a)
    echo = {n: ratio(F.max("absr").over(back(a, b)), c("sig20")) for n, (a, b) in ECHOES.items()}
    pair = F.when(c("lr").isNotNull(), c("mr"))
    ahead = lambda n: W.partitionBy("symbol").orderBy("ix").rowsBetween(1, n)
    drop = F.when(F.count("l").over(ahead(5)) == 5, F.min("l").over(ahead(5))) / c("c") - 1
    more = {
        "beta": ratio(_full(F.covar_pop("lr", "mr"), 60), _full(F.var_pop(pair), 60)), "ldvol": F.ln(_full(F.avg(c("c") * c("v")), 20)), "vr5_60": c("lcc5") - c("lcc60"), "ret5": _ln(c("c"), R.lag("c", 5)), "ret20": _ln(c("c"), R.lag("c", 20)), "off_hi60": c("c") / _full(F.max("h"), 60) - 1,
        "y_vol20": F.when(F.count(F.lit(1)).over(ahead(20)) == 20, F.stddev_samp("lr").over(ahead(20)) * math.sqrt(252)), "y_absr1": F.lead("absr").over(R.by()), "y_range1": F.lead(c("h") - c("l")).over(R.by()) / c("c"), "y_tail5": F.when(drop.isNotNull() & c("sig20").isNotNull(), (drop < -2 * c("sig20")).cast("int")),
        "n_absr1": math.sqrt(2 / math.pi) * c("sig20"), "n_range1": _half_full((c("h") - c("l")) / c("c"), 20),
    }
    return g.withColumns(echo | more)


_BLOCKS = {"cc": "lr * lr", "pk": "hl * hl / (4 * ln(2))", "gk": "hl * hl / 2 - (2 * ln(2) - 1) * co * co", "rs": "ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o)", "ov": "power(ln(o / prev), 2)"}
_LOGS = [f"l{b}{n}" for b in _BLOCKS for n in WINDOWS]
_RISK = [*_LOGS, "mkt_lcc5", "mkt_lcc22", "mkt_lgk5", "mkt_lgk22", "xs_lgk5", *ECHOES, "beta", "ldvol", "vr5_60", "ret5", "ret20", "off_hi60", "y_vol20", "y_absr1", "y_range1", "n_absr1", "n_range1"]


def _log_vol(b: str, n: int) -> str:
    least = f"count(*) OVER w{n} = {n} AND count({b}) OVER w{n} >= {n // 2}" if n > 1 else f"{b} IS NOT NULL"
    return f"CASE WHEN {least} THEN 0.5 * ln(greatest(252 * {f'avg({b}) OVER w{n}' if n > 1 else b}, 1e-4)) END"


def _back(n: int, end: int = 0) -> str:
    return f"(PARTITION BY symbol ORDER BY ix ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"


@query(f"""WITH {_BARS}, p AS (SELECT *, lag(c) OVER (PARTITION BY symbol ORDER BY ix) AS prev, lag(c, 5) OVER (PARTITION BY symbol ORDER BY ix) AS c5, lag(c, 20) OVER (PARTITION BY symbol ORDER BY ix) AS c20 FROM g),
q AS (SELECT *, ln(c / prev) AS lr, ln(h / l) AS hl, ln(c / o) AS co FROM p), e AS (SELECT *, abs(lr) AS absr, {', '.join(f'{x} AS {b}' for b, x in _BLOCKS.items())} FROM q),
v AS (SELECT *, {', '.join(f'{_log_vol(b, n)} AS l{b}{n}' for b in _BLOCKS for n in WINDOWS)}, CASE WHEN count(*) OVER w20 = 20 THEN stddev_samp(lr) OVER w20 END AS sig20, CASE WHEN count(*) OVER w20 = 20 THEN ln(avg(c * v) OVER w20) END AS ldvol, CASE WHEN count(*) OVER w60 = 60 THEN c / max(h) OVER w60 - 1 END AS off_hi60,
CASE WHEN count(*) OVER w20 = 20 AND count((h - l) / c) OVER w20 >= 10 THEN avg((h - l) / c) OVER w20 END AS n_range1, CASE WHEN count(*) OVER n20 = 20 THEN sqrt(252) * stddev_samp(lr) OVER n20 END AS y_vol20, lead(absr) OVER o AS y_absr1, lead(h - l) OVER o / c AS y_range1, CASE WHEN count(l) OVER n5 = 5 THEN min(l) OVER n5 / c - 1 END AS fall,
{', '.join(f'max(absr) OVER (PARTITION BY symbol ORDER BY ix ROWS BETWEEN {b} PRECEDING AND {a} PRECEDING) AS m_{n}' for n, (a, b) in ECHOES.items())} FROM e
WINDOW o AS (PARTITION BY symbol ORDER BY ix), w5 AS {_back(5)}, w20 AS {_back(20)}, w22 AS {_back(22)}, w60 AS {_back(60)}, n5 AS (PARTITION BY symbol ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), n20 AS (PARTITION BY symbol ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
m AS (SELECT ix, max(lr) AS mr, max(lcc5) AS mkt_lcc5, max(lcc22) AS mkt_lcc22, max(lgk5) AS mkt_lgk5, max(lgk22) AS mkt_lgk22 FROM v WHERE symbol = {INDEX} GROUP BY ix), x AS (SELECT ix, quantile_cont(lgk5, 0.5) AS xs_lgk5 FROM v WHERE symbol <> {INDEX} GROUP BY ix),
b AS (SELECT v.*, m.* EXCLUDE (ix), x.xs_lgk5, CASE WHEN count(*) OVER w = 60 THEN covar_pop(lr, mr) OVER w / nullif(var_pop(CASE WHEN lr IS NOT NULL THEN mr END) OVER w, 0) END AS beta FROM v LEFT JOIN m ON m.ix = v.ix LEFT JOIN x ON x.ix = v.ix WINDOW w AS (PARTITION BY symbol ORDER BY v.ix ROWS 59 PRECEDING))
SELECT symbol, ix, {', '.join(f'{S.r6({"vr5_60": "lcc5 - lcc60", "ret5": "ln(c / c5)", "ret20": "ln(c / c20)", "n_absr1": "sqrt(2 / pi()) * sig20"}.get(n, f"m_{n} / nullif(sig20, 0)" if n in ECHOES else n))} AS {n}' for n in _RISK)}, CASE WHEN fall IS NOT NULL AND sig20 IS NOT NULL THEN (fall < -2 * sig20)::INT END AS y_tail5 FROM b""")
def features_risk(spark, d):
    """Log volatilities of five estimators over 1, 5, 22 and 60 sessions, the market's and the
    median name's, the moves a quarter and half a year before the target, beta, volume, trend;
    the targets ahead and the plain forecasts of them."""
    return risk(spark, d).select("symbol", "ix", *[r6(F.col(n)).alias(n) for n in _RISK], "y_tail5")


_ANOMALY = ["ret_z", "vol_ratio", "gap_z", "range_ratio", "ret5_z", "dist20_z", "clv", "log_price", "log_dvol"]


def _least(agg: str, x: str, w: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {w} >= {n} THEN {agg.format(x)} OVER {w} END"


@query(f"""WITH {_BARS}, p AS (SELECT *, lag(c) OVER w AS prev, lag(c, 5) OVER w AS c5 FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ix)), q AS (SELECT *, ln(c / prev) AS lr, CASE WHEN v > 0 THEN v * 1e0 END AS vv, nullif((h - l) / prev, 0) AS width FROM p),
s AS (SELECT *, {_least('stddev_samp({})', 'lr', 'b60', 40)} AS s0, {_least('quantile_cont({}, 0.5)', 'vv', 'b60', 40)} AS vmed, {_least('quantile_cont({}, 0.5)', 'width', 'b60', 40)} AS wmed, {_least('avg({})', 'c', 'w20', 20)} AS m20, {_least('quantile_cont({}, 0.5)', 'c * vv', 'w20', 10)} AS dv, coalesce(sign(lr), 0) AS sg FROM q WINDOW b60 AS {_back(60, 1)}, w20 AS {_back(20)}),
z AS (SELECT *, CASE WHEN s0 > 1e-4 THEN s0 END AS sd, sum(CASE WHEN sg <> 0 AND sg = was THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ix) AS run FROM (SELECT *, lag(sg) OVER (PARTITION BY symbol ORDER BY ix) AS was FROM s)),
f AS (SELECT symbol, ix, lr / sd AS ret_z, ln(vv / vmed) AS vol_ratio, ln(o / prev) / sd AS gap_z, ln(width / nullif(wmed, 0)) AS range_ratio, ln(c / c5) / (sd * sqrt(5)) AS ret5_z, ln(c / m20) / sd AS dist20_z, CASE WHEN c IS NULL THEN NULL WHEN h > l THEN (c - l) / (h - l) - 0.5 ELSE 0 END AS clv, ln(c) AS log_price, ln(dv) AS log_dvol,
CASE WHEN lr IS NOT NULL THEN greatest(-10, least(10, sg * row_number() OVER (PARTITION BY symbol, run ORDER BY ix))) END::INT AS streak FROM z)
SELECT symbol, ix, streak, {', '.join(f'{S.r6(n)} AS {n}' for n in _ANOMALY)} FROM f""")
def features_anomaly(spark, d):
    """A session against its own past: return, volume, gap, range, five sessions' return and
    the distance from the mean in robust or past deviations; the run of one sign, the close's
    place in the range, price and money turned over."""
    c = F.col
    g = weekly_bars(spark, d)
    before = F.lag("c").over(R.by())
    g = g.withColumns({"lr": _ln(c("c"), before), "prev": before, "c5": R.lag("c", 5), "vv": F.when(c("v") > 0, c("v").cast("double"))})
    g = g.withColumn("width", F.when(c("h") > c("l"), ratio(c("h") - c("l"), c("prev"))))
    past, month = R.frame(60, -1), R.frame(20)
    least = lambda agg, x, w, n: F.when(F.count(x).over(w) >= n, agg(x).over(w))
    mid = lambda x: F.percentile(x, 0.5)
    g = g.withColumns({"s0": least(F.stddev_samp, c("lr"), past, 40), "vmed": least(mid, c("vv"), past, 40), "wmed": least(mid, c("width"), past, 40), "m20": least(F.avg, c("c"), month, 20), "dv": least(mid, c("c") * c("vv"), month, 10), "sg": F.coalesce(F.signum("lr"), F.lit(0.0))})
    goes_on = (c("sg") != 0) & c("sg").eqNullSafe(F.lag("sg").over(R.by()))
    g = g.withColumns({"sd": F.when(c("s0") > 1e-4, c("s0")), "run": F.sum(F.when(goes_on, 0).otherwise(1)).over(R.by().rowsBetween(W.unboundedPreceding, 0))})
    at = F.row_number().over(W.partitionBy("symbol", "run").orderBy("ix"))
    out = {
        "ret_z": c("lr") / c("sd"), "vol_ratio": _ln(c("vv"), c("vmed")), "gap_z": _ln(c("o"), c("prev")) / c("sd"), "range_ratio": _ln(c("width"), c("wmed")), "ret5_z": _ln(c("c"), c("c5")) / (c("sd") * 5**0.5), "dist20_z": _ln(c("c"), c("m20")) / c("sd"),
        "clv": F.when(c("c").isNotNull(), F.when(c("h") > c("l"), (c("c") - c("l")) / (c("h") - c("l")) - 0.5).otherwise(0.0)), "log_price": F.ln("c"), "log_dvol": F.ln("dv"), "streak": F.when(c("lr").isNotNull(), F.greatest(F.lit(-10), F.least(F.lit(10), (c("sg") * at).cast("int")))),
    }
    return g.withColumns(out).select("symbol", "ix", "streak", *[r6(c(n)).alias(n) for n in _ANOMALY])


# --- trend and quality ----------------------------------------------------------------------

_RAW = ["mom12_1", "mom6_1", "mom3_1", "resid_mom", "ind_rel_mom", "ind_mom", "hi52", "consistency", "maxdd", "resid_vol", "size", "rev5", "rev21", "beta"]
_YEAR, _HELD, _SKIP = 252, 231, 21


def trend(spark, d):
    c = F.col
    g = weekly_bars(spark, d).join(F.broadcast(V.regions(spark, d)), "symbol")
    before = R.lag("c", 1)
    g = g.withColumn("lr", _ln(c("c"), before)).withColumn("mr", F.max(F.when(c("symbol") == INDEX, c("lr"))).over(W.partitionBy("session")))
    g = g.withColumns({"y": F.when(c("mr").isNotNull(), c("lr")), "x": F.when(c("lr").isNotNull(), c("mr"))})
    year = R.frame(_YEAR)
    g = g.withColumn("beta", F.when(F.count("y").over(year) >= 126, ratio(F.covar_pop("x", "y").over(year), F.var_pop("x").over(year))))

    def rest(n, end, least, total):
        """(sum, deviation) of returns less beta times the market's, in a stretch that exists."""
        w = R.frame(n, end)
        k = F.count("y").over(w)
        ok = (F.count(F.lit(1)).over(w) == n) & (k >= least) & (c("symbol") != INDEX)  # the index leaves no rest
        spread = F.var_pop("y").over(w) - 2 * c("beta") * F.covar_pop("x", "y").over(w) + c("beta") * c("beta") * F.var_pop("x").over(w)
        sd = F.sqrt(F.greatest(spread, F.lit(0.0)) * k / (k - 1))
        return F.when(ok, F.sum("y").over(w) - c("beta") * F.sum("x").over(w) if total else sd)

    move = lambda a, b: _ln(R.lag("c", b) if b else c("c"), R.lag("c", a))
    held, month = R.frame(_HELD, -_SKIP), R.frame(20)
    rose = F.when(c("lr").isNotNull(), (c("lr") > 0).cast("double"))
    fall = F.aggregate(F.collect_list("c").over(year), F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("low")), lambda a, v: F.struct(F.greatest(a["top"], v).alias("top"), F.least(a["low"], v / F.greatest(a["top"], v) - 1).alias("low")), lambda a: a["low"])
    g = g.withColumns({
        "mom12_1": move(_YEAR, _SKIP), "mom6_1": move(126, _SKIP), "mom3_1": move(63, _SKIP), "rev5": move(5, 0), "rev21": move(21, 0), "resid_mom": ratio(rest(_HELD, -_SKIP, 200, True), rest(_HELD, -_SKIP, 200, False)), "resid_vol": rest(60, 0, 40, False) * math.sqrt(252),
        "consistency": F.when((F.count(F.lit(1)).over(held) == _HELD) & (F.count("lr").over(held) >= 200), F.avg(rose).over(held)), "hi52": c("c") / _full(F.max("h"), _YEAR), "maxdd": F.when((F.count(F.lit(1)).over(year) == _YEAR) & (F.count("c").over(year) > 0), fall),
        "size": F.when((F.count(F.lit(1)).over(month) == 20) & (F.count(c("c") * c("v")).over(month) >= 10), F.ln(F.avg(c("c") * c("v")).over(month))),
    })
    stock = F.when(c("symbol") != INDEX, c("mom12_1"))
    group = W.partitionBy("session", "region")
    others = F.count(stock).over(group) - F.when(stock.isNotNull(), 1).otherwise(0)
    g = g.withColumn("ind_mom", F.when((c("symbol") != INDEX) & (others >= 2), (F.sum(stock).over(group) - F.coalesce(stock, F.lit(0.0))) / others))
    return g.withColumn("ind_rel_mom", c("mom12_1") - c("ind_mom"))


def placed(value: str) -> Column:
    """Rank from -0.5 to 0.5 among the names but the index, of 20 at least, ties by symbol; the
    index is put in its place among them: the middle of its left and right insertion."""
    day = W.partitionBy("session")
    own = F.when(F.col("symbol") != INDEX, F.col(value))
    n = F.count(own).over(day)
    key = F.struct(own.isNull(), F.col(value), F.col("symbol"))
    at = F.row_number().over(day.orderBy(key)) - 1
    index = F.max(F.when(F.col("symbol") == INDEX, F.col(value))).over(day)
    middle = (F.count(F.when(own < index, 1)).over(day) + F.count(F.when(own <= index, 1)).over(day)) / 2
    between = F.greatest(F.lit(0.0), F.least(n - 1, middle - 0.5)) / (n - 1) - 0.5
    return F.when((n >= 20) & F.col(value).isNotNull(), F.when(F.col("symbol") == INDEX, between).otherwise(at / (n - 1) - 0.5))


def _rank_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR n_{x} < 20 THEN NULL WHEN symbol = {INDEX} THEN greatest(0, least(n_{x} - 1, (lo_{x} + hi_{x}) / 2 - 0.5)) / (n_{x} - 1) - 0.5 ELSE at_{x} / (n_{x} - 1) - 0.5 END"


def _stretch(n: int, end: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ix ROWS BETWEEN {n - 1 + end} PRECEDING AND {f'{end} PRECEDING' if end else 'CURRENT ROW'})"


def _resid(w: str) -> str:
    return f"sqrt(greatest(0, var_pop(y) OVER {w} + beta * beta * var_pop(x) OVER {w} - 2 * beta * covar_pop(y, x) OVER {w}) * count(y) OVER {w} / (count(y) OVER {w} - 1))"


@query(f"""WITH {_BARS}, p AS (SELECT g.*, n_regionkey AS region, ln(c / lag(c) OVER o) AS lr, {', '.join(f'lag(c, {k}) OVER o AS c{k}' for k in (5, 21, 63, 126, 252))} FROM g JOIN nation ON n_nationkey = symbol WINDOW o AS (PARTITION BY symbol ORDER BY ix)),
m AS (SELECT ix, lr AS mr FROM p WHERE symbol = {INDEX}), q AS (SELECT p.*, CASE WHEN mr IS NOT NULL THEN lr END AS y, CASE WHEN lr IS NOT NULL THEN mr END AS x FROM p LEFT JOIN m ON m.ix = p.ix),
b AS (SELECT *, CASE WHEN count(y) OVER w >= 126 THEN covar_pop(y, x) OVER w / nullif(var_pop(x) OVER w, 0) END AS beta FROM q WINDOW w AS {_stretch(252, 0)}),
f AS (SELECT *, ln(c21 / c252) AS mom12_1, ln(c21 / c126) AS mom6_1, ln(c21 / c63) AS mom3_1, ln(c / c5) AS rev5, ln(c / c21) AS rev21, CASE WHEN symbol <> {INDEX} AND count(*) OVER h = 231 AND count(y) OVER h >= 200 THEN (sum(y) OVER h - beta * sum(x) OVER h) / nullif({_resid('h')}, 0) END AS resid_mom, CASE WHEN symbol <> {INDEX} AND count(*) OVER s = 60 AND count(y) OVER s >= 40 THEN sqrt(252) * {_resid('s')} END AS resid_vol,
CASE WHEN count(*) OVER h = 231 AND count(lr) OVER h >= 200 THEN avg(CASE WHEN lr > 0 THEN 1e0 WHEN lr IS NOT NULL THEN 0e0 END) OVER h END AS consistency, CASE WHEN count(*) OVER w = 252 THEN c / max(h) OVER w END AS hi52, CASE WHEN count(*) OVER t = 20 AND count(c * v) OVER t >= 10 THEN ln(avg(c * v) OVER t) END AS size,
CASE WHEN count(*) OVER w = 252 AND count(c) OVER w > 0 THEN list_reduce(list_transform(list_filter(list(c) OVER w, lambda z: z IS NOT NULL), lambda z: {{'top': z, 'low': 0e0}}), lambda a, e: {{'top': greatest(a.top, e.top), 'low': least(a.low, e.top / greatest(a.top, e.top) - 1)}}).low END AS maxdd
FROM b WINDOW w AS {_stretch(252, 0)}, h AS {_stretch(231, 21)}, s AS {_stretch(60, 0)}, t AS {_stretch(20, 0)}),
i AS (SELECT f.*, CASE WHEN f.symbol <> {INDEX} THEN (SELECT avg(e.mom12_1) FROM f e WHERE e.ix = f.ix AND e.region = f.region AND e.symbol <> f.symbol AND e.symbol <> {INDEX} HAVING count(e.mom12_1) >= 2) END AS ind_mom FROM f), r AS (SELECT *, mom12_1 - ind_mom AS ind_rel_mom FROM i),
k AS (SELECT symbol, ix, {', '.join(_RAW)}, {', '.join(f"count({x}) FILTER (symbol <> {INDEX}) OVER d AS n_{x}, row_number() OVER (PARTITION BY ix ORDER BY symbol = {INDEX} OR {x} IS NULL, {x}, symbol) - 1 AS at_{x}, max({x}) FILTER (symbol = {INDEX}) OVER d AS v_{x}" for x in _RAW)} FROM r WINDOW d AS (PARTITION BY ix)),
l AS (SELECT *, {', '.join(f"sum(CASE WHEN symbol <> {INDEX} AND {x} < v_{x} THEN 1 ELSE 0 END) OVER d AS lo_{x}, sum(CASE WHEN symbol <> {INDEX} AND {x} <= v_{x} THEN 1 ELSE 0 END) OVER d AS hi_{x}" for x in _RAW)} FROM k WINDOW d AS (PARTITION BY ix))
SELECT symbol, ix, {', '.join(f'{S.r6(x)} AS {x}, {S.r6(_rank_sql(x))} AS {x}_rk' for x in _RAW)} FROM l""")
def features_rank(spark, d):
    """Fourteen features of trend and quality, most of them without the last month, and their
    ranks among the day's names: momentum plain, of residuals and against the industry; nearness
    to the year's high, steadiness, drawdown, size, reversals, beta."""
    t = staged(trend(spark, d).select("symbol", "session", "ix", *_RAW), "trend")
    return t.select("symbol", "ix", *[r6(F.col(x)).alias(x) for x in _RAW], *[r6(placed(x)).alias(f"{x}_rk") for x in _RAW])


# --- implied volatility: the last session's range stands for the implied series --------------

_IV = ["liv", "div1", "div5", "ivrv", "siv", "dsiv1", "dsiv5", "sivrv", "mkt_liv", "mkt_siv"]


@query(f"""WITH {_BARS}, p AS (SELECT *, ln(c / lag(c) OVER o) AS lr, sqrt(252 / (4 * ln(2))) * nullif(lag(ln(h / l)) OVER o, 0) AS iv FROM g WINDOW o AS (PARTITION BY symbol ORDER BY ix)),
v AS (SELECT *, CASE WHEN count(*) OVER w = 22 AND count(lr) OVER w >= 11 THEN 0.5 * ln(greatest(252 * avg(lr * lr) OVER w, 1e-4)) END AS rv FROM p WINDOW w AS {_back(22)}),
f AS (SELECT symbol, ix, ln(iv) AS liv, ln(iv / lag(iv) OVER o) AS div1, ln(iv / lag(iv, 5) OVER o) AS div5, ln(iv) - rv AS ivrv, iv / sqrt(252) AS siv, (iv - lag(iv) OVER o) / sqrt(252) AS dsiv1, (iv - lag(iv, 5) OVER o) / sqrt(252) AS dsiv5, (iv - exp(rv)) / sqrt(252) AS sivrv FROM v WINDOW o AS (PARTITION BY symbol ORDER BY ix))
SELECT f.symbol, f.ix, {', '.join(f"{S.r6(('m.' + n.removeprefix('mkt_')) if n.startswith('mkt_') else 'f.' + n)} AS {n}" for n in _IV)} FROM f LEFT JOIN f m ON m.ix = f.ix AND m.symbol = {INDEX}""")
def features_iv(spark, d):
    """Implied volatility as known the session before, in logs and as a daily level: its
    changes over one and five sessions, its gap to the month's realized one, and the market's."""
    c = F.col
    g = weekly_bars(spark, d)
    g = g.withColumns({"hl": _ln(c("h"), c("l")), "lr": _ln(c("c"), R.lag("c", 1))})
    known = F.lag("hl").over(R.by())
    g = g.withColumns({"iv": F.when(known > 0, known * math.sqrt(252 / (4 * math.log(2)))), "var": _half_full(c("lr") * c("lr"), 22)})
    g = g.withColumns({"liv": F.ln("iv"), "siv": c("iv") / math.sqrt(252), "rv": F.when(c("var").isNotNull(), F.ln(F.greatest(F.sqrt(c("var") * 252), F.lit(0.01))))})
    day = W.partitionBy("session")
    out = {f"d{n}{k}": c(m) - R.lag(m, k) for n, m in (("iv", "liv"), ("siv", "siv")) for k in (1, 5)}
    out |= {"ivrv": c("liv") - c("rv"), "sivrv": c("siv") - F.exp("rv") / math.sqrt(252)} | {f"mkt_{n}": F.max(F.when(c("symbol") == INDEX, c(n))).over(day) for n in ("liv", "siv")}
    return g.withColumns(out).select("symbol", "ix", *[r6(c(n)).alias(n) for n in _IV])


# --- cost of trading: a quote about the close, as wide as the week's mean tax ----------------

_COST = ["spread", "ls1", "ls5", "ls20", "lmid", "ldv", "lvol", "lpk", "lrv", "etf", "y"]


@query(f"""WITH {_BARS}, q AS (SELECT *, c * (1 - tax / 20) AS bid, c * (1 + tax / 20) AS ask, ln(c / lag(c) OVER (PARTITION BY symbol ORDER BY ix)) AS lr FROM g), s AS (SELECT *, (ask - bid) / ((ask + bid) / 2) * 10000 AS raw FROM q), z AS (SELECT *, CASE WHEN raw > 0 AND raw <= 2000 THEN raw END AS spread FROM s),
f AS (SELECT symbol, ix, spread, ln(spread) AS ls1, ln({_least('avg({})', 'spread', 'w5', 3)}) AS ls5, ln({_least('avg({})', 'spread', 'w20', 10)}) AS ls20, ln((bid + ask) / 2) AS lmid, ln({_least('avg({})', 'c * v', 'w20', 10)}) AS ldv, ln(nullif({_least('stddev_samp({})', 'lr', 'w20', 10)}, 0)) AS lvol,
ln(nullif({_least('avg({})', 'power(ln(h / l), 2)', 'w5', 3)}, 0) / (4 * ln(2))) / 2 AS lpk, ln(v / ({_least('avg({})', 'v', 'w20', 10)})) AS lrv, CASE WHEN symbol = {INDEX} THEN 1e0 ELSE 0e0 END AS etf, ln(lead(spread) OVER o) AS y FROM z WINDOW o AS (PARTITION BY symbol ORDER BY ix), w5 AS {_back(5)}, w20 AS {_back(20)})
SELECT symbol, ix, {', '.join(f'{S.r6(n)} AS {n}' for n in _COST)} FROM f""")
def features_cost(spark, d):
    """The quoted spread in basis points, its logs over 1, 5 and 20 sessions, and what else
    tells it: price, money turned over, volatility twice, volume against usual; and the next one."""
    from ..functions.scalars import spread_bps

    c = F.col
    g = weekly_bars(spark, d)
    bid, ask = c("c") * (1 - c("tax") / 20), c("c") * (1 + c("tax") / 20)
    g = g.withColumns({"spread": spread_bps(bid, ask), "mid": (bid + ask) / 2, "lr": _ln(c("c"), R.lag("c", 1)), "hl2": F.pow(_ln(c("h"), c("l")), F.lit(2.0))})
    least = lambda agg, x, n, k: F.when(F.count(x).over(R.frame(n)) >= k, agg(x).over(R.frame(n)))
    log = lambda x: F.when(x > 0, F.ln(x))
    out = {
        "ls1": log(c("spread")), "ls5": log(least(F.avg, c("spread"), 5, 3)), "ls20": log(least(F.avg, c("spread"), 20, 10)), "lmid": log(c("mid")), "ldv": log(least(F.avg, c("c") * c("v"), 20, 10)), "lvol": log(least(F.stddev_samp, c("lr"), 20, 10)),
        "lpk": 0.5 * log(least(F.avg, c("hl2"), 5, 3) / (4 * math.log(2))), "lrv": log(c("v") / least(F.avg, c("v"), 20, 10)), "etf": F.when(c("symbol") == INDEX, 1.0).otherwise(0.0), "y": log(F.lead("spread").over(R.by())),
    }
    return g.withColumns(out).select("symbol", "ix", *[r6(c(n)).alias(n) for n in _COST])


# --- industry, overnight: ranks among the names but the index, of eleven at least ------------


def _ranked(g, names, out):
    """``out`` columns: the ranks of ``names``, null for the index."""
    g = g.withColumns({f"_{n}": F.when(F.col("symbol") != INDEX, F.col(n)) for n in names})
    return g.withColumns({o: X.rank_pct(f"_{n}") for n, o in zip(names, out, strict=True)})


def _rank_of(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY ix) > 10 THEN (row_number() OVER (PARTITION BY ix ORDER BY {x} NULLS LAST, symbol) - 1) / (count({x}) OVER (PARTITION BY ix) - 1e0) - 0.5 END"


_MOVES = {"r1": (1, 0), "r5": (5, 0), "r20": (20, 0), "r21": (21, 0), "r63": (63, 0), "r126": (126, 0), "r12_1": (252, 21)}
_GROUP_RAW = {"ind_r21": "i_r21", "ind_r63": "i_r63", "ind_r126": "i_r126", "ind_r12_1": "i_r12_1", "rel_r1": "r1 - i_r1", "rel_r5": "r5 - i_r5", "rel_r20": "r20 - i_r20", "rel_vol20": "vol20 / nullif(i_vol20, 0)", "rel_offhi": "offhi - i_offhi", "rel_12_1": "r12_1 - i_r12_1"}
_GROUP_OUT = [f"{n}_rk" for n in _GROUP_RAW]
_LEFT_OUT = [*_MOVES, "vol20", "offhi"]


@query(f"""WITH {_BARS}, p AS (SELECT g.*, n_regionkey AS region, ln(c / lag(c) OVER o) AS lr, {', '.join(f"ln({f'lag(c, {b}) OVER o' if b else 'c'} / lag(c, {a}) OVER o) AS {n}" for n, (a, b) in _MOVES.items())} FROM g JOIN nation ON n_nationkey = symbol WINDOW o AS (PARTITION BY symbol ORDER BY ix)),
v AS (SELECT *, CASE WHEN count(*) OVER w20 = 20 THEN sqrt(252) * stddev_samp(lr) OVER w20 END AS vol20, CASE WHEN count(*) OVER w60 = 60 THEN c / max(h) OVER w60 - 1 END AS offhi FROM p WINDOW w20 AS {_back(20)}, w60 AS {_back(60)}), u AS (SELECT * FROM v WHERE symbol <> {INDEX}),
i AS (SELECT *, {', '.join(f"CASE WHEN count({n}) OVER k - ({n} IS NOT NULL)::INT >= 2 THEN (sum({n}) OVER k - coalesce({n}, 0)) / (count({n}) OVER k - ({n} IS NOT NULL)::INT) END AS i_{n}" for n in _LEFT_OUT)} FROM u WINDOW k AS (PARTITION BY ix, region)),
x AS (SELECT symbol, ix, region, {', '.join(f'{e} AS {n}' for n, e in _GROUP_RAW.items())} FROM i), r AS (SELECT symbol, ix, region, {', '.join(f'{_rank_of(n)} AS {n}_rk' for n in _GROUP_RAW)} FROM x)
SELECT symbol, ix, region, {', '.join(f'{S.r6(n)} AS {n}' for n in _GROUP_OUT)}, {S.r6('CASE WHEN ind_r12_1_rk IS NOT NULL THEN (coalesce(ind_r21_rk, 0) + coalesce(ind_r63_rk, 0) + coalesce(ind_r126_rk, 0) + ind_r12_1_rk) / (1 + (ind_r21_rk IS NOT NULL)::INT + (ind_r63_rk IS NOT NULL)::INT + (ind_r126_rk IS NOT NULL)::INT) END')} AS industry_momentum, {S.r6('-rel_r5_rk')} AS reversal, {S.r6('(rel_12_1_rk - rel_r5_rk - rel_vol20_rk) / 3')} AS neutral FROM r""")
def features_industry(spark, d):
    """Ranks of the industry's moves without the name itself (of two others at least) and of the
    name against them, in return, volatility and distance from the high; three blends of ranks."""
    c = F.col
    g = weekly_bars(spark, d).join(F.broadcast(V.regions(spark, d)), "symbol").withColumn("lr", _ln(c("c"), R.lag("c", 1)))
    g = g.withColumns({n: _ln(R.lag("c", b) if b else c("c"), R.lag("c", a)) for n, (a, b) in _MOVES.items()} | {"vol20": _full(F.stddev_samp("lr"), 20) * math.sqrt(252), "offhi": c("c") / _full(F.max("h"), 60) - 1})
    g = g.filter(c("symbol") != INDEX)
    group = W.partitionBy("session", "region")
    others = lambda n: F.count(n).over(group) - F.when(c(n).isNotNull(), 1).otherwise(0)
    g = g.withColumns({f"i_{n}": F.when(others(n) >= 2, (F.sum(n).over(group) - F.coalesce(c(n), F.lit(0.0))) / others(n)) for n in _LEFT_OUT})
    rel = {f"ind_{n}": c(f"i_{n}") for n in ("r21", "r63", "r126", "r12_1")} | {f"rel_{n}": c(n) - c(f"i_{n}") for n in ("r1", "r5", "r20", "offhi")} | {"rel_12_1": c("r12_1") - c("i_r12_1"), "rel_vol20": ratio(c("vol20"), c("i_vol20"))}
    g = _ranked(staged(g.withColumns(rel).select("symbol", "session", "ix", "region", *_GROUP_RAW), "industry"), list(_GROUP_RAW), _GROUP_OUT)
    parts = F.filter(F.array(*[c(f"ind_{n}_rk") for n in ("r21", "r63", "r126", "r12_1")]), lambda v: v.isNotNull())
    blend = F.when(c("ind_r12_1_rk").isNotNull(), F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / F.size(parts))
    return g.select("symbol", "ix", "region", *[r6(c(n)).alias(n) for n in _GROUP_OUT], r6(blend).alias("industry_momentum"), r6(-c("rel_r5_rk")).alias("reversal"), r6((c("rel_12_1_rk") - c("rel_r5_rk") - c("rel_vol20_rk")) / 3).alias("neutral"))


_NIGHT = {"on1": "night", "on5": "n5", "on20": "n20", "id1": "dayr", "id5": "d5", "id20": "d20", "vol20": "vol", "dvol": "dv"}
_OPEN = ["gap", *_NIGHT, "gapz"]
_NIGHT_OUT = [*[f"a_{n}_rk" for n in _OPEN], *[f"b_{n}_rk" for n in _NIGHT], "a_vol20", "b_vol20", "a_mkt_gap", "a_mkt_id1", "b_mkt_on1", "b_mkt_id1", "y_day", "y_night"]


def _whole(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {agg}({x}) OVER w{n} END"


@query(f"""WITH {_BARS}, p AS (SELECT *, ln(o / lag(c) OVER t) AS night, ln(c / o) AS dayr, ln(c / lag(c) OVER t) AS lr, c * v AS usd, lead(o) OVER t / c - 1 AS nxt FROM g WINDOW t AS (PARTITION BY symbol ORDER BY ix)),
s AS (SELECT *, {_whole('sum', 'night', 5)} AS n5, {_whole('sum', 'night', 20)} AS n20, {_whole('sum', 'dayr', 5)} AS d5, {_whole('sum', 'dayr', 20)} AS d20, sqrt(252) * {_whole('stddev_samp', 'lr', 20)} AS vol, ln({_whole('avg', 'usd', 20)}) AS dv FROM p WINDOW w5 AS {_back(5)}, w20 AS {_back(20)}),
l AS (SELECT *, {', '.join(f'lag({e}) OVER t AS p_{n}' for n, e in _NIGHT.items())} FROM s WINDOW t AS (PARTITION BY symbol ORDER BY ix)), m AS (SELECT ix, night AS m_gap, p_id1 AS m_pid, dayr AS m_id FROM l WHERE symbol = {INDEX}),
x AS (SELECT l.*, m.* EXCLUDE (ix), {', '.join(f'CASE WHEN symbol <> {INDEX} THEN {e} END AS b_{n}' for n, e in _NIGHT.items())}, {', '.join(f'CASE WHEN symbol <> {INDEX} THEN p_{n} END AS a_{n}' for n in _NIGHT)}, CASE WHEN symbol <> {INDEX} THEN night END AS a_gap, CASE WHEN symbol <> {INDEX} THEN night * sqrt(252) / nullif(p_vol20, 0) END AS a_gapz FROM l LEFT JOIN m ON m.ix = l.ix),
r AS (SELECT symbol, ix, {', '.join(f'{_rank_of(f"a_{n}")} AS a_{n}_rk' for n in _OPEN)}, {', '.join(f'{_rank_of(f"b_{n}")} AS b_{n}_rk' for n in _NIGHT)}, a_vol20, b_vol20, m_gap AS a_mkt_gap, m_pid AS a_mkt_id1, m_gap AS b_mkt_on1, m_id AS b_mkt_id1, CASE WHEN symbol <> {INDEX} THEN c / o - 1 END AS y_day, CASE WHEN symbol <> {INDEX} THEN nxt END AS y_night FROM x)
SELECT symbol, ix, {', '.join(f'{S.r6(n)} AS {n}' for n in _NIGHT_OUT)} FROM r""")
def features_overnight(spark, d):
    """Moves by night and by day over 1, 5 and 20 sessions as ranks, as known at the open (with
    the gap, plain and in deviations) and at the close; volatility, money turned over, the
    market's moves, and the returns by day and by night that follow."""
    c = F.col
    g = weekly_bars(spark, d)
    before = R.lag("c", 1)
    g = g.withColumns({"night": _ln(c("o"), before), "dayr": _ln(c("c"), c("o")), "lr": _ln(c("c"), before), "usd": c("c") * c("v")})
    whole = lambda agg, x, n: F.when(F.count(x).over(R.frame(n)) == n, agg(x).over(R.frame(n)))
    g = g.withColumns({"n5": whole(F.sum, "night", 5), "n20": whole(F.sum, "night", 20), "d5": whole(F.sum, "dayr", 5), "d20": whole(F.sum, "dayr", 20), "vol": whole(F.stddev_samp, "lr", 20) * math.sqrt(252), "dv": F.ln(whole(F.avg, "usd", 20))})
    g = g.withColumns({f"b_{n}": c(e) for n, e in _NIGHT.items()} | {f"a_{n}": R.lag(e, 1) for n, e in _NIGHT.items()} | {"a_gap": c("night"), "next_o": F.lead("o").over(R.by())})
    g = g.withColumn("a_gapz", ratio(c("night") * math.sqrt(252), c("a_vol20")))
    day = W.partitionBy("session")
    market = lambda e: F.max(F.when(c("symbol") == INDEX, c(e))).over(day)
    name = c("symbol") != INDEX
    g = g.withColumns({"a_mkt_gap": market("night"), "a_mkt_id1": market("a_id1"), "b_mkt_on1": market("night"), "b_mkt_id1": market("dayr"), "y_day": F.when(name, c("c") / c("o") - 1), "y_night": F.when(name, c("next_o") / c("c") - 1)})
    ranks = [*[f"a_{n}" for n in _OPEN], *[f"b_{n}" for n in _NIGHT]]
    g = _ranked(staged(g.drop("tax"), "night"), ranks, [f"{n}_rk" for n in ranks])
    g = g.withColumns({n: F.when(name, c(n)) for n in ("a_vol20", "b_vol20")})
    return g.select("symbol", "ix", *[r6(c(n)).alias(n) for n in _NIGHT_OUT])
