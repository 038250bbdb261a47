"""Windowed features of the weekly panel."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import blume, clip, r6, ratio
from ..operators import rolling as R
from ..sources import views as V
from . import sql as S
from .bars import weekly_returns
from .catalog import query

_N = 20


def _cols(**exprs):
    return [r6(e).alias(n) for n, e in exprs.items()]


def _guard(kind: str, agg: str, n: int = _N) -> str:
    w = S.frame(n)
    test = {"full": f"count(*) OVER {w} = {n}", "half": f"count(r) OVER {w} >= {n // 2}", "min5": f"count(r) OVER {w} >= 5", "strict": f"count(r) OVER {w} = {n}"}[kind]
    return f"CASE WHEN {test} THEN {agg} OVER {w} END"


@query(f"WITH {S.RET} SELECT symbol, ix, {S.r6(_guard('full', 'avg(r)'))} AS mean, {S.r6(_guard('full', 'stddev_samp(r)'))} AS vol FROM ret")
def roll_full(spark, d):
    """Needs 20 calendar rows; nulls inside are skipped."""
    return weekly_returns(spark, d).select("symbol", "ix", *_cols(mean=R.full(F.avg("r"), _N), vol=R.full(F.stddev_samp("r"), _N)))


@query(f"WITH {S.RET} SELECT symbol, ix, {S.r6(_guard('half', 'avg(r)'))} AS mean, {S.r6(_guard('half', 'max(r)'))} AS top FROM ret")
def roll_minhalf(spark, d):
    """Needs half of the values."""
    return weekly_returns(spark, d).select("symbol", "ix", *_cols(mean=R.half(F.avg("r"), F.col("r"), _N), top=R.half(F.max("r"), F.col("r"), _N)))


@query(f"WITH {S.RET} SELECT symbol, ix, {S.r6(_guard('min5', 'avg(r)'))} AS mean, {S.r6(_guard('min5', 'stddev_pop(r)'))} AS dev FROM ret")
def roll_minv(spark, d):
    """Needs five values."""
    return weekly_returns(spark, d).select("symbol", "ix", *_cols(mean=R.at_least(F.avg("r"), F.col("r"), _N, 5), dev=R.at_least(F.stddev_pop("r"), F.col("r"), _N, 5)))


@query(f"WITH {S.RET} SELECT symbol, ix, {S.r6(_guard('strict', 'sum(r)'))} AS total, {S.r6(_guard('strict', 'stddev_samp(r)'))} AS vol FROM ret")
def roll_strict(spark, d):
    """Any missing value makes the result missing."""
    return weekly_returns(spark, d).select("symbol", "ix", *_cols(total=R.strict(F.sum("r"), F.col("r"), _N), vol=R.strict(F.stddev_samp("r"), F.col("r"), _N)))


_VOLS = (5, 20, 60, 252)


@query(f"WITH {S.RET} SELECT symbol, ix, {', '.join(f'{S.r6(_guard("half", "stddev_samp(r)", n))} AS vol{n}' for n in _VOLS)} FROM ret".replace("\n", " "))
def vol_windows(spark, d):
    """Volatility over week, month, quarter and year of sessions."""
    return weekly_returns(spark, d).select("symbol", "ix", *[r6(R.half(F.stddev_samp("r"), F.col("r"), n)).alias(f"vol{n}") for n in _VOLS])


_OHLC = f"WITH {S.BARS}, e AS (SELECT symbol, session, ln(h / l) AS hl, ln(c / o) AS co, ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o) AS rs FROM bars WHERE l > 0)"


@query(f"""{_OHLC} SELECT symbol, count(*)::BIGINT AS n, {S.r6('sqrt(avg(hl * hl) / (4 * ln(2)))')} AS parkinson,
{S.r6('sqrt(greatest(avg(0.5 * hl * hl - (2 * ln(2) - 1) * co * co), 0))')} AS garman_klass, {S.r6('sqrt(greatest(avg(rs), 0))')} AS rogers_satchell FROM e GROUP BY symbol""")
def range_vol_estimators(spark, d):
    """Volatility from ranges, per symbol."""
    b = V.bars_daily(spark, d).filter("l > 0")
    ln = lambda a, c: F.ln(F.col(a) / F.col(c))
    hl, co = ln("h", "l"), ln("c", "o")
    k = 2 * F.ln(F.lit(2.0)) - 1
    rs = ln("h", "c") * ln("h", "o") + ln("l", "c") * ln("l", "o")
    root = lambda c: F.sqrt(F.greatest(F.avg(c), F.lit(0.0)))
    return b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), *_cols(parkinson=F.sqrt(F.avg(hl * hl) / (4 * F.ln(F.lit(2.0)))), garman_klass=root(0.5 * hl * hl - k * co * co), rogers_satchell=root(rs)))


@query(f"WITH {S.RET} SELECT symbol, ix, {S.r6(f'max(abs(r)) OVER {S.frame(5, -20)}')} AS echo, {S.r6(f'price / nullif(max(h) OVER {S.frame(52)}, 0) - 1')} AS off_high, {S.r6(f'price / nullif(min(l) OVER {S.frame(52)}, 0) - 1')} AS off_low FROM ret")
def echo_off_high_low(spark, d):
    """The largest move of the week 20 sessions ago; distance from the year's high and low."""
    w = R.frame(52)
    return weekly_returns(spark, d).select("symbol", "ix", *_cols(echo=F.max(F.abs("r")).over(R.frame(5, -20)), off_high=ratio(F.col("price"), F.max("h").over(w)) - 1, off_low=ratio(F.col("price"), F.min("l").over(w)) - 1))


_BENCH = f"{S.RET}, bench AS (SELECT ix, avg(r) AS m FROM ret GROUP BY ix), pair AS (SELECT ret.*, m FROM ret JOIN bench USING (ix))"
_W60 = S.frame(60)
_VALID = "CASE WHEN r IS NOT NULL THEN m END"


@query(f"""WITH {_BENCH}, b AS (SELECT symbol, ix, r, m, count(r) OVER {_W60} AS n, covar_pop(r, m) OVER {_W60} AS cv, var_pop({_VALID}) OVER {_W60} AS vm, var_pop(r) OVER {_W60} AS vr FROM pair)
SELECT symbol, ix, {S.r6('CASE WHEN n >= 40 AND vm > 0 THEN cv / vm END')} AS beta, {S.r6('CASE WHEN n >= 40 AND vm > 0 THEN sqrt(greatest(vr - cv * cv / vm, 0)) END')} AS resid,
{S.r6('coalesce(CASE WHEN n >= 40 AND vm > 0 THEN least(greatest(cv / vm, -3), 3) END, 1.0)')} AS beta_used FROM b""")
def rolling_beta_resid(spark, d):
    """60-session beta to the equal-weighted mean over valid pairs, residual deviation, and the clipped beta with its default."""
    return _beta(spark, d).select("symbol", "ix", *_cols(beta=F.col("beta"), resid=F.col("resid"), beta_used=F.coalesce(clip(F.col("beta"), -3, 3), F.lit(1.0))))


def _beta(spark, d):
    p = weekly_returns(spark, d)
    p = p.join(p.groupBy("ix").agg(F.avg("r").alias("m")), "ix")
    w, mv = R.frame(60), F.when(F.col("r").isNotNull(), F.col("m"))
    p = p.withColumns({"n": F.count("r").over(w), "cv": F.covar_pop("r", "m").over(w), "vm": F.var_pop(mv).over(w), "vr": F.var_pop("r").over(w)})
    ok = (F.col("n") >= 40) & (F.col("vm") > 0)
    return p.withColumns({"beta": F.when(ok, ratio(F.col("cv"), F.col("vm"))), "resid": F.when(ok, F.sqrt(F.greatest(F.col("vr") - ratio(F.col("cv") * F.col("cv"), F.col("vm")), F.lit(0.0))))})


@query(f"""WITH {_BENCH}, b AS (SELECT symbol, count(r) AS n, covar_pop(r, m) / nullif(var_pop({_VALID}), 0) AS raw FROM pair GROUP BY symbol)
SELECT symbol, n::BIGINT AS n, {S.r6('CASE WHEN n >= 40 THEN CASE WHEN symbol % 2 = 1 THEN raw * 2 / 3 + 1.0 / 3 ELSE raw END END')} AS beta FROM b""")
def blume_beta(spark, d):
    """Whole-sample beta, shrunk to one for stocks (odd symbols here) and raw for funds."""
    p = weekly_returns(spark, d)
    p = p.join(p.groupBy("ix").agg(F.avg("r").alias("m")), "ix")
    b = p.groupBy("symbol").agg(F.count("r").alias("n"), ratio(F.covar_pop("r", "m"), F.var_pop(F.when(F.col("r").isNotNull(), F.col("m")))).alias("raw"))
    return b.select("symbol", "n", r6(blume(F.col("raw"), F.col("n"), 40, F.col("symbol") % 2 == 1)).alias("beta"))


@query(f"""WITH RECURSIVE {S.BARS}, n AS (SELECT symbol, session, c, row_number() OVER (PARTITION BY symbol ORDER BY session) AS k FROM bars),
e AS (SELECT symbol, session, k, c AS ema FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.session, n.k, e.ema * (1 - 2.0::DOUBLE / 21) + n.c * (2.0::DOUBLE / 21) FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1)
SELECT symbol, k AS ix, {S.r6('ema')} AS ema20 FROM e""")
def ema20(spark, d):
    b = V.bars_daily(spark, d).withColumn("ix", F.row_number().over(W.partitionBy("symbol").orderBy("session")).cast("long"))
    return R.ema(b, "c", 20, "e").select("symbol", "ix", r6(F.col("e")).alias("ema20"))


@query(f"""WITH {S.RET}, s AS (SELECT symbol, ix, sign(r)::INT AS s FROM ret WHERE r IS NOT NULL),
n AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER (PARTITION BY symbol ORDER BY ix) THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY ix) AS run FROM n)
SELECT symbol, ix, (s * row_number() OVER (PARTITION BY symbol, run ORDER BY ix))::BIGINT AS streak FROM g""")
def streak(spark, d):
    p = weekly_returns(spark, d).filter("r is not null")
    return R.streak(p, F.signum("r").cast("int"), "streak").select("symbol", "ix", "streak")


@query(f"""WITH {S.WEEKLY}, {S.CAL}, p AS (SELECT symbol, ix, price FROM weekly JOIN cal USING (session)),
x AS (SELECT a.symbol, a.ix, b.price, max(b.price) OVER (PARTITION BY a.symbol, a.ix ORDER BY b.ix) AS top, count(*) OVER (PARTITION BY a.symbol, a.ix) AS n
FROM p a JOIN p b ON a.symbol = b.symbol AND b.ix BETWEEN a.ix - 12 AND a.ix)
SELECT symbol, ix::BIGINT AS ix, {S.r6('min(price / top - 1)')} AS drawdown FROM x WHERE n = 13 GROUP BY symbol, ix""")
def max_drawdown_window(spark, d):
    """Largest fall within 13 sessions without a gap."""
    p = V.aligned(V.weekly(spark, d))
    return p.withColumn("drawdown", R.drawdown("price", 13)).filter("drawdown is not null").select("symbol", "ix", r6(F.col("drawdown")).alias("drawdown"))


@query(f"""WITH {S.RET}, f AS (SELECT symbol, ix, lead(price, 5) OVER w / nullif(price, 0) - 1 AS fwd5, lead(price, 20) OVER w / nullif(price, 0) - 1 AS fwd20,
min(l) OVER {S.frame(20, 20)} / nullif(price, 0) - 1 AS low20, price FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY ix))
SELECT symbol, ix, {S.r6('fwd5')} AS fwd5, {S.r6('fwd20')} AS fwd20, {S.r6('low20')} AS low20, (low20 < -0.3)::INT AS fell FROM f WHERE price IS NOT NULL""")
def forward_targets(spark, d):
    """Returns to come over 5 and 20 sessions, and whether the low ahead is 30 % down."""
    p = weekly_returns(spark, d)
    low = ratio(F.min("l").over(R.frame(20, 20)), F.col("price")) - 1
    lead = lambda n: ratio(F.lead("price", n).over(R.by()), F.col("price")) - 1
    p = p.withColumns({"low": low, "f5": lead(5), "f20": lead(20)}).filter("price is not null")
    return p.select("symbol", "ix", *_cols(fwd5=F.col("f5"), fwd20=F.col("f20"), low20=F.col("low")), (F.col("low") < -0.3).cast("int").alias("fell"))
