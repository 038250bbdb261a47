"""Bars, calendars and aligned panels."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import log_return, r6, ratio
from ..operators import rolling as R
from ..operators import xsection as X
from ..sources import views as V
from ..sources.staging import staged
from . import sql as S
from .catalog import query


def weekly_returns(spark, d):
    """The aligned weekly panel with one-week log returns."""
    grid = V.aligned(V.weekly(spark, d))
    return grid.withColumn("r", log_return(F.col("price"), R.lag("price", 1)))


@query(f"""WITH {S.BARS}, cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS ix FROM (SELECT DISTINCT session FROM bars)),
g AS (SELECT s.symbol, cal.session, ix, c FROM cal CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.session = cal.session),
r AS (SELECT *, CASE WHEN c > 0 AND lag(c) OVER w > 0 THEN ln(c / lag(c) OVER w) END AS lr FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ix)),
f AS (SELECT *, c / nullif(lag(c, 5) OVER w, 0) - 1 AS ret5, CASE WHEN count(*) OVER f5 = 5 AND count(lr) OVER f5 >= 3 THEN stddev_samp(lr) OVER f5 END AS vol5
FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ix), f5 AS (PARTITION BY symbol ORDER BY ix ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
k AS (SELECT *, CASE WHEN ret5 IS NOT NULL AND count(ret5) OVER (PARTITION BY session) > 5 THEN (row_number() OVER (PARTITION BY session ORDER BY ret5 NULLS LAST, symbol) - 1)
/ (count(ret5) OVER (PARTITION BY session) - 1) - 0.5 END AS pct FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY pct DESC, symbol) AS rank FROM k WHERE pct IS NOT NULL AND vol5 > 0)
SELECT symbol, session, {S.r6('ret5')} AS ret5, {S.r6('vol5')} AS vol5, {S.r6('pct')} AS pct, rank::INT AS rank FROM t WHERE rank <= 10""")
def flagship_momentum(spark, d):
    """Bars from events, panel on the calendar, guarded return and volatility of log returns,
    rank, top ten a session."""
    grid = V.aligned(staged(V.bars_daily(spark, d).select("symbol", "session", "c"), "bars"))
    w5 = R.frame(5)
    feats = grid.withColumn("ret5", ratio(F.col("c"), R.lag("c", 5)) - 1)
    feats = feats.withColumn("lr", log_return(F.col("c"), R.lag("c", 1)))
    feats = feats.withColumn("vol5", F.when((F.count(F.lit(1)).over(w5) == 5) & (F.count("lr").over(w5) >= 3), F.stddev_samp("lr").over(w5)))
    ranked = feats.withColumn("pct", X.rank_pct("ret5", least=5)).filter("pct is not null and vol5 > 0")
    best = X.top_k(ranked, "session", [F.desc("pct"), F.asc("symbol")], 10)
    return best.select("symbol", "session", r6(F.col("ret5")).alias("ret5"), r6(F.col("vol5")).alias("vol5"), r6(F.col("pct")).alias("pct"), "rank")


@query(f"WITH {S.BARS} SELECT * FROM bars")
def bars_daily(spark, d):
    return V.bars_daily(spark, d)


@query(f"""WITH {S.TICKS} SELECT symbol, date_trunc('hour', ts) AS hour, arg_min(price, ts) AS o, max(price) AS h, min(price) AS l,
arg_max(price, ts) AS c, count(*)::BIGINT AS v FROM ticks GROUP BY ALL""")
def bars_hourly(spark, d):
    return V.bars_of(V.ticks(spark, d), "symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))


@query(f"""WITH {S.TICKS}, slots AS (SELECT event_type, ts::DATE AS session, (hour(ts) * 2 + minute(ts) // 30)::INT AS slot, arg_min(price, ts) AS o, max(price) AS h,
min(price) AS l, arg_max(price, ts) AS c, count(*)::BIGINT AS v FROM ticks GROUP BY ALL)
SELECT event_type, session, (slot // 2)::INT AS pair, arg_min(o, slot) AS o, max(h) AS h, min(l) AS l, arg_max(c, slot) AS c, sum(v)::BIGINT AS v, count(*)::BIGINT AS slots FROM slots GROUP BY ALL""")
def bars_pair_rollup(spark, d):
    """Half-hour slots rolled up by pairs: the coarser bar is built from the finer one."""
    slot = (F.hour("ts") * 2 + F.floor(F.minute("ts") / 30)).cast("int")
    slots = V.bars_of(V.ticks(spark, d), "event_type", F.to_date("ts").alias("session"), slot.alias("slot"))
    pair = F.expr("int(slot div 2)").alias("pair")
    return slots.groupBy("event_type", "session", pair).agg(F.min_by("o", "slot").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "slot").alias("c"), F.sum("v").alias("v"), F.count(F.lit(1)).alias("slots"))


@query(f"WITH {S.GRID} SELECT symbol, session, ix, price, v FROM grid")
def panel_align(spark, d):
    return V.aligned(V.weekly(spark, d)).select("symbol", "session", "ix", "price", "v")


@query(f"""WITH {S.GRID} SELECT symbol, ix, {', '.join(f"{S.r6(f'price / nullif(lag(price, {n}) OVER w, 0) - 1')} AS ret{n}" for n in (1, 5, 20))},
{S.r6('ln(lag(price, 1) OVER w / lag(price, 2) OVER w)')} AS lagret FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY ix)""")
def returns_multi(spark, d):
    """Simple returns over 1, 5 and 20 sessions and yesterday's log return."""
    grid = V.aligned(V.weekly(spark, d))
    rets = [r6(ratio(F.col("price"), R.lag("price", n)) - 1).alias(f"ret{n}") for n in (1, 5, 20)]
    return grid.select("symbol", "ix", *rets, r6(log_return(R.lag("price", 1), R.lag("price", 2))).alias("lagret"))


@query(f"""WITH {S.WEEKLY}, {S.CAL}, w AS (SELECT symbol, ix, h / nullif(price, 0) AS ratio, price FROM weekly JOIN cal USING (session)),
s AS (SELECT *, ratio / nullif(lag(ratio) OVER (PARTITION BY symbol ORDER BY ix), 0) - 1 AS step, lag(price) OVER (PARTITION BY symbol ORDER BY ix) AS prior FROM w)
SELECT symbol, ix, {S.r6('step')} AS step, {S.r6('prior * step')} AS per_share FROM s WHERE abs(step) > 1e-4 AND abs(step) <= 0.2""")
def gap_dividend_step(spark, d):
    """Steps of the ratio of two price series: the ex-date and amount per share. Steps over 20 % are errors, not dividends."""
    p = V.indexed(V.weekly(spark, d)).withColumn("ratio", ratio(F.col("h"), F.col("price")))
    s = p.withColumn("step", ratio(F.col("ratio"), R.lag("ratio", 1)) - 1).withColumn("prior", R.lag("price", 1))
    return s.filter("abs(step) > 1e-4 and abs(step) <= 0.2").select("symbol", "ix", r6(F.col("step")).alias("step"), r6(F.col("prior") * F.col("step")).alias("per_share"))


@query(f"""WITH {S.WEEKLY} SELECT session FROM weekly GROUP BY session HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM weekly)""")
def common_sessions(spark, d):
    """Sessions on which every symbol traded."""
    b = V.weekly(spark, d).select("symbol", "session")
    n = b.agg(F.countDistinct("symbol").alias("n"))
    return b.groupBy("session").agg(F.countDistinct("symbol").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n"), "left_semi").select("session")


@query(f"""WITH {S.WEEKLY}, {S.CAL}, c AS (SELECT session, ix, count(*) OVER (PARTITION BY month(session), year(session) ORDER BY session) AS nth FROM cal)
SELECT session, ix::BIGINT AS ix, nth::BIGINT AS nth, CASE WHEN month(session) <= 6 THEN year(session)::VARCHAR || 'H1' ELSE year(session)::VARCHAR || 'H2' END AS half FROM c""")
def session_labels(spark, d):
    """Index, place within the month and half-year label of each session."""
    from ..functions.scalars import half_label

    c = V.calendar(V.weekly(spark, d))
    w = W.partitionBy(F.year("session"), F.month("session")).orderBy("session")
    return c.select("session", "ix", F.count(F.lit(1)).over(w).alias("nth"), half_label(F.col("session")).alias("half"))
