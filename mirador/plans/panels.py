"""Composite feature panels: one row a symbol and session (and slot), a column a feature."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import temporal as T
from ..operators import xsection as X
from ..sources import views as V
from . import sql as S
from .catalog import query
from .stages import ahead, apply, chain, daily_grid, div, lag, ln, mean, over, panel, rank, slots, weekly_grid

# --- factors -------------------------------------------------------------------------------

_FACTOR = [
    {"r": ln(div("price", lag("price")))},
    {"mom": f"{div(lag('price'), lag('price', 13))} - 1", "rev": "-r", "calm": f"-({mean('r', 13, 7, agg='stddev_samp')})", "size": ln("price * v"), "y": f"{div(ahead('price'), 'price')} - 1"},
]
_NAMES = ("mom", "rev", "calm", "size")


@query(f"""{chain(S.GRID, "grid", *_FACTOR)}, u AS ({' UNION ALL '.join(f"SELECT '{n}' AS factor, session, ix, {n} AS x, y FROM t1 WHERE {n} IS NOT NULL AND y IS NOT NULL" for n in _NAMES)}),
q AS (SELECT factor, session, ix, quantile_cont(x, 0.8) AS hi, quantile_cont(x, 0.2) AS lo FROM u GROUP BY ALL HAVING count(*) >= 10),
f AS (SELECT q.factor, q.session, q.ix, avg(y) FILTER (x >= hi) - avg(y) FILTER (x <= lo) AS ret FROM u JOIN q USING (factor, session) GROUP BY ALL)
SELECT factor, ix, {S.r6('ret')} AS ret, {S.r6(f"sum(ret) {over(12, -1, 'factor')}")} AS momentum, {S.r6(f"avg((ret > 0)::INT) {over(52, -1, 'factor')}")} AS hit FROM f""")
def features_factor(spark, d):
    """Long-short quintile returns of four factors, with each factor's own momentum and hit rate before."""
    p = apply(weekly_grid(spark, d), *_FACTOR)
    u = p.unpivot(["session", "ix", "y"], list(_NAMES), "factor", "x").filter("x is not null and y is not null").withColumn("k", F.concat_ws("|", "factor", "session"))
    s = X.spread(u, "k", "x", "y", 0.2, 10).select(F.split("k", "\\|").alias("k"), F.col("spread").alias("ret")).select(F.col("k")[0].alias("factor"), F.col("k")[1].cast("date").alias("session"), "ret")
    f = s.join(F.broadcast(V.calendar(p.select("session"))), "session")
    w = lambda n: W.partitionBy("factor").orderBy("ix").rowsBetween(-n, -1)
    return f.select("factor", "ix", r6(F.col("ret")).alias("ret"), r6(F.sum("ret").over(w(12))).alias("momentum"), r6(F.avg((F.col("ret") > 0).cast("int")).over(w(52))).alias("hit"))


# --- intraday ------------------------------------------------------------------------------

_DAY, _SLOT = "symbol, session", "symbol, slot"
_PART = [
    {"px": f"coalesce({lag('c', 1, _DAY, 'slot')}, o)", "open": f"first_value(o) OVER (PARTITION BY {_DAY} ORDER BY slot)", "top": f"max(h) {over('all', -1, _DAY, 'slot')}", "low": f"min(l) {over('all', -1, _DAY, 'slot')}", "vday": f"sum(v) {over('all', -1, _DAY, 'slot')}"},
    {"since": ln(div("px", "open")), "last": ln(div(lag("c", 1, _DAY, "slot"), lag("o", 1, _DAY, "slot"))), "bar": ln(div("c", "o")), "sofar": ln(div("top", "low")), "lastrange": ln(div(lag("h", 1, _DAY, "slot"), lag("l", 1, _DAY, "slot"))), "vusual": f"avg(vday) {over(5, -1, _SLOT, 'session')}", "ahead1": ln(div(f"max(h) {over(2, 1, _DAY, 'slot')}", f"min(l) {over(2, 1, _DAY, 'slot')}")), "rest": ln(div(f"max(h) OVER (PARTITION BY {_DAY} ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", f"min(l) OVER (PARTITION BY {_DAY} ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"))},
    {"usual": f"CASE WHEN count(bar) {over(10, -1, _SLOT, 'session')} >= 5 THEN avg(bar) {over(10, -1, _SLOT, 'session')} END", "vrel": div("vday", "vusual"), "restusual": f"CASE WHEN count(rest) {over(10, -1, _SLOT, 'session')} >= 5 THEN avg(rest) {over(10, -1, _SLOT, 'session')} END"},
    {"since_xs": "since - avg(since) OVER (PARTITION BY session, slot)", "since_rk": rank("since", 3, "session, slot")},
]
panel(
    "features_intraday",
    "Per slot of the day: return since the open, the last bar, ranges and volume so far against the slot's own past, the same slot's usual move; and as targets the next slots' and the rest of the day's range.",
    slots, S.SLOTS, "slots", _PART, ["symbol", "session", "slot"],
    ["since", "last", "sofar", "lastrange", "vrel", "usual", "since_xs", "since_rk", "ahead1", "rest", "restusual"],
)


@query(f"""{chain(S.SLOTS, "slots", *_PART[:2])}, k AS (SELECT symbol, session, slot, bar, rest FROM t1)
SELECT slot, count(bar)::BIGINT AS n, {S.r6('avg(bar)')} AS mean, {S.r6('avg(bar) / nullif(stddev_samp(bar) / sqrt(count(bar)), 0)')} AS t, {S.r6('avg(abs(bar))')} AS size, {S.r6('avg(rest)')} AS rest FROM k GROUP BY slot""")
def time_of_day(spark, d):
    """Mean move, its t, mean size and the usual rest of the day, by slot."""
    p = apply(slots(spark, d), *_PART[:2])
    t = F.try_divide(F.avg("bar"), F.stddev_samp("bar") / F.sqrt(F.count("bar")))
    return p.groupBy("slot").agg(F.count("bar").alias("n"), r6(F.avg("bar")).alias("mean"), r6(t).alias("t"), r6(F.avg(F.abs("bar"))).alias("size"), r6(F.avg("rest")).alias("rest"))


@query(f"""{chain(S.SLOTS, "slots", _PART[0])}, b AS (SELECT symbol, session, ln(c / nullif(px, 0)) AS r FROM t0 WHERE c > 0 AND px > 0)
SELECT symbol, session, count(*)::BIGINT AS bars, {S.r6('sum(r * r)')} AS rv, {S.r6('ln(greatest(sqrt(252 * sum(r * r)), 0.01))')} AS lrv FROM b GROUP BY ALL HAVING count(*) >= 6""")
def realized_variance(spark, d):
    """Sum of squared log returns within the day (the first bar from its open), of six bars at least."""
    b = apply(slots(spark, d), _PART[0]).filter("c > 0 and px > 0").withColumn("r", F.ln(F.col("c") / F.col("px")))
    rv = F.sum(F.col("r") * F.col("r"))
    g = b.groupBy("symbol", "session").agg(F.count(F.lit(1)).alias("bars"), rv.alias("rv")).filter("bars >= 6")
    return g.select("symbol", "session", "bars", r6(F.col("rv")).alias("rv"), r6(F.ln(F.greatest(F.sqrt(252 * F.col("rv")), F.lit(0.01)))).alias("lrv"))


# --- events, news, macro -------------------------------------------------------------------

_KINDS = {"view": "n_view", "click": "n_click", "error": "n_error", "signup": "n_signup"}
_DEC = f"{S.TICKS}, dec AS (SELECT event_id, symbol, ts FROM ticks WHERE event_type = 'purchase')"


@query(f"""WITH {_DEC}, j AS (SELECT d.event_id, d.symbol, d.ts, f.event_type AS kind, f.ts AS t, f.price FROM dec d LEFT JOIN ticks f ON f.symbol = d.symbol AND f.ts < d.ts AND f.ts >= d.ts - INTERVAL 5 DAY AND f.event_type <> 'purchase')
SELECT event_id, {', '.join(f"count(*) FILTER (kind = '{k}' AND t >= ts - INTERVAL 1 DAY)::BIGINT AS {n}1, count(*) FILTER (kind = '{k}')::BIGINT AS {n}5" for k, n in _KINDS.items())},
(count(*) FILTER (kind IN ('error', 'signup') AND t >= ts - INTERVAL 1 DAY) > 0)::INT AS any_filing, (count(*) FILTER (kind IN ('view', 'click') AND t >= ts - INTERVAL 1 DAY) > 0)::INT AS any_headline,
floor(epoch(ts - max(t) FILTER (kind = 'error')) / 86400)::INT AS days_since_error FROM j GROUP BY event_id, ts""")
def features_event(spark, d):
    """For each purchase the events of four kinds in the day and five days before, any-flags,
    and whole days since the last error of those five. Running sums over sorted unions."""
    t = V.ticks(spark, d)
    out = t.filter("event_type = 'purchase'").select("event_id", "symbol", "ts")
    for kind, name in _KINDS.items():
        out = T.interval_counts(out, t.filter(F.col("event_type") == kind).select("symbol", "ts"), "symbol", "ts", {f"{name}1": 1, f"{name}5": 5})
    out = T.asof(out, t.filter("event_type = 'error'").select("symbol", "ts"), "symbol", "ts", [], tolerance="5 DAY")
    days = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("asof_time").cast("timestamp"))) / 1e6 / 86400).cast("int")
    flag = lambda *names: (sum((F.col(n) for n in names), F.lit(0)) > 0).cast("int")
    return out.select("event_id", *[f"{n}{k}" for n in _KINDS.values() for k in (1, 5)], flag("n_error1", "n_signup1").alias("any_filing"), flag("n_view1", "n_click1").alias("any_headline"), days.alias("days_since_error"))


_NEWS = f"""{S.BARS}, day AS (SELECT symbol, ts::DATE AS session, count(*) FILTER (event_type IN ('view', 'click')) AS n, sum(price) FILTER (event_type IN ('view', 'click')) AS s, max(price) FILTER (event_type IN ('view', 'click')) AS top FROM ticks GROUP BY ALL),
cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS ix FROM (SELECT DISTINCT session FROM bars)),
news AS (SELECT y.symbol, cal.session, cal.ix::BIGINT AS ix, coalesce(n, 0) AS n, coalesce(s, 0.0) AS s, top FROM cal CROSS JOIN (SELECT DISTINCT symbol FROM bars) y LEFT JOIN day ON day.symbol = y.symbol AND day.session = cal.session)"""


def _news(spark, d):
    t = V.ticks(spark, d)
    is_news = F.col("event_type").isin("view", "click")
    day = t.groupBy("symbol", F.to_date("ts").alias("session")).agg(F.count(F.when(is_news, 1)).alias("n"), F.sum(F.when(is_news, F.col("price"))).alias("s"), F.max(F.when(is_news, F.col("price"))).alias("top"))
    return V.aligned(day).withColumns({"n": F.coalesce("n", F.lit(0)), "s": F.coalesce("s", F.lit(0.0))})


panel(
    "features_news",
    "Headline counts over 1, 5 and 20 sessions before, their mean and highest tone, the count against its own past and the market, and the quiet run.",
    _news, _NEWS, "news",
    [
        {f"n{k}": f"sum(n) {over(k, -1)}" for k in (1, 5, 20)} | {f"tone{k}": div(f"sum(s) {over(k, -1)}", f"sum(n) {over(k, -1)}") for k in (1, 5, 20)} | {"top5": f"max(top) {over(5, -1)}", "lastix": f"max(CASE WHEN n > 0 THEN ix END) {over('all', -1)}"},
        {"usual": "n20 / 20e0", "market": "avg(n1) OVER (PARTITION BY session)", "quiet": "ix - lastix", "shift": "tone1 - tone20"},
        {"odd": "(n1 - usual) / sqrt(usual + 1.0)", "share": div("n1", "market")},
        {"odd_rk": rank("odd")},
    ],
    ["symbol", "ix"], ["n1", "n5", "n20", "tone1", "tone5", "tone20", "top5", "quiet", "shift", "odd", "share", "odd_rk"],
)

#: An event's release by its type, where its number is small; other events aren't releases.
_RELEASE = "CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 40 THEN CASE event_type WHEN 'signup' THEN 'am1' WHEN 'purchase' THEN 'am2' WHEN 'error' THEN 'fomc' WHEN 'view' THEN 'other' END END"


@query(f"""WITH ev AS (SELECT user_id AS symbol, ts::DATE AS session, hour(ts) * 60 + minute(ts) AS t, {_RELEASE} AS key, abs(value - 100) / 40 AS z FROM events),
days AS (SELECT DISTINCT symbol, session FROM ev), looks AS (SELECT symbol, session, k, 570 + 30 * k AS tm FROM days, (SELECT unnest(range(13)) AS k)),
f AS (SELECT l.symbol, l.session, l.k, coalesce(bool_or(key = 'am1' AND t < 570), FALSE) AS am830_t1, coalesce(bool_or(key = 'am2' AND t < 570), FALSE) AS am830_t2, coalesce(bool_or(t >= 570 AND t - tm BETWEEN 0 AND 59), FALSE) AS next60, coalesce(bool_or(t >= 570 AND tm - t BETWEEN 1 AND 60), FALSE) AS last60,
coalesce(bool_or(key = 'fomc'), FALSE) AND any_value(tm) < 840 AS fomc_ahead, coalesce(bool_or(key = 'fomc'), FALSE) AND any_value(tm) >= 840 AS fomc_after, coalesce(max(CASE WHEN key = 'am1' AND t < 570 THEN z END), 0) AS absz FROM looks l LEFT JOIN ev e ON e.symbol = l.symbol AND e.session = l.session AND e.key IS NOT NULL GROUP BY l.symbol, l.session, l.k)
SELECT symbol, session, k::INT AS look, am830_t1, am830_t2, next60, last60, fomc_ahead, fomc_after, {S.r6('absz')} AS absz_am, CASE WHEN fomc_after THEN 1 WHEN fomc_ahead THEN 2 WHEN am830_t1 AND k < 2 THEN 3 WHEN am830_t1 AND k < 6 THEN 4 WHEN am830_t1 THEN 5 WHEN next60 OR last60 THEN 6 WHEN am830_t2 THEN 7 ELSE 0 END AS state,
CASE WHEN NOT fomc_after AND NOT fomc_ahead AND am830_t1 AND k < 2 AND absz >= 1 THEN 8 WHEN fomc_after THEN 1 WHEN fomc_ahead THEN 2 WHEN am830_t1 THEN CASE WHEN k < 2 THEN 3 WHEN k < 6 THEN 4 ELSE 5 END WHEN next60 OR last60 THEN 6 WHEN am830_t2 THEN 7 ELSE 0 END AS state_z FROM f""")
def features_macro(spark, d):
    """Flags and the one state, of nine, of each half-hour look at a calendar's day: releases
    before the open in two tiers, those of the hour before and after, and a decision at 14:00."""
    t = V.table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("session"), (F.hour("ts") * 60 + F.minute("ts")).alias("t"), F.expr(_RELEASE).alias("key"), (F.abs(F.col("value") - 100) / 40).alias("z"))
    kept = F.when(F.col("key").isNotNull(), F.struct("key", "t", "z"))
    day = t.groupBy("symbol", "session").agg(F.collect_list(kept).alias("ev"))
    looks = day.withColumn("look", F.explode(F.sequence(F.lit(0), F.lit(12))))
    return look_states(looks).select("symbol", "session", "look", *FLAGS, r6(F.col("absz_am")).alias("absz_am"), "state", "state_z")


FLAGS = ("am830_t1", "am830_t2", "next60", "last60", "fomc_ahead", "fomc_after")


def look_states(looks):
    """``looks`` (look, ev: an array of key, t the minute, z) with the flags and states. Keys:
    am1, am2 (releases of the first and second tier), fomc, other."""
    at = 570 + 30 * F.col("look")
    any_ = lambda test: F.exists("ev", test)
    early = lambda e, key: (e["key"] == key) & (e["t"] < 570)
    decision = any_(lambda e: e["key"] == "fomc")
    flags = {
        "am830_t1": any_(lambda e: early(e, "am1")), "am830_t2": any_(lambda e: early(e, "am2")), "next60": any_(lambda e: (e["t"] >= 570) & (e["t"] >= at) & (e["t"] < at + 60)),
        "last60": any_(lambda e: (e["t"] >= F.greatest(at - 60, F.lit(570))) & (e["t"] < at)), "fomc_ahead": decision & (at < 840), "fomc_after": decision & (at >= 840),
        "absz_am": F.coalesce(F.array_max(F.transform(F.filter("ev", lambda e: early(e, "am1")), lambda e: e["z"])), F.lit(0.0)),
    }
    k = F.col("look")

    def state(split):
        first = F.when(F.col("absz_am") >= 1, 8).otherwise(3) if split else F.lit(3)
        morning = F.when(k <= 1, first).when(k <= 5, 4).otherwise(5)
        return F.when(F.col("fomc_after"), 1).when(F.col("fomc_ahead"), 2).when(F.col("am830_t1"), morning).when(F.col("next60") | F.col("last60"), 6).when(F.col("am830_t2"), 7).otherwise(0)

    return looks.withColumns(flags).withColumns({"state": state(False), "state_z": state(True)})


# --- regime --------------------------------------------------------------------------------

_REGIME = [
    {"r": ln(div("price", lag("price"))), "base": mean("price", 10, 5)},
    {"up": "CASE WHEN price IS NOT NULL AND base IS NOT NULL THEN CASE WHEN price > base THEN 1e0 ELSE 0e0 END END"},
]
_MARKET = [
    {"vol5": f"stddev_samp(m) {over(5, 0, 'k')}", "vol20": f"stddev_samp(m) {over(20, 0, 'k')}", "lvl": f"sum(m) {over('all', 0, 'k')}", "fvol5": f"stddev_samp(m) {over(5, 5, 'k')}", "fret5": f"sum(m) {over(5, 5, 'k')}", "full": f"count(m) {over(5, 5, 'k')}"},
    {"down": f"lvl - max(lvl) {over(52, 0, 'k')}", "trend": f"sum(m) {over(20, 0, 'k')}", "calm": "CASE WHEN vol5 < vol20 THEN 1e0 ELSE 0e0 END", "worst": f"min(lvl) {over(5, 5, 'k')} - lvl"},
]


@query(f"""{chain(S.GRID, "grid", *_REGIME)}, mkt AS (SELECT 0 AS k, ix, avg(r) AS m, avg(up) AS breadth, stddev_samp(r) AS disp FROM t1 GROUP BY ix HAVING count(up) >= 10 AND count(r) >= 10),
{chain("", "mkt", *_MARKET).removeprefix("WITH , ").replace("t0", "m0").replace("t1", "m1")}
SELECT ix, {', '.join(f'{S.r6(c)} AS {c}' for c in ('breadth', 'disp', 'vol5', 'vol20', 'down', 'trend', 'calm'))}, {', '.join(f'CASE WHEN "full" = 5 THEN {S.r6(c)} END AS {c}' for c in ('fvol5', 'fret5', 'worst'))} FROM m1""".replace(" AS full", ' AS "full"'))
def features_regime(spark, d):
    """Market series: breadth above the ten-session mean and dispersion (of ten symbols at
    least), trailing volatility, drawdown and trend; ahead: volatility, return and worst point."""
    p = apply(weekly_grid(spark, d), *_REGIME)
    m = p.groupBy("ix").agg(F.avg("r").alias("m"), F.avg("up").alias("breadth"), F.stddev_samp("r").alias("disp"), F.count("up").alias("nu"), F.count("r").alias("nr")).filter("nu >= 10 and nr >= 10").withColumn("k", F.lit(0))
    # one row a session: the market's own series is small
    a = apply(m, *_MARKET)
    return a.select("ix", *[r6(F.col(c)).alias(c) for c in ("breadth", "disp", "vol5", "vol20", "down", "trend", "calm")], *[F.when(F.col("full") == 5, r6(F.col(c))).alias(c) for c in ("fvol5", "fret5", "worst")])
