"""Point-in-time serving: what a decision at a given time may see, and what it is told."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import correlation, r6, ratio
from ..operators import temporal as T
from ..sources import views as V
from . import sql as S
from .catalog import query
from .stages import apply, chain, daily_grid, div, lag, ln, mean, over, panel, rules, slots, weekly_grid

_DEC = f"{S.TICKS}, dec AS (SELECT event_id, symbol, ts FROM ticks WHERE event_type = 'purchase')"
_KINDS = ("view", "click", "error", "signup")


def _purchases(spark, d):
    return V.ticks(spark, d).filter("event_type = 'purchase'").select("event_id", "symbol", "ts")


def _of(spark, d, kind):
    return V.ticks(spark, d).filter(F.col("event_type") == kind).select("symbol", "ts", "event_id", "price")


@query(f"""WITH {_DEC}, v AS (SELECT symbol, ts + INTERVAL 60 MINUTE AS seen, price FROM ticks WHERE event_type = 'view')
SELECT d.event_id, v.price AS value, v.seen AS visible_at FROM dec d ASOF LEFT JOIN v ON d.symbol = v.symbol AND d.ts >= v.seen""")
def provider_delayed(spark, d):
    """The latest figure visible to each decision, where a figure shows an hour after its time."""
    v = _of(spark, d, "view").select("symbol", (F.col("ts") + F.expr("INTERVAL 60 MINUTES")).alias("ts"), "price")
    got = T.asof(_purchases(spark, d), v, "symbol", "ts", ["price"], strict=False)
    return got.select("event_id", F.col("asof_price").alias("value"), F.col("asof_time").alias("visible_at"))


_NOTE = "CASE WHEN error IS NOT NULL AND age_error < 86400 THEN 'fresh error' WHEN signup IS NOT NULL AND age_signup < 86400 THEN 'fresh signup' WHEN view IS NULL AND click IS NULL THEN 'never seen' WHEN view > 150 THEN 'high view' END"
_AGE = {f"age_{k}": f"epoch(ts - t_{k})" for k in ("error", "signup")}


@query(f"""WITH {_DEC}, {', '.join(f"{k}s AS (SELECT symbol, ts, price FROM ticks WHERE event_type = '{k}')" for k in _KINDS)},
j AS (SELECT d.event_id, d.ts, {', '.join(f'{k}s.price AS "{k}", {k}s.ts AS t_{k}' for k in _KINDS)} FROM dec d {' '.join(f'ASOF LEFT JOIN {k}s ON d.symbol = {k}s.symbol AND d.ts > {k}s.ts' for k in _KINDS)}),
a AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _AGE.items())} FROM j)
SELECT event_id, "view", click, error, signup, {_NOTE.replace('view ', '"view" ')} AS note, concat_ws('; ', CASE WHEN "view" IS NOT NULL THEN 'view' END, CASE WHEN click IS NOT NULL THEN 'click' END, CASE WHEN error IS NOT NULL THEN 'error' END, CASE WHEN signup IS NOT NULL THEN 'signup' END) AS sources FROM a""")
def provider_rows(spark, d):
    """The last row of four sources before a decision, one note by precedence, and what was there."""
    out = _purchases(spark, d)
    for k in _KINDS:
        keep = [c for c in out.columns]
        out = T.asof(out, _of(spark, d, k).drop("event_id"), "symbol", "ts", ["price"]).select(*keep, F.col("asof_price").alias(k), F.col("asof_time").alias(f"t_{k}"))
    secs = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    out = out.withColumns({f"age_{k}": secs("ts") - secs(f"t_{k}") for k in ("error", "signup")})
    there = F.concat_ws("; ", *[F.when(F.col(k).isNotNull(), k) for k in _KINDS])
    return out.select("event_id", *_KINDS, F.expr(_NOTE).alias("note"), there.alias("sources"))


@query(f"""WITH {S.TICKS}, e AS (SELECT DISTINCT symbol, ts::DATE AS day FROM ticks WHERE event_type = 'signup'), g AS (SELECT symbol, day, day - lag(day) OVER (PARTITION BY symbol ORDER BY day) AS gap FROM e),
m AS (SELECT symbol, max(day) AS last_day, count(*) AS n, quantile_cont(gap, 0.5) FILTER (gap BETWEEN 2 AND 10) AS usual FROM g GROUP BY symbol)
SELECT symbol, last_day, n::BIGINT AS n, CASE WHEN n >= 3 AND usual IS NOT NULL THEN 'median gap' ELSE 'one week' END AS rule, last_day + CASE WHEN n >= 3 AND usual IS NOT NULL THEN floor(usual + 0.5)::INT ELSE 7 END AS next_day FROM m""")
def next_event_estimate(spark, d):
    """When a symbol's next event is due: the last plus the median of its plausible gaps, or a week."""
    e = _of(spark, d, "signup").select("symbol", F.to_date("ts").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(W.partitionBy("symbol").orderBy("day")))
    m = e.withColumn("gap", gap).groupBy("symbol").agg(F.max("day").alias("last_day"), F.count(F.lit(1)).alias("n"), F.percentile(F.when(F.col("gap").between(2, 10), F.col("gap")), 0.5).alias("usual"))
    own = (F.col("n") >= 3) & F.col("usual").isNotNull()
    step = F.when(own, F.floor(F.col("usual") + 0.5).cast("int")).otherwise(7)
    return m.select("symbol", "last_day", "n", F.when(own, "median gap").otherwise("one week").alias("rule"), F.date_add("last_day", step).alias("next_day"))


#: Offsets that a histogram of errors holds, and the uniform mass mixed in.
_OFF_LO, _OFF_HI, _MIXED = -4, 10, 0.005


@query(f"""WITH {S.TICKS}, e AS (SELECT DISTINCT symbol, ts::DATE AS day FROM ticks WHERE event_type = 'signup'), g AS (SELECT symbol, day, lag(day) OVER w AS was, CASE WHEN day - lag(day) OVER w BETWEEN 2 AND 10 THEN day - lag(day) OVER w END AS gap, row_number() OVER w AS k FROM e WINDOW w AS (PARTITION BY symbol ORDER BY day)),
p AS (SELECT symbol, day, was + CASE WHEN count(gap) OVER v >= 2 THEN floor(quantile_cont(gap, 0.5) OVER v)::INT ELSE 7 END AS said FROM g WINDOW v AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT least({_OFF_HI}, greatest({_OFF_LO}, day - said)) AS bin FROM p WHERE said IS NOT NULL), h AS (SELECT b.bin, count(r.bin) AS n FROM (SELECT unnest(range({_OFF_LO}, {_OFF_HI + 1})) AS bin) b LEFT JOIN r ON r.bin = b.bin GROUP BY b.bin),
m AS (SELECT bin, n, {1 - _MIXED} * n / greatest(1, sum(n) OVER ()) + {_MIXED} / {_OFF_HI - _OFF_LO + 1}e0 AS p FROM h), c AS (SELECT *, coalesce(sum(p) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(p) OVER (ORDER BY bin) AS upto FROM m),
x AS (SELECT *, coalesce(sum(p) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 0) AS three FROM c)
SELECT bin::INT AS bin, n::BIGINT AS n, {S.r6('p')} AS p, {S.r6('upto')} AS cum, {S.r6('CASE WHEN 1 - before > 1e-9 THEN three / (1 - before) ELSE 0 END')} AS window_p FROM x""")
def cycle_histogram(spark, d):
    """Errors in days of predictions from each firm's own earlier gaps (the last report plus the
    median of its plausible gaps, or a week) as a clipped histogram with a little uniform mass:
    its cumulative form, and the chance of the next three days given that none came before."""
    e = _of(spark, d, "signup").select("symbol", F.to_date("ts").alias("day")).distinct()
    own = W.partitionBy("symbol").orderBy("day")
    past = own.rowsBetween(W.unboundedPreceding, -1)
    g = e.withColumns({"was": F.lag("day").over(own), "days": F.datediff("day", F.lag("day").over(own))}).withColumn("gap", F.when(F.col("days").between(2, 10), F.col("days")))
    usual = F.when(F.count("gap").over(past) >= 2, F.floor(F.percentile("gap", 0.5).over(past)).cast("int")).otherwise(7)
    err = g.withColumn("said", F.date_add("was", usual)).filter("said is not null").select(F.greatest(F.lit(_OFF_LO), F.least(F.lit(_OFF_HI), F.datediff("day", "said"))).alias("bin"))
    bins = _OFF_HI - _OFF_LO + 1
    counts = err.groupBy("bin").count()
    h = spark.range(_OFF_LO, _OFF_HI + 1).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))
    w, every = W.orderBy("bin"), W.partitionBy(F.lit(0))  # fifteen rows
    m = h.withColumn("p", (1 - _MIXED) * F.col("n") / F.greatest(F.lit(1), F.sum("n").over(every)) + _MIXED / bins)
    before, three = F.coalesce(F.sum("p").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), F.sum("p").over(w.rowsBetween(0, 2))
    return m.select("bin", "n", r6(F.col("p")).alias("p"), r6(F.sum("p").over(w.rowsBetween(W.unboundedPreceding, 0))).alias("cum"), r6(F.when(1 - before > 1e-9, three / (1 - before)).otherwise(0.0)).alias("window_p"))


@query(f"""WITH {S.TICKS}, days AS (SELECT DISTINCT ts::DATE AS day FROM ticks), items AS (SELECT event_id, symbol, price, CASE WHEN event_type = 'error' THEN 'release' ELSE 'headline' END AS kind, ts + CASE WHEN event_type = 'error' THEN INTERVAL 60 MINUTE ELSE INTERVAL 0 MINUTE END AS seen FROM ticks WHERE event_type IN ('error', 'click')),
v AS (SELECT d.day, i.*, row_number() OVER (PARTITION BY d.day ORDER BY CASE WHEN kind = 'release' THEN 0 ELSE 1 END, seen DESC, event_id DESC) AS place, count(*) OVER (PARTITION BY d.day) AS visible FROM days d JOIN items i ON i.seen >= d.day - INTERVAL 7 DAY + INTERVAL 9 HOUR AND i.seen < d.day + INTERVAL 9 HOUR)
SELECT day, place::INT AS place, visible::BIGINT AS visible, kind, event_id, seen FROM v WHERE place <= 5""")
def tape_rows(spark, d):
    """The tape at nine of each day: releases first, then headlines, newest first, of the week
    that is visible; its first five rows and how many there are. An item goes to the days that
    see it, seven at most."""
    t = V.ticks(spark, d)
    kind = F.when(F.col("event_type") == "error", "release").otherwise("headline")
    seen = F.when(F.col("event_type") == "error", F.col("ts") + F.expr("INTERVAL 60 MINUTES")).otherwise(F.col("ts"))
    items = t.filter(F.col("event_type").isin("error", "click")).select("event_id", kind.alias("kind"), seen.alias("seen"))
    first = F.to_date(F.col("seen") + F.expr("INTERVAL 15 HOURS"))
    shown = items.withColumn("day", F.explode(F.sequence(first, F.date_add(first, 6))))
    shown = shown.join(F.broadcast(t.select(F.to_date("ts").alias("day")).distinct()), "day", "left_semi")
    per = W.partitionBy("day")
    v = shown.withColumns({"place": F.row_number().over(per.orderBy(F.when(F.col("kind") == "release", 0).otherwise(1), F.desc("seen"), F.desc("event_id"))), "visible": F.count(F.lit(1)).over(per)})
    return v.filter("place <= 5").select("day", "place", "visible", "kind", "event_id", "seen")


panel(
    "market_stats",
    "What a quote request at a session answers: last, previous close, change, five-day high and low, three-week volatility, and usual volume; the session itself is not yet known.",
    daily_grid, S.BGRID, "bgrid",
    [
        {"r": ln(div("c", lag("c")))},
        {"last": lag("c"), "prev": lag("c", 2), "hi5": f"max(h) {over(5, -1)}", "lo5": f"min(l) {over(5, -1)}", "vol15": mean("r", 15, 5, -1, "stddev_samp"), "volume10": mean("v", 10, 5, -1)},
        {"change": f"{div('last', 'prev')} - 1", "place": div("last - lo5", "hi5 - lo5"), "mark": "coalesce(c, (h + l) / 2, last)"},
    ],
    ["symbol", "ix"], ["last", "prev", "change", "hi5", "lo5", "place", "vol15", "volume10", "mark"],
)


@query(f"""WITH {S.TICKS}, a AS (SELECT symbol, event_id, ts, price, 'archive' AS source FROM ticks WHERE event_type = 'view'), b AS (SELECT symbol, event_id + 1 AS event_id, ts, price, 'live' AS source FROM ticks WHERE event_type IN ('click', 'view')),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.symbol = b.symbol AND a.event_id = b.event_id)), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC, source) AS place FROM u)
SELECT symbol, place::INT AS place, event_id, source, ts FROM k WHERE place <= 3""")
def merged_news(spark, d):
    """Archive rows and the live rows that the archive has not, newest first, three a symbol."""
    t = V.ticks(spark, d)
    a = t.filter("event_type = 'view'").select("symbol", "event_id", "ts", F.lit("archive").alias("source"))
    b = t.filter(F.col("event_type").isin("click", "view")).select("symbol", (F.col("event_id") + 1).alias("event_id"), "ts", F.lit("live").alias("source"))
    u = a.unionByName(b.join(a.select("symbol", "event_id"), ["symbol", "event_id"], "left_anti"))
    w = W.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("event_id"), "source")
    return u.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("symbol", "place", "event_id", "source", "ts")


@query("""SELECT d.doc_id, coalesce(l.quality, p.page_id % 2, -1)::INT AS value, CASE WHEN l.quality IS NOT NULL THEN 'labels' WHEN p.page_id IS NOT NULL THEN 'pages' ELSE 'none' END AS store
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT page_id FROM pages) p ON p.page_id = d.doc_id""")
def store_lookup(spark, d):
    """A value from the first of several stores that has it."""
    docs = V.table(spark, d, "documents").select("doc_id").distinct()
    l = V.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))  # noqa: E741
    p = V.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), (F.col("page_id") % 2).alias("page")).distinct()
    j = docs.join(l, "doc_id", "left").join(p, "doc_id", "left")
    store = F.when(F.col("quality").isNotNull(), "labels").when(F.col("page").isNotNull(), "pages").otherwise("none")
    return j.select("doc_id", F.coalesce("quality", "page", F.lit(-1)).cast("int").alias("value"), store.alias("store"))


@query(f"""WITH {_DEC.split(', dec')[0]}, g AS (SELECT ts::DATE AS day, symbol, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS names, max((event_type = 'error')::INT) AS had_error, count(*) AS n FROM ticks GROUP BY ALL)
SELECT day, count(*)::BIGINT AS symbols, {S.r6('avg(kinds)')} AS kinds, {S.r6('avg((kinds >= 2)::INT)')} AS several, {S.r6('avg(had_error)')} AS with_error, {S.r6('sum(n) / count(*)')} AS per_symbol, max(length(names))::INT AS longest FROM g GROUP BY day""")
def news_density(spark, d):
    """How dense the news of a day is: sources a symbol, shares with several and with an error."""
    g = V.ticks(spark, d).groupBy(F.to_date("ts").alias("day"), "symbol").agg(F.sort_array(F.collect_set("event_type")).alias("kinds"), F.max((F.col("event_type") == "error").cast("int")).alias("had_error"), F.count(F.lit(1)).alias("n"))
    k = F.size("kinds")
    return g.groupBy("day").agg(F.count(F.lit(1)).alias("symbols"), r6(F.avg(k)).alias("kinds"), r6(F.avg((k >= 2).cast("int"))).alias("several"), r6(F.avg("had_error")).alias("with_error"), r6(F.sum("n") / F.count(F.lit(1))).alias("per_symbol"), F.max(F.char_length(F.array_join("kinds", ","))).alias("longest"))


_MOVE = [{"r": ln(div("c", "o"))}]


@query(f"""{chain(S.SLOTS, "slots", *_MOVE)}, ev AS (SELECT DISTINCT session FROM t0 WHERE symbol = 'error' AND slot = 4), m AS (SELECT slot, ev.session IS NOT NULL AS event, abs(r) AS a FROM t0 LEFT JOIN ev USING (session) WHERE r IS NOT NULL),
g AS (SELECT slot, quantile_cont(a, 0.5) FILTER (event) AS hot, quantile_cont(a, 0.5) FILTER (NOT event) AS quiet, count(*) FILTER (event) AS n FROM m GROUP BY slot)
SELECT slot, n::BIGINT AS n, {S.r6('hot')} AS hot, {S.r6('quiet')} AS quiet, {S.r6('hot / nullif(quiet, 0)')} AS ratio FROM g""")
def event_time_check(spark, d):
    """Median move by slot on days with a noon event and on quiet days: the true time stands out."""
    s = apply(slots(spark, d), *_MOVE)
    ev = s.filter("symbol = 'error' and slot = 4").select("session", F.lit(True).alias("event")).distinct()
    m = s.filter("r is not null").join(F.broadcast(ev), "session", "left").select("slot", F.coalesce("event", F.lit(False)).alias("event"), F.abs("r").alias("a"))
    mid = lambda c: F.percentile(F.when(c, F.col("a")), 0.5)
    g = m.groupBy("slot").agg(mid(F.col("event")).alias("hot"), mid(~F.col("event")).alias("quiet"), F.count(F.when(F.col("event"), 1)).alias("n"))
    return g.select("slot", "n", r6(F.col("hot")).alias("hot"), r6(F.col("quiet")).alias("quiet"), r6(ratio(F.col("hot"), F.col("quiet"))).alias("ratio"))


def offset_hours(utc):
    """Hours from New York to UTC at a moment."""
    return F.timestamp_diff("HOUR", F.from_utc_timestamp(utc, "America/New_York"), utc)


def shifted_to_utc(raw):
    """The moment that a time names which was moved on by New York's offset: the one whose own
    offset leads back to it; four hours where none does, within a change of the clocks."""
    back = lambda h: raw - F.make_interval(hours=F.lit(h))
    return F.when(offset_hours(back(4)) == 4, back(4)).when(offset_hours(back(5)) == 5, back(5)).otherwise(back(4))


@query("""WITH f AS (SELECT event_id, user_id, ts + CASE WHEN user_id % 3 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 5 HOUR END + CASE WHEN event_id % 10 = 9 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS raw, CASE WHEN event_type IN ('error', 'signup') THEN ts END AS known FROM events),
v AS (SELECT user_id, count(*) AS filings, count(known) AS known, count(*) FILTER (raw = known) AS utc, count(*) FILTER (raw - INTERVAL 5 HOUR = known) AS shifted FROM f GROUP BY user_id)
SELECT user_id, filings::BIGINT AS filings, known::BIGINT AS known, utc::BIGINT AS utc, shifted::BIGINT AS shifted, CASE WHEN utc = 0 AND shifted = 0 THEN NULL WHEN utc >= shifted THEN 'utc' ELSE 'shifted' END AS convention FROM v""")
def time_convention(spark, d):
    """How a filer writes its times, voted on the filings whose true time is known: as UTC, or
    moved on by New York's offset; null where no vote tells. (The month of the table has no
    change of clocks; the tests have.)"""
    e = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.when(F.col("event_id") % 10 == 9, 1).otherwise(0)  # a field that fits neither reading
    moved = F.when(F.col("user_id") % 3 == 0, 0).otherwise(offset_hours(F.col("ts")))
    f = e.select("user_id", (F.col("ts") + F.make_interval(hours=moved + late)).alias("raw"), F.when(F.col("event_type").isin("error", "signup"), F.col("ts")).alias("known"))
    return conventions(f).select("user_id", "filings", "known", "utc", "shifted", "convention")


def conventions(filings):
    """Per user_id the votes of its filings (raw, and known where there is a true time)."""
    vote = lambda c: F.count(F.when(c == F.col("known"), 1))
    v = filings.groupBy("user_id").agg(F.count(F.lit(1)).alias("filings"), F.count("known").alias("known"), vote(F.col("raw")).alias("utc"), vote(shifted_to_utc(F.col("raw"))).alias("shifted"))
    best = F.when((F.col("utc") == 0) & (F.col("shifted") == 0), None).when(F.col("utc") >= F.col("shifted"), "utc").otherwise("shifted")
    return v.withColumn("convention", best)


# --- risk ----------------------------------------------------------------------------------

_RES = [{"r": ln(div("price", lag("price")))}, {"m": "avg(r) OVER (PARTITION BY session)"}, {"e": "r - m"}]
_PAIR = f"{chain(S.GRID, 'grid', *_RES)}, e AS (SELECT symbol, ix, e FROM t2 WHERE e IS NOT NULL AND ix > (SELECT max(ix) FROM cal) - 120)"


@query(f"""{_PAIR} SELECT a.symbol AS a, b.symbol AS b, count(*)::BIGINT AS n, {S.r6('least(0.95, greatest(-0.95, corr(a.e, b.e)))')} AS corr FROM e a JOIN e b ON a.ix = b.ix AND a.symbol < b.symbol GROUP BY ALL HAVING count(*) >= 40""")
def residual_correlation(spark, d):
    """Clipped correlations of residual returns by pair. Pairs are of a small universe of
    names and met by session."""
    g = weekly_grid(spark, d)
    last = F.broadcast(g.agg(F.max("ix").alias("last_ix")))  # one row
    e = apply(g, *_RES).join(last).filter("e is not null and ix > last_ix - 120").select("symbol", "ix", "e")
    a, b = e.select(F.col("symbol").alias("a"), "ix", F.col("e").alias("ea")), e.select(F.col("symbol").alias("b"), "ix", F.col("e").alias("eb"))
    g = a.join(b, "ix").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), correlation("ea", "eb").alias("k")).filter("n >= 40")
    return g.select("a", "b", "n", r6(F.least(F.lit(0.95), F.greatest(F.lit(-0.95), F.col("k")))).alias("corr"))


panel(
    "risk_parts",
    "Per symbol and session: beta to the market, systematic and idiosyncratic variance (the larger of past month and quarter), the charge at a fixed aversion, and a two-factor slope against market and momentum.",
    weekly_grid, S.GRID, "grid",
    [
        {"r": ln(div("price", lag("price"))), "f": f"{div(lag('price'), lag('price', 13))} - 1"},
        {"m": "avg(r) OVER (PARTITION BY session)"},
        {"e": "r - m", "mm": "CASE WHEN r IS NOT NULL THEN m END"},
        {"n": f"count(r) {over(60)}", "cov": f"covar_pop(r, m) {over(60)}", "vm": f"var_pop(mm) {over(60)}", "v4": mean("e", 4, 2, agg="var_pop"), "v13": mean("e", 13, 7, agg="var_pop"), "crf": f"covar_pop(r, f) {over(60)}", "cmf": f"covar_pop(mm, f) {over(60)}", "vf": f"var_pop(CASE WHEN r IS NOT NULL THEN f END) {over(60)}", "nf": f"count(CASE WHEN r IS NOT NULL THEN f END) {over(60)}"},
        {"beta": f"CASE WHEN n >= 40 THEN {div('cov', 'vm')} END", "idio": "greatest(v4, v13)"},
        {"charge": "5.0 * (beta * beta * vm + idio)", "b_mkt": f"CASE WHEN nf >= 40 AND nf = n THEN {div('cov * vf - crf * cmf', 'vm * vf - cmf * cmf')} END", "b_mom": f"CASE WHEN nf >= 40 AND nf = n THEN {div('crf * vm - cov * cmf', 'vm * vf - cmf * cmf')} END"},
    ],
    ["symbol", "ix"], ["beta", "idio", "charge", "b_mkt", "b_mom"],
)

rules(
    "time_zones",
    "A wall-clock time shifted by New York's offset put back to UTC across the change of clocks, and an epoch's offset in hours.",
    "events", ["event_id"],
    {"m": "month(ts)::INT", "d": "day(ts)::INT", "h": "hour(ts)::INT", "dow": "(isodow(ts))::INT"},
    {"sunday": "d - dow % 7"},
    {"summer": "CASE WHEN m BETWEEN 4 AND 10 THEN true WHEN m = 3 THEN sunday >= 8 AND NOT (dow = 7 AND d <= 14 AND h < 2) WHEN m = 11 THEN NOT (sunday >= 1) OR (dow = 7 AND d <= 7 AND h < 2) ELSE false END"},
    {"offset_hours": "CASE WHEN summer THEN 4 ELSE 5 END"},
    {"utc": "ts + CASE WHEN summer THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END", "broker_day": "(ts - INTERVAL 13 HOUR)::DATE"},
    plain=("offset_hours", "utc", "broker_day"),
)
