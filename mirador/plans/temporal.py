"""Point-in-time joins, visibility, calendars and event studies."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import rolling as R
from ..operators import temporal as T
from ..sources import views as V
from . import sql as S
from .catalog import query

_DEC = f"{S.TICKS}, dec AS (SELECT * FROM ticks WHERE event_type = 'purchase'), fil AS (SELECT * FROM ticks WHERE event_type = 'signup'), err AS (SELECT * FROM ticks WHERE event_type = 'error')"


def _events(spark, d, kind):
    return V.ticks(spark, d).filter(F.col("event_type") == kind).select("symbol", "ts", "event_id", "price")


@query(f"""WITH {_DEC} SELECT d.event_id, d.symbol, d.ts, f.event_id AS asof_event_id, f.price AS asof_price, f.ts AS asof_time
FROM dec d ASOF LEFT JOIN fil f ON d.symbol = f.symbol AND d.ts > f.ts""")
def asof_backward(spark, d):
    """The latest signup strictly before each purchase."""
    got = T.asof(_events(spark, d, "purchase").drop("price"), _events(spark, d, "signup"), "symbol", "ts", ["event_id", "price"])
    return got.select("event_id", "symbol", "ts", "asof_event_id", "asof_price", "asof_time")


@query(f"""WITH {_DEC}, j AS (SELECT d.event_id, d.symbol, d.ts, f.event_id AS fid, f.ts AS ft FROM dec d ASOF LEFT JOIN fil f ON d.symbol = f.symbol AND d.ts > f.ts)
SELECT event_id, symbol, ts, CASE WHEN ft >= ts - INTERVAL 1 DAY THEN fid END AS asof_event_id, CASE WHEN ft >= ts - INTERVAL 1 DAY THEN ft END AS asof_time FROM j""")
def asof_tolerance(spark, d):
    """The same, no older than a day."""
    got = T.asof(_events(spark, d, "purchase").drop("price"), _events(spark, d, "signup"), "symbol", "ts", ["event_id"], tolerance="1 DAY")
    return got.select("event_id", "symbol", "ts", "asof_event_id", "asof_time")


_WIN = {"n1": 1, "n5": 5, "n21": 21}


@query(f"""WITH {_DEC} SELECT d.event_id, d.symbol, {', '.join(f"count(f.ts) FILTER (f.ts >= d.ts - INTERVAL {k} DAY)::BIGINT AS {n}" for n, k in _WIN.items())}
FROM dec d LEFT JOIN err f ON f.symbol = d.symbol AND f.ts < d.ts AND f.ts >= d.ts - INTERVAL 21 DAY GROUP BY d.event_id, d.symbol""")
def interval_counts(spark, d):
    """Errors in the day, week and month before each purchase."""
    got = T.interval_counts(_events(spark, d, "purchase"), _events(spark, d, "error"), "symbol", "ts", _WIN)
    return got.select("event_id", "symbol", *_WIN)


@query(f"""WITH {_DEC}, c AS (SELECT d.event_id, count(f.ts) AS n, count(g.ts) AS m FROM dec d LEFT JOIN err f ON f.symbol = d.symbol AND f.ts < d.ts AND f.ts >= d.ts - INTERVAL 2 DAY
LEFT JOIN fil g ON g.symbol = d.symbol AND g.ts < d.ts AND g.ts >= d.ts - INTERVAL 2 DAY GROUP BY d.event_id)
SELECT event_id, (n > 0)::INT AS had_error, (m > 0)::INT AS had_signup, (n > 0 AND m > 0)::INT AS had_both FROM c""")
def interval_flags(spark, d):
    a = T.interval_counts(_events(spark, d, "purchase"), _events(spark, d, "error"), "symbol", "ts", {"n": 2})
    b = T.interval_counts(a, _events(spark, d, "signup"), "symbol", "ts", {"m": 2})
    flag = lambda c: c.cast("int")
    return b.select("event_id", flag(F.col("n") > 0).alias("had_error"), flag(F.col("m") > 0).alias("had_signup"), flag((F.col("n") > 0) & (F.col("m") > 0)).alias("had_both"))


_VINTAGE = f"""{S.TICKS}, vin AS (SELECT symbol, event_type, price, ts AS rs, lead(ts) OVER (PARTITION BY symbol, event_type ORDER BY ts) AS nx FROM ticks),
noon AS (SELECT symbol, session + INTERVAL 12 HOUR AS t FROM (SELECT DISTINCT symbol, ts::DATE AS session FROM ticks WHERE event_type = 'view'))"""


@query(f"""WITH {_VINTAGE} SELECT vin.symbol, event_type, t AS at_time, price FROM vin JOIN noon USING (symbol) WHERE rs <= t AND t <= coalesce(nx - INTERVAL 1 MICROSECOND, t)""")
def bitemporal_asof(spark, d):
    """Every series' value as it stood at noon of the days with a view (validity is a closed interval)."""
    t = V.ticks(spark, d)
    nx = F.lead("ts").over(W.partitionBy("symbol", "event_type").orderBy("ts"))
    vin = t.select("symbol", "event_type", "price", F.col("ts").alias("rs"), (nx - F.expr("INTERVAL '0.000001' SECOND")).alias("re"))
    noon = F.to_date("ts").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
    at = t.filter("event_type = 'view'").select("symbol", noon.alias("t")).distinct()
    got = T.bitemporal(vin, at, "symbol", ["event_type"], "t", "rs", "re", ["price"])
    return got.select("symbol", "event_type", F.col("t").alias("at_time"), "price")


@query(f"""WITH {_DEC} SELECT d.event_id, count(f.ts)::BIGINT AS visible, max(f.ts) AS newest, {S.r6('avg(f.price)')} AS mean FROM dec d JOIN fil f ON f.symbol = d.symbol AND f.ts < d.ts GROUP BY d.event_id""")
def visible_before(spark, d):
    """What is known strictly before a decision: running sums over one sorted union."""
    p, f = _events(spark, d, "purchase"), _events(spark, d, "signup")
    both = p.select("symbol", "ts", "event_id", F.lit(None).cast("double").alias("price"), F.lit(None).cast("timestamp_ntz").alias("seen"), F.lit(0).alias("k"))
    both = both.unionByName(f.select("symbol", "ts", F.lit(None).cast("bigint").alias("event_id"), "price", F.col("ts").alias("seen"), F.lit(1).alias("k")))
    w = W.partitionBy("symbol").orderBy("ts", "k").rowsBetween(W.unboundedPreceding, 0)
    got = both.select("event_id", "k", F.sum("k").over(w).alias("visible"), F.max("seen").over(w).alias("newest"), r6(F.avg("price").over(w)).alias("mean"))
    return got.filter("k = 0 and visible > 0").select("event_id", "visible", "newest", "mean")


_SINCE = f"{S.BARS}, cal AS (SELECT session, row_number() OVER (ORDER BY session) - 1 AS ix FROM (SELECT DISTINCT session FROM bars))"


@query(f"""WITH {_SINCE}, ev AS (SELECT DISTINCT symbol, ts::DATE AS session FROM ticks WHERE event_type = 'error')
SELECT b.symbol, b.session, (cal.ix - max(ec.ix))::BIGINT AS since FROM bars b JOIN cal ON cal.session = b.session
LEFT JOIN ev ON ev.symbol = b.symbol AND ev.session <= b.session LEFT JOIN cal ec ON ec.session = ev.session GROUP BY b.symbol, b.session, cal.ix""")
def sessions_since_event(spark, d):
    """Sessions since the symbol's last error, by index difference."""
    bars = V.indexed(V.bars_daily(spark, d).select("symbol", "session"))
    ev = _events(spark, d, "error").select("symbol", F.to_date("ts").alias("session"), F.lit(1).alias("e")).distinct()
    j = bars.join(ev, ["symbol", "session"], "left")
    last = F.max(F.when(F.col("e") == 1, F.col("ix"))).over(W.partitionBy("symbol").orderBy("ix").rowsBetween(W.unboundedPreceding, 0))
    return j.select("symbol", "session", (F.col("ix") - last).alias("since"))


@query(f"""WITH {S.TICKS}, s AS (SELECT symbol, ts, event_id, price - lag(price) OVER (PARTITION BY symbol, event_type ORDER BY ts) AS surprise, event_type FROM ticks),
m AS (SELECT *, quantile_cont(abs(surprise), 0.5) OVER w AS mad, count(surprise) OVER w AS n FROM s WINDOW w AS (PARTITION BY symbol, event_type ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, {S.r6('CASE WHEN n >= 4 AND mad > 0 THEN surprise / mad END')} AS z FROM m WHERE surprise IS NOT NULL""")
def surprise_mad(spark, d):
    """Each surprise over the median size of the earlier ones (expanding, at least four)."""
    w = W.partitionBy("symbol", "event_type").orderBy("ts")
    s = V.ticks(spark, d).select("symbol", "event_type", "ts", "event_id", (F.col("price") - F.lag("price").over(w)).alias("surprise"))
    s = R.earlier_median(s.withColumn("size", F.abs("surprise")), ["symbol", "event_type"], ["ts"], "size", "mad")
    return s.filter("surprise is not null").select("event_id", r6(F.when((F.col("mad_n") >= 4) & (F.col("mad") > 0), F.col("surprise") / F.col("mad"))).alias("z"))


@query(f"""WITH {S.TICKS}, m AS (SELECT event_id, quantile_cont(price, 0.5) OVER w AS mid, count(price) OVER w AS n FROM ticks WINDOW w AS (PARTITION BY symbol, event_type ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT event_id, {S.r6('CASE WHEN n >= 4 THEN mid END')} AS usual FROM m""")
def reaction_history_median8(spark, d):
    """Median of the last eight reactions, at least four."""
    w = W.partitionBy("symbol", "event_type").orderBy("ts").rowsBetween(-8, -1)
    m = V.ticks(spark, d).select("event_id", F.percentile("price", 0.5).over(w).alias("mid"), F.count("price").over(w).alias("n"))
    return m.select("event_id", r6(F.when(F.col("n") >= 4, F.col("mid"))).alias("usual"))


@query(f"""WITH {S.TICKS}, s AS (SELECT symbol, width_bucket, avg(1.0 * (price > 20 * width_bucket)::INT) AS p FROM ticks CROSS JOIN (SELECT unnest(range(1, 11)) AS width_bucket) GROUP BY ALL),
m AS (SELECT symbol, width_bucket, min(p) OVER (PARTITION BY symbol ORDER BY width_bucket) AS surv FROM s)
SELECT symbol, (width_bucket * 20)::INT AS strike, {S.r6('surv')} AS survival, {S.r6('surv - coalesce(lead(surv) OVER (PARTITION BY symbol ORDER BY width_bucket), 0)')} AS mass FROM m""".replace("1.0 * ", ""))
def survival_ladder(spark, d):
    """P(price > strike) made falling by a running minimum, and the mass between strikes."""
    strikes = F.explode(F.sequence(F.lit(1), F.lit(10)))
    s = V.ticks(spark, d).select("symbol", "price", strikes.alias("k")).groupBy("symbol", "k").agg(F.avg((F.col("price") > 20 * F.col("k")).cast("int")).alias("p"))
    w = W.partitionBy("symbol").orderBy("k")
    m = s.withColumn("surv", F.min("p").over(w))
    return m.select("symbol", (F.col("k") * 20).alias("strike"), r6(F.col("surv")).alias("survival"), r6(F.col("surv") - F.coalesce(F.lead("surv").over(w), F.lit(0.0))).alias("mass"))


@query("""WITH days AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS day), b AS (SELECT day, row_number() OVER (PARTITION BY year(day), month(day) ORDER BY day) AS nth
FROM days WHERE isodow(day) <= 5 AND NOT (month(day) = 1 AND day(day) = 1) AND NOT (month(day) = 12 AND day(day) = 25) AND NOT (month(day) = 7 AND day(day) = 4)),
f AS (SELECT year(day) AS y, month(day) AS m, max(day) FILTER (nth = 1) AS first_day, max(day) FILTER (nth = 3) AS third_day, max(day) AS last_day FROM b GROUP BY ALL),
o AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*)::BIGINT AS n FROM orders GROUP BY ALL)
SELECT f.y::INT AS y, f.m::INT AS m, first_day, third_day, last_day, coalesce(n, 0)::BIGINT AS n FROM f LEFT JOIN o USING (y, m)""")
def nth_business_day(spark, d):
    """A calendar by rule: first, third and last business day of each month."""
    days = spark.sql("SELECT explode(sequence(DATE '1995-01-01', DATE '2001-12-31')) AS day").withColumns({"y": F.year("day"), "m": F.month("day"), "dd": F.dayofmonth("day")})
    b = days.filter("weekday(day) < 5 and not (m = 1 and dd = 1) and not (m = 12 and dd = 25) and not (m = 7 and dd = 4)")
    b = b.withColumn("nth", F.row_number().over(W.partitionBy("y", "m").orderBy("day")))
    pick = lambda k: F.max(F.when(F.col("nth") == k, F.col("day")))
    f = b.groupBy("y", "m").agg(pick(1).alias("first_day"), pick(3).alias("third_day"), F.max("day").alias("last_day"))
    o = V.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return f.join(o, ["y", "m"], "left").select("y", "m", "first_day", "third_day", "last_day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("""SELECT event_id, floor(epoch(ts AT TIME ZONE 'America/New_York'))::BIGINT AS utc_epoch, hour(timezone('America/New_York', timezone('UTC', ts)))::INT AS local_hour FROM events""")
def dst_epoch(spark, d):
    """Wall-clock New York times to epochs, and UTC times to New York hours."""
    ts = F.col("ts").cast("timestamp")
    return V.table(spark, d, "events").select("event_id", F.unix_timestamp(F.to_utc_timestamp(ts, "America/New_York")).alias("utc_epoch"), F.hour(F.from_utc_timestamp(ts, "America/New_York")).alias("local_hour"))


@query(f"""WITH {S.TICKS} SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS slot FROM ticks""")
def log_carry_forward(spark, d):
    """Each log row with the latest start marker before it."""
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    return V.ticks(spark, d).select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True).over(w).alias("slot"))
