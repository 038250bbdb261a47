"""Multi-level aggregates, set operations, pivots, splits and training-data relations."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import xsection as X
from ..sources import views as V
from . import sql as S
from .catalog import query


def _slots(spark, d):
    return V.ticks(spark, d).select("event_type", F.hour("ts").alias("slot"), "price", "symbol")


@query(f"""WITH {S.TICKS} SELECT event_type, hour(ts)::INT AS slot, grouping(event_type, hour(ts))::INT AS level, count(*)::BIGINT AS n, {S.r6('avg(price)')} AS mean FROM ticks GROUP BY ROLLUP (event_type, hour(ts))""")
def rollup_slot_all(spark, d):
    """Means by type and hour, by type, and over all."""
    return _slots(spark, d).rollup("event_type", "slot").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), r6(F.avg("price")).alias("mean"))


@query(f"""WITH {S.FILLS} SELECT sleeve, side, grouping(sleeve, side)::INT AS level, count(*)::BIGINT AS n, sum(shares)::BIGINT AS shares, sum(cents)::BIGINT AS cents FROM fills GROUP BY CUBE (sleeve, side)""")
def cube_metrics(spark, d):
    return V.fills(spark, d).cube("sleeve", "side").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("shares").alias("shares"), F.sum("cents").alias("cents"))


@query("""SELECT r_name, c_mktsegment, grouping(r_name, c_mktsegment)::INT AS level, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), (c_mktsegment), ())""")
def grouping_sets(spark, d):
    c, n, r = (V.table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    a, b = F.col("r_name"), F.col("c_mktsegment")
    return j.select("r_name", "c_mktsegment").groupingSets([[a], [b], []], a, b).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"""WITH {S.TICKS} SELECT symbol, {', '.join(f"count(*) FILTER (event_type = '{t}')::BIGINT AS n_{t}" for t in _TYPES)} FROM ticks GROUP BY symbol""")
def pivot_horizon(spark, d):
    """One column a type; the values are named, so no pass is spent finding them."""
    p = V.ticks(spark, d).groupBy("symbol").pivot("event_type", list(_TYPES)).count()
    return p.select("symbol", *[F.coalesce(t, F.lit(0)).cast("long").alias(f"n_{t}") for t in _TYPES])


@query(f"""WITH {S.TICKS}, s AS (SELECT symbol, count(*) AS n, max(price) AS top FROM ticks GROUP BY symbol), t AS (SELECT *, symbol % 5 AS grp, ntile(3) OVER (PARTITION BY symbol % 5 ORDER BY n, symbol) AS tercile FROM s)
SELECT grp::BIGINT AS grp, tercile::INT AS tercile, count(*)::BIGINT AS symbols, sum(n)::BIGINT AS n, max(top) AS top FROM t GROUP BY grp, tercile""")
def stratified_terciles(spark, d):
    s = V.ticks(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("top")).withColumn("grp", F.col("symbol") % 5)
    s = s.withColumn("tercile", F.ntile(3).over(W.partitionBy("grp").orderBy("n", "symbol")))
    return s.groupBy("grp", "tercile").agg(F.count(F.lit(1)).alias("symbols"), F.sum("n").alias("n"), F.max("top").alias("top"))


@query(f"""WITH {S.BARS}, late AS (SELECT symbol, session, c, 1 AS src FROM bars WHERE session >= DATE '2024-01-10'), early AS (SELECT symbol, session, o AS c, 2 AS src FROM bars WHERE session <= DATE '2024-01-20')
SELECT symbol, session, c, src FROM (SELECT * FROM late UNION ALL SELECT * FROM early) QUALIFY row_number() OVER (PARTITION BY symbol, session ORDER BY src) = 1""")
def union_priority(spark, d):
    """Two sources of a bar; the first has priority where both have it."""
    b = V.bars_daily(spark, d)
    late = b.filter("session >= date'2024-01-10'").select("symbol", "session", "c", F.lit(1).alias("src"))
    early = b.filter("session <= date'2024-01-20'").select("symbol", "session", F.col("o").alias("c"), F.lit(2).alias("src"))
    best = F.min(F.struct("src", "c")).alias("b")
    return late.unionByName(early).groupBy("symbol", "session").agg(best).select("symbol", "session", "b.c", "b.src")


@query(f"""WITH {S.TICKS}, a AS (SELECT DISTINCT symbol, ts::DATE AS session FROM ticks WHERE event_type = 'purchase'), b AS (SELECT DISTINCT symbol, ts::DATE AS session FROM ticks WHERE event_type = 'error')
SELECT 'both' AS part, * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_purchase', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def except_intersect(spark, d):
    t = V.ticks(spark, d).select("symbol", F.to_date("ts").alias("session"), "event_type")
    a, b = (t.filter(F.col("event_type") == k).drop("event_type") for k in ("purchase", "error"))
    tag = lambda df, n: df.select(F.lit(n).alias("part"), "symbol", "session")
    return tag(a.intersect(b), "both").unionByName(tag(a.subtract(b), "only_purchase"))


@query("""SELECT c_custkey, 'active' AS state FROM customer SEMI JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_custkey, 'idle' FROM customer ANTI JOIN orders ON o_custkey = c_custkey""")
def semi_anti(spark, d):
    """Customers with and without orders: one left join on the distinct keys."""
    c, o = V.table(spark, d, "customer").select("c_custkey"), V.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    on = o.distinct().withColumn("has", F.lit(1))
    return c.join(on, "c_custkey", "left").select("c_custkey", F.when(F.col("has") == 1, "active").otherwise("idle").alias("state"))


_ROLL = f"""{S.TICKS}, looks AS (SELECT symbol AS grp, event_type AS member, ts, event_id, price AS reward, row_number() OVER (PARTITION BY symbol, event_type ORDER BY ts) AS look FROM ticks)"""


def looks(spark, d):
    w = W.partitionBy("grp", "member").orderBy("ts")
    t = V.ticks(spark, d).select(F.col("symbol").alias("grp"), F.col("event_type").alias("member"), "ts", "event_id", F.col("price").alias("reward"))
    return t.withColumn("look", F.row_number().over(w))


@query(f"""WITH {_ROLL}, m AS (SELECT grp, member, avg(reward) AS r FROM looks GROUP BY ALL) SELECT grp, member, {S.r6('r')} AS r,
{S.r6('CASE WHEN count(*) OVER g >= 3 THEN r - avg(r) OVER g END')} AS advantage, {S.r6('CASE WHEN count(*) OVER g >= 3 AND stddev_pop(r) OVER g > 0 THEN (r - avg(r) OVER g) / stddev_pop(r) OVER g END')} AS scaled FROM m WINDOW g AS (PARTITION BY grp)""")
def group_advantage(spark, d):
    """Each member's reward less its group's mean; a group under three members is void."""
    m = looks(spark, d).groupBy("grp", "member").agg(F.avg("reward").alias("r"))
    g = W.partitionBy("grp")
    ok = F.count(F.lit(1)).over(g) >= 3
    dev = F.col("r") - F.avg("r").over(g)
    sd = F.stddev_pop("r").over(g)
    return m.select("grp", "member", r6(F.col("r")).alias("r"), r6(F.when(ok, dev)).alias("advantage"), r6(F.when(ok & (sd > 0), dev / sd)).alias("scaled"))


@query(f"""WITH {_ROLL} SELECT event_id, look::INT AS look, {S.r6('sum(reward) OVER (PARTITION BY grp, member ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS rtg FROM looks""")
def rtg_reverse_cumsum(spark, d):
    """Reward to go: the sum from each look to the end."""
    w = W.partitionBy("grp", "member").orderBy("ts").rowsBetween(0, W.unboundedFollowing)
    return looks(spark, d).select("event_id", "look", r6(F.sum("reward").over(w)).alias("rtg"))


@query(f"""WITH {_ROLL}, m AS (SELECT grp, member, sum(reward) AS r FROM looks GROUP BY ALL), q AS (SELECT grp, quantile_cont(r, 0.5) AS mid FROM m GROUP BY grp)
SELECT grp, member, {S.r6('r')} AS r FROM m JOIN q USING (grp) WHERE r > mid""")
def selection_above_median(spark, d):
    """Members whose sum is above their group's median. Sums are made once: made again, in
    another order, the middle one could differ from itself in its last bit."""
    m = looks(spark, d).groupBy("grp", "member").agg(F.sum("reward").alias("r"))
    q = m.withColumn("mid", F.percentile("r", 0.5).over(W.partitionBy("grp")))
    return q.filter("r > mid").select("grp", "member", r6(F.col("r")).alias("r"))


@query("""WITH j AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq, sha256(event_id::VARCHAR || ':' || event_type || ':' || props) AS rec FROM events),
c AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'broken' ELSE coalesce(lag(rec) OVER w, 'genesis') END AS prev_said, coalesce(lag(rec) OVER w, 'genesis') AS prev_true FROM j WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT user_id, count(*)::BIGINT AS rows, count(*) FILTER (prev_said <> prev_true)::BIGINT AS broken, min(seq) FILTER (prev_said <> prev_true)::INT AS first_broken, arg_max(rec, seq) AS head FROM c GROUP BY user_id""")
def hash_chain_check(spark, d):
    """Each journal row must name the hash of the one before it; where a chain first breaks."""
    w = W.partitionBy("user_id").orderBy("ts")
    e = V.table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("seq"), F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), "event_type", "props"), 256).alias("rec"))
    true = F.coalesce(F.lag("rec").over(W.partitionBy("user_id").orderBy("seq")), F.lit("genesis"))
    c = e.withColumn("true", true).withColumn("said", F.when(F.col("event_id") % 97 == 0, "broken").otherwise(F.col("true")))
    bad = F.col("said") != F.col("true")
    return c.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(bad, 1)).alias("broken"), F.min(F.when(bad, F.col("seq"))).alias("first_broken"), F.max_by("rec", "seq").alias("head"))


@query(f"""WITH {S.WEEKLY}, {S.CAL}, e AS (SELECT symbol, ix, (ix // 30)::INT AS fold FROM weekly JOIN cal USING (session))
SELECT symbol, ix::BIGINT AS ix, CASE WHEN fold % 4 = 3 THEN 'test' WHEN (ix + 5) // 30 % 4 = 3 OR (ix - 5) // 30 % 4 = 3 THEN 'purged' ELSE 'train' END AS split FROM e""")
def purged_split(spark, d):
    """Train and test blocks of sessions, with five sessions purged on both sides of a test block."""
    e = V.indexed(V.weekly(spark, d).select("symbol", "session"))
    test = lambda ix: F.floor(ix / 30) % 4 == 3
    ix = F.col("ix")
    split = F.when(test(ix), "test").when(test(ix + 5) | ((ix >= 5) & test(ix - 5)), "purged").otherwise("train")
    return e.select("symbol", "ix", split.alias("split"))


@query("""WITH p AS (SELECT p_brand, p_type, p_size, p_retailprice, p_partkey FROM part) SELECT p_brand, p_partkey, p_retailprice, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM p WHERE p_size BETWEEN 10 AND 40) WHERE rank <= 5""")
def scan_static_top(spark, d):
    """Top five a brand among parts of a size: a filter that reaches the scan, then a top-k."""
    p = V.table(spark, d, "part").filter("p_size between 10 and 40").select("p_brand", "p_partkey", "p_retailprice")
    return X.top_k(p, "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], 5)
