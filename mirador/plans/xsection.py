"""Cross-sectional queries: ranks, groups, portfolios, scanners."""

from pyspark.sql import functions as F

from ..functions.scalars import r6, ratio
from ..operators import xsection as X
from ..sources import views as V
from . import sql as S
from .bars import weekly_returns
from .catalog import ORACLES, QUERIES, query


@query(f"""WITH {S.RET}, n AS (SELECT *, count(r) OVER (PARTITION BY session) AS n FROM ret)
SELECT symbol, session, {S.r6('CASE WHEN r IS NOT NULL AND n > 10 THEN (row_number() OVER (PARTITION BY session ORDER BY r NULLS LAST, symbol) - 1) / (n - 1) - 0.5 END')} AS pct FROM n""")
def rank_pct(spark, d):
    return weekly_returns(spark, d).select("symbol", "session", r6(X.rank_pct("r")).alias("pct"))


@query(f"""WITH {S.BARS} SELECT symbol, session, {S.r6('rank() OVER (PARTITION BY session ORDER BY v) + (count(*) OVER (PARTITION BY session, v) - 1) / 2')} AS avg_rank FROM bars""")
def rank_avg(spark, d):
    """Average ranks of a column full of ties."""
    return V.bars_daily(spark, d).select("symbol", "session", r6(X.rank_average("v", ["session"])).alias("avg_rank"))


@query(f"""WITH {S.RET}, a AS (SELECT session, symbol, r, n_regionkey < 4 AS ref FROM ret JOIN nation ON n_nationkey = symbol WHERE r IS NOT NULL)
SELECT a.session, a.symbol, {S.r6('least(greatest((sum((x.r < a.r)::INT) + sum((x.r <= a.r)::INT) - any_value(a.ref)::INT) / 2 / (count(*) - 1), 0), 1) - 0.5')} AS pct
FROM a JOIN a x ON a.session = x.session AND x.ref GROUP BY a.session, a.symbol, a.r HAVING count(*) >= 20""")
def xrank_external(spark, d):
    """Place of every symbol's return in a reference group (regions 0 to 3), members and
    others alike: the middle of its left and right insertion, from 20 references up. Counts
    come from the sorted union rather than a join of all with all."""
    from pyspark.sql import Window as W

    p = weekly_returns(spark, d).filter("r is not null").join(F.broadcast(V.regions(spark, d)), "symbol").withColumn("ref", (F.col("region") < 4).cast("int"))
    upto = F.sum("ref").over(W.partitionBy("session").orderBy("r").rangeBetween(W.unboundedPreceding, 0))
    same, n = F.sum("ref").over(W.partitionBy("session", "r")), F.sum("ref").over(W.partitionBy("session"))
    p = p.withColumns({"upto": upto, "same": same, "n": n}).filter("n >= 20")
    middle = (F.col("upto") - F.col("same") + F.col("upto") - F.col("ref")) / 2 / (F.col("n") - 1)
    return p.select("session", "symbol", r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), middle)) - 0.5).alias("pct"))


@query(f"""WITH {S.RET}, g AS (SELECT symbol, session, r, n_regionkey AS region FROM ret JOIN nation ON n_nationkey = symbol),
x AS (SELECT *, count(r) OVER w - (r IS NOT NULL)::INT AS n, sum(r) OVER w AS s, avg(r) OVER w AS m FROM g WINDOW w AS (PARTITION BY session, region))
SELECT symbol, session, {S.r6('CASE WHEN n > 0 THEN (s - coalesce(r, 0)) / n END')} AS others, {S.r6('r - m')} AS demeaned FROM x""")
def loo_group_mean(spark, d):
    """Mean of the other members of the region, and the return less the region's mean."""
    p = weekly_returns(spark, d).join(F.broadcast(V.regions(spark, d)), "symbol")
    return p.select("symbol", "session", r6(X.leave_one_out("r", "session", "region")).alias("others"), r6(X.demean("r", "session", "region")).alias("demeaned"))


_SCORED = f"""{S.GRID}, scored AS (SELECT symbol, session, price / nullif(lag(price, 4) OVER w, 0) - 1 AS score, lead(price) OVER w / nullif(price, 0) - 1 AS y FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY ix)),
used AS (SELECT * FROM scored WHERE score IS NOT NULL AND y IS NOT NULL)"""


def scored(spark, d):
    """Four-session momentum as a score and the next session's return as the outcome."""
    from ..operators import rolling as R

    g = V.aligned(V.weekly(spark, d))
    g = g.withColumns({"score": ratio(F.col("price"), R.lag("price", 4)) - 1, "y": ratio(F.lead("price", 1).over(R.by()), F.col("price")) - 1})
    return g.filter("score is not null and y is not null").select("symbol", "session", "ix", "score", "y")


def _spread_sql(share: float) -> str:
    return f"""WITH {_SCORED}, cut AS (SELECT session, quantile_cont(score, {1 - share}) AS hi, quantile_cont(score, {share}) AS lo, count(*) AS n FROM used GROUP BY session HAVING count(*) >= 10)
SELECT session, {S.r6('avg(y) FILTER (score >= hi)')} AS top, {S.r6('avg(y) FILTER (score <= lo)')} AS low, {S.r6('avg(y) FILTER (score >= hi) - avg(y) FILTER (score <= lo)')} AS spread, any_value(n)::BIGINT AS n
FROM used JOIN cut USING (session) GROUP BY session"""


def _spread(spark, d, share):
    s = X.spread(scored(spark, d), "session", "score", "y", share, 10)
    return s.select("session", *[r6(F.col(c)).alias(c) for c in ("top", "low", "spread")], "n")


@query(_spread_sql(0.1))
def decile_spread(spark, d):
    return _spread(spark, d, 0.1)


@query(_spread_sql(0.2))
def quintile_long_short(spark, d):
    return _spread(spark, d, 0.2)


@query(f"""WITH {S.RET} SELECT session, count(r)::BIGINT AS n, {S.r6('avg((r > 0)::INT)')} AS breadth, {S.r6('stddev_pop(r)')} AS dispersion, {S.r6('quantile_cont(r, 0.5)')} AS mid FROM ret WHERE r IS NOT NULL GROUP BY session""")
def breadth_dispersion(spark, d):
    p = weekly_returns(spark, d).filter("r is not null")
    return p.groupBy("session").agg(F.count("r").alias("n"), r6(F.avg((F.col("r") > 0).cast("int"))).alias("breadth"), r6(F.stddev_pop("r")).alias("dispersion"), r6(F.percentile("r", 0.5)).alias("mid"))


#: Scans of the last session: name, the value of a symbol, whether the largest come first.
_SCANS = {
    "gain_1": ("price / nullif(p1, 0) - 1", True), "loss_1": ("price / nullif(p1, 0) - 1", False), "gain_4": ("price / nullif(p4, 0) - 1", True), "loss_4": ("price / nullif(p4, 0) - 1", False),
    "gain_13": ("price / nullif(p13, 0) - 1", True), "loss_13": ("price / nullif(p13, 0) - 1", False), "gain_52": ("price / nullif(p52, 0) - 1", True), "loss_52": ("price / nullif(p52, 0) - 1", False),
    "volume": ("double(v)", True), "quiet": ("double(v)", False), "volume_ratio": ("v / nullif(v13, 0)", True), "dry_volume": ("v / nullif(v13, 0)", False), "value": ("price * v", True),
    "range": ("h / nullif(l, 0) - 1", True), "narrow": ("h / nullif(l, 0) - 1", False), "near_high": ("price / nullif(h52, 0)", True), "near_low": ("price / nullif(l52, 0)", False), "price": ("price", True),
    "cheap": ("price", False), "vol": ("vol13", True), "calm": ("vol13", False),
}


def _scan(name: str, value: str, most: bool):
    sql_value = value.replace("double(v)", "v::DOUBLE")
    f13, f52, by = S.frame(13), S.frame(52), "(PARTITION BY symbol ORDER BY ix)"
    sql = f"""WITH {S.RET}, f AS (SELECT *, {', '.join(f'lag(price, {n}) OVER {by} AS p{n}' for n in (1, 4, 13, 52))}, avg(v) OVER {f13} AS v13, stddev_samp(r) OVER {f13} AS vol13,
max(h) OVER {f52} AS h52, min(l) OVER {f52} AS l52 FROM ret), z AS (SELECT symbol, {S.r6(sql_value)} AS val FROM f WHERE ix = (SELECT max(ix) - 3 FROM ret))
SELECT symbol, val, row_number() OVER (ORDER BY val {'DESC' if most else 'ASC'}, symbol)::INT AS place FROM z WHERE val IS NOT NULL QUALIFY place <= 10"""

    def run(spark, d):
        from pyspark.sql import Window as W

        from ..operators import rolling as R

        p = weekly_returns(spark, d)
        w13, w52 = R.frame(13), R.frame(52)
        f = p.withColumns({f"p{n}": R.lag("price", n) for n in (1, 4, 13, 52)} | {"v13": F.avg("v").over(w13), "vol13": F.stddev_samp("r").over(w13), "h52": F.max("h").over(w52), "l52": F.min("l").over(w52)})
        last = p.agg((F.max("ix") - 3).alias("ix"))
        z = f.join(F.broadcast(last), "ix").select("symbol", r6(F.expr(value)).alias("val")).filter("val is not null")
        order = [F.desc("val") if most else F.asc("val"), F.asc("symbol")]
        # the ten are few, so their numbering is no load on one task
        return z.orderBy(*order).limit(10).withColumn("place", F.row_number().over(W.orderBy(*order)))

    QUERIES[f"scanner_{name}"], ORACLES[f"scanner_{name}"] = run, sql


for _name, (_value, _most) in _SCANS.items():
    _scan(_name, _value, _most)
