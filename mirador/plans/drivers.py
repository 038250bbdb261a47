"""Whole studies: today's scores, final fits, validation cards, questions and base rates."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import correlation, r6, ratio
from ..operators import models as M
from ..sources.staging import staged
from . import sql as S
from .catalog import query
from .estimators import _SQL, _XS, _Z, _feats, _standardized
from .stages import ahead, apply, chain, daily_grid, div, lag, ln, mean, rank, weekly_grid

# --- today ---------------------------------------------------------------------------------

_SCORES = [
    {"r": ln(div("price", lag("price")))},
    {"trend": f"{div(lag('price', 4), lag('price', 52))} - 1", "turn": f"1 - {div('price', lag('price', 4))}", "calm": f"-({mean('r', 13, 7, agg='stddev_samp')})", "heavy": ln(mean("price * v", 13, 7))},
    {f"{n}_rk": rank(n, 5) for n in ("trend", "turn", "calm", "heavy")},
    {"blend": "(trend_rk + turn_rk + calm_rk) / 3e0"},
]
_VARIANTS = {"trend": "trend_rk", "turn": "turn_rk", "calm": "calm_rk", "blend": "blend"}


@query(f"""{chain(S.GRID, "grid", *_SCORES)}, u AS ({' UNION ALL '.join(f"SELECT '{n}' AS variant, symbol, ix, {c} AS score FROM t3 WHERE ix = (SELECT max(ix) FROM cal) - 3 AND {c} IS NOT NULL" for n, c in _VARIANTS.items())})
SELECT variant, symbol, {S.r6('score')} AS score, row_number() OVER (PARTITION BY variant ORDER BY score DESC, symbol)::INT AS place, least(9, floor((row_number() OVER (PARTITION BY variant ORDER BY score, symbol) - 1) * 10e0 / count(*) OVER (PARTITION BY variant)))::INT AS decile FROM u""")
def today_scores(spark, d):
    """The last full session's score, place and decile of every symbol, by variant."""
    g = weekly_grid(spark, d)
    last = F.broadcast(g.agg((F.max("ix") - 3).alias("last_ix")))  # one row
    p = apply(g, *_SCORES).join(last).filter("ix = last_ix")
    u = p.select("symbol", *[F.col(c).alias(n) for n, c in _VARIANTS.items()]).unpivot(["symbol"], list(_VARIANTS), "variant", "score").filter("score is not null")
    w = W.partitionBy("variant")
    decile = F.least(F.lit(9), F.floor((F.row_number().over(w.orderBy("score", "symbol")) - 1) * 10.0 / F.count(F.lit(1)).over(w))).cast("int")
    return u.select("variant", "symbol", r6(F.col("score")).alias("score"), F.row_number().over(w.orderBy(F.desc("score"), "symbol")).alias("place"), decile.alias("decile"))


_TARGETS = {"fwd1": f"{div(ahead('price'), 'price')} - 1", "fwd5": f"{div(ahead('price', 5), 'price')} - 1", "size1": f"abs({div(ahead('price'), 'price')} - 1)"}
_FINAL = [*_SCORES[:2], _TARGETS]


@query(f"""{chain(S.GRID, "grid", *_FINAL)}, u AS ({' UNION ALL '.join(f"SELECT '{t}' AS target, turn AS x1, calm AS x2, {t} AS y FROM t2 WHERE turn IS NOT NULL AND calm IS NOT NULL AND {t} IS NOT NULL" for t in _TARGETS)}),
m AS (SELECT target, count(*) AS n, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM u GROUP BY target),
b AS (SELECT *, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m)
SELECT target, n::BIGINT AS n, {S.r6('my - b1 * m1 - b2 * m2')} AS b0, {S.r6('b1')} AS b1, {S.r6('b2')} AS b2 FROM b""")
def final_fits(spark, d):
    """Coefficients over all rows for several targets, from one aggregation by target."""
    p = apply(weekly_grid(spark, d), *_FINAL).select(F.col("turn").alias("x1"), F.col("calm").alias("x2"), *_TARGETS)
    u = p.unpivot(["x1", "x2"], list(_TARGETS), "target", "y").dropna()
    s = M.solve2(M.moments(u, ["x1", "x2"], "y", "target"), "x1", "x2")
    return s.select("target", F.col("one__one").cast("bigint").alias("n"), r6(F.col("b0")).alias("b0"), r6(F.col("b1")).alias("b1"), r6(F.col("b2")).alias("b2"))


_CARD = [*_SCORES, {"y": f"{div(ahead('price'), 'price')} - 1"}]


@query(f"""{chain(S.GRID, "grid", *_CARD)}, u AS ({' UNION ALL '.join(f"SELECT '{n}' AS variant, session, symbol, {c} AS s, y FROM t4 WHERE {c} IS NOT NULL AND y IS NOT NULL" for n, c in _VARIANTS.items())}),
k AS (SELECT *, rank() OVER (PARTITION BY variant, session ORDER BY s) AS a, rank() OVER (PARTITION BY variant, session ORDER BY y) AS b, count(*) OVER (PARTITION BY variant, session) AS n FROM u), day AS (SELECT variant, session, corr(a, b) AS ic, avg(y) FILTER (a > n * 0.8) - avg(y) FILTER (a <= n * 0.2) AS spread FROM k WHERE n >= 6 GROUP BY ALL HAVING stddev_pop(a) > 0 AND stddev_pop(b) > 0)
SELECT variant, count(*)::BIGINT AS days, {S.r6('avg(ic)')} AS ic, {S.r6('avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0)')} AS t, {S.r6('avg(spread)')} AS gross, {S.r6('avg(spread) - 0.001')} AS net, coalesce(avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0) > 2 AND avg(spread) > 0.001, FALSE) AS passed FROM day GROUP BY variant""")
def validation_card(spark, d):
    """Per variant the mean daily rank correlation, its t, the spread before and after costs, and the verdict."""
    p = apply(weekly_grid(spark, d), *_CARD)
    u = p.select("session", "symbol", "y", *[F.col(c).alias(n) for n, c in _VARIANTS.items()]).unpivot(["session", "symbol", "y"], list(_VARIANTS), "variant", "s").dropna()
    w = W.partitionBy("variant", "session")
    k = u.withColumns({"a": F.rank().over(w.orderBy("s")), "b": F.rank().over(w.orderBy("y")), "n": F.count(F.lit(1)).over(w)}).filter("n >= 6")
    top, low = F.avg(F.when(F.col("a") > F.col("n") * 0.8, F.col("y"))), F.avg(F.when(F.col("a") <= F.col("n") * 0.2, F.col("y")))
    day = k.groupBy("variant", "session").agg(correlation("a", "b").alias("ic"), (top - low).alias("spread"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb")).filter("sa > 0 and sb > 0")
    t, gross = ratio(F.avg("ic"), F.stddev_samp("ic") / F.sqrt(F.count(F.lit(1)))), F.avg("spread")
    return day.groupBy("variant").agg(F.count(F.lit(1)).alias("days"), r6(F.avg("ic")).alias("ic"), r6(t).alias("t"), r6(gross).alias("gross"), r6(gross - 0.001).alias("net"), F.coalesce((t > 2) & (gross > 0.001), F.lit(False)).alias("passed"))


# --- estimators that iterate ---------------------------------------------------------------

_TAU, _STEPS = 0.9, 8


def _irls(k: int) -> str:
    """Step k of the quantile fit from q{k-1} (a, b)."""
    return f"""q{k} AS (SELECT (sy * sxx - sx * sxy) / (s * sxx - sx * sx) AS a, (s * sxy - sx * sy) / (s * sxx - sx * sx) AS b FROM (SELECT sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy
FROM (SELECT x, y, CASE WHEN y >= a + b * x THEN {_TAU} ELSE {1 - _TAU} END / greatest(abs(y - a - b * x), 0.001) AS w FROM l, q{k - 1})))"""


@query(f"""{_Z}, l AS (SELECT x2 AS x, abs(t) AS y FROM z), q0 AS (SELECT avg(y) AS a, 0::DOUBLE AS b FROM l), {', '.join(_irls(k) for k in range(1, _STEPS + 1))}
SELECT {S.r6('any_value(a)')} AS a, {S.r6('any_value(b)')} AS b, {S.r6('avg((y <= a + b * x)::INT)')} AS below, {S.r6(f'avg(CASE WHEN y >= a + b * x THEN {_TAU} * (y - a - b * x) ELSE {1 - _TAU} * (a + b * x - y) END)')} AS pinball FROM l, q{_STEPS}""")
def quantile_regression(spark, d):
    """A line at the upper decile by reweighted least squares; a step is one aggregation of
    five sums, and only those reach the driver."""
    lines = staged(_standardized(_feats(spark, d)).select(F.col("x2").alias("x"), F.abs("t").alias("y")), "lines")
    start = lines.agg(F.avg("y").alias("m")).first().m
    a, b = start or 0.0, 0.0
    fit = lambda: F.lit(a) + F.lit(b) * F.col("x")
    for _ in range(_STEPS if start is not None else 0):
        w = F.when(F.col("y") >= fit(), _TAU).otherwise(1 - _TAU) / F.greatest(F.abs(F.col("y") - fit()), F.lit(0.001))
        s = lines.withColumn("w", w).agg(*[F.sum(F.expr(e)).alias(n) for n, e in {"s": "w", "sx": "w * x", "sy": "w * y", "sxx": "w * x * x", "sxy": "w * x * y"}.items()]).first()
        det = (s.s * s.sxx - s.sx * s.sx) if s.sxx is not None else 0.0
        if not det:  # a regressor without spread: no line to fit
            break
        a, b = (s.sy * s.sxx - s.sx * s.sxy) / det, (s.s * s.sxy - s.sx * s.sy) / det
    over = F.col("y") - fit()
    return lines.agg(r6(F.lit(a)).alias("a"), r6(F.lit(b)).alias("b"), r6(F.avg((F.col("y") <= fit()).cast("int"))).alias("below"), r6(F.avg(F.when(over >= 0, _TAU * over).otherwise((_TAU - 1) * over))).alias("pinball"))


@query()
def boosted_forecast(spark, d):
    """Boosted trees trained up to an embargo before the last sessions, forecasts for these: a
    mean, a robust mean (Huber loss) and a probability (least squares of the event, within 0 and 1)."""
    from ..operators import histboost as B

    f = staged(_feats(spark, d).withColumn("rose", (F.col("t") > 0).cast("double")), "features")
    last = f.agg(F.max("ix")).first()[0] or 0
    train, test = f.filter(F.col("ix") < last - 60 - 5), f.filter(F.col("ix") >= last - 60)
    out = test.select("symbol", "ix", "t", *_XS)
    for name, y, loss in (("mean", "t", "l2"), ("robust", "t", "huber"), ("p_rise", "rose", "l2")):
        out = B.fit(train, _XS, y, loss=loss, alpha=0.1, trees=6, depth=3, rate=0.25).predict(out, name)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p_rise")))
    return out.select("symbol", "ix", "t", r6(F.col("mean")).alias("mean"), r6(F.col("robust")).alias("robust"), r6(p).alias("p_rise"))


# --- questions and base rates --------------------------------------------------------------

_ASK = [
    {"r1": mean("abs(ln(c / nullif(o, 0)))", 10, 4, -1), "kind": "CASE WHEN (symbol + ix) % 3 = 0 THEN 'reach' WHEN (symbol + ix) % 3 = 1 THEN 'stay' ELSE 'close' END", "side": "CASE WHEN (symbol + ix) % 2 = 0 THEN 1 ELSE -1 END", "hi3": f"max(h) OVER (PARTITION BY symbol ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)", "lo3": f"min(l) OVER (PARTITION BY symbol ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)", "c3": ahead("c", 3)},
    {"level": "c * (1 + side * 0.5 * r1)"},
    {"touched": "CASE WHEN side = 1 THEN hi3 >= level ELSE lo3 <= level END"},
    {"outcome": "CASE WHEN c3 IS NULL OR r1 IS NULL THEN NULL WHEN kind = 'reach' THEN CASE WHEN touched THEN 1 ELSE 0 END WHEN kind = 'stay' THEN CASE WHEN touched THEN 0 ELSE 1 END ELSE CASE WHEN side * (c3 - level) > 0 THEN 1 ELSE 0 END END"},
]


@query(f"""{chain(S.BGRID, "bgrid", *_ASK).replace("ln(c / nullif(o, 0))", "CASE WHEN c > 0 AND o > 0 THEN ln(c / o) END")} SELECT symbol, session, kind, side::INT AS side, {S.r6('level')} AS level, outcome::INT AS outcome FROM t3 WHERE outcome IS NOT NULL""")
def question_outcomes(spark, d):
    """Questions of a level half a usual range away, resolved over the three sessions after."""
    return _asked(spark, d).select("symbol", "session", "kind", "side", r6(F.col("level")).alias("level"), "outcome")


def _asked(spark, d):
    stages = [{n: e.replace("ln(c / nullif(o, 0))", "CASE WHEN c > 0 AND o > 0 THEN ln(c / o) END") for n, e in s.items()} for s in _ASK]
    return apply(daily_grid(spark, d), *stages).filter("outcome is not null")


@query(f"""{chain(S.BGRID, "bgrid", *_ASK).replace("ln(c / nullif(o, 0))", "CASE WHEN c > 0 AND o > 0 THEN ln(c / o) END")}, q AS (SELECT symbol % 20 AS grp, kind, outcome, ix % 2 = 0 AS train FROM t3 WHERE outcome IS NOT NULL),
a AS (SELECT avg(outcome) AS p FROM q WHERE train), k AS (SELECT kind, avg(outcome) AS p FROM q WHERE train GROUP BY kind), g AS (SELECT grp, kind, avg(outcome) AS p, count(*) AS n FROM q WHERE train GROUP BY ALL)
SELECT q.kind, count(*)::BIGINT AS n, {S.r6('avg(power(outcome - CASE WHEN g.n >= 20 THEN g.p ELSE coalesce(k.p, a.p) END, 2))')} AS brier, {S.r6('avg(power(outcome - a.p, 2))')} AS flat, {S.r6('avg((coalesce(g.n, 0) < 20)::INT)')} AS fell_back
FROM q LEFT JOIN g ON g.grp = q.grp AND g.kind = q.kind LEFT JOIN k ON k.kind = q.kind, a WHERE NOT train GROUP BY q.kind""")
def base_rates(spark, d):
    """Base rates by group and kind, by kind where a group has too few, else overall; judged on the other half."""
    q = _asked(spark, d).select((F.col("symbol") % 20).alias("grp"), "kind", "outcome", (F.col("ix") % 2 == 0).alias("train"))
    train, test = q.filter("train"), q.filter("not train")
    a = train.agg(F.avg("outcome").alias("pa"))
    k = train.groupBy("kind").agg(F.avg("outcome").alias("pk"))
    g = train.groupBy("grp", "kind").agg(F.avg("outcome").alias("pg"), F.count(F.lit(1)).alias("n"))
    j = test.join(F.broadcast(g), ["grp", "kind"], "left").join(F.broadcast(k), "kind", "left").join(F.broadcast(a))
    p = F.when(F.col("n") >= 20, F.col("pg")).otherwise(F.coalesce("pk", "pa"))
    sq = lambda x: (F.col("outcome") - x) * (F.col("outcome") - x)
    return j.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(sq(p))).alias("brier"), r6(F.avg(sq(F.col("pa")))).alias("flat"), r6(F.avg((F.coalesce("n", F.lit(0)) < 20).cast("int"))).alias("fell_back"))


_COUNTS = [{"y": ln(div("h", "l"))}, {"b": mean("y", 10, 4, -1), "seen": lag("v")}, {"bin": "CASE WHEN seen IS NULL OR seen = 0 THEN '0' WHEN seen = 1 THEN '1' WHEN seen <= 3 THEN '2-3' ELSE '4+' END"}]


@query(f"""{chain(S.BGRID, "bgrid", *_COUNTS)} SELECT bin, count(*)::BIGINT AS n, {S.r6('sum(y) / sum(b)')} AS ratio, {S.r6('avg((y > 2 * b)::INT)')} AS spikes, {S.r6('quantile_cont(y / b, 0.5)')} AS mid FROM t2 WHERE y IS NOT NULL AND b > 0 GROUP BY bin""")
def count_table(spark, d):
    """Realized over usual range by how much was seen the session before."""
    p = apply(daily_grid(spark, d), *_COUNTS).filter("y is not null and b > 0")
    y, b = F.col("y"), F.col("b")
    return p.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(y) / F.sum(b)).alias("ratio"), r6(F.avg((y > 2 * b).cast("int"))).alias("spikes"), r6(F.percentile(y / b, 0.5)).alias("mid"))


@query(f"""{_SQL}, k AS (SELECT symbol, session, x1, t, row_number() OVER (PARTITION BY date_trunc('quarter', session) ORDER BY abs(x1) DESC, symbol, session) AS place FROM f)
SELECT symbol, session, {S.r6('x1')} AS move, {S.r6('t')} AS later, place::INT AS place FROM k WHERE place <= 3""")
def case_studies(spark, d):
    """The three largest moves of each quarter and what came after."""
    f = _feats(spark, d)
    w = W.partitionBy(F.date_trunc("quarter", "session")).orderBy(F.desc(F.abs("x1")), "symbol", "session")
    return f.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("symbol", "session", r6(F.col("x1")).alias("move"), r6(F.col("t")).alias("later"), "place")
