"""Walk-forward predictions, and the measures that judge them."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import correlation, half_label, r6, ratio
from ..operators import models as M
from ..operators import quantiles as Q
from ..operators import rolling as R
from ..operators import xsection as X
from ..sources import views as V
from . import sql as S
from .catalog import query
from .xsection import _SCORED, scored

_BLOCKS = f"""{S.GRID}, blocks AS (SELECT ((lo - 100) // 21)::INT AS block, lo::BIGINT AS lo, least(lo + 21, last + 1)::BIGINT AS hi, (lo - 1 - 5)::BIGINT AS train_to
FROM (SELECT max(ix) AS last FROM cal) CROSS JOIN LATERAL (SELECT unnest(range(100, last + 1, 21)) AS lo))"""


def _blocks(spark, d):
    return M.blocks(V.calendar(V.weekly(spark, d)), 100, 21, 5)


@query(f"WITH {_BLOCKS} SELECT block, lo, hi, train_to FROM blocks")
def walk_forward_blocks(spark, d):
    """Prediction blocks of 21 sessions, with an embargo of five before each."""
    return _blocks(spark, d).select("block", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("train_to").cast("long").alias("train_to"))


@query(f"WITH {_BLOCKS} SELECT block, count(*)::BIGINT AS trained, count(*) FILTER (ix + 5 >= lo)::BIGINT AS leaked FROM blocks JOIN grid ON ix <= train_to AND price IS NOT NULL GROUP BY block")
def embargo_check(spark, d):
    """Rows in training whose target reaches into the block: none. Running counts by session,
    of which a block takes the differences."""
    per_ix = V.aligned(V.weekly(spark, d)).groupBy("ix").agg(F.count("price").alias("n"))
    run = per_ix.select("ix", F.sum("n").over(W.orderBy("ix")).alias("upto"))  # a row a session
    b = _blocks(spark, d).withColumn("safe", F.least("train_to", F.col("lo") - 6))
    at = lambda name, out: run.select(F.col("ix").alias(name), F.col("upto").alias(out))
    j = F.broadcast(b).join(at("train_to", "trained"), "train_to").join(at("safe", "known"), "safe")
    return j.filter("trained > 0").select("block", "trained", (F.col("trained") - F.col("known")).alias("leaked"))


_FEATS = f"""{_BLOCKS}, f AS (SELECT symbol, ix, price / lag(price, 1) OVER w - 1 AS x1, price / lag(price, 4) OVER w - 1 AS x2, lead(price, 5) OVER w / price - 1 AS t FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY ix)),
fit AS (SELECT block, lo, hi, regr_count(t, x1) AS n, covar_pop(x1, t) AS c1, covar_pop(x2, t) AS c2, var_pop(x1) AS s11, var_pop(x2) AS s22, covar_pop(x1, x2) AS s12, avg(t) AS mt, avg(x1) AS m1, avg(x2) AS m2
FROM blocks JOIN f ON ix <= train_to AND x1 IS NOT NULL AND x2 IS NOT NULL AND t IS NOT NULL GROUP BY block, lo, hi),
beta AS (SELECT *, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM fit)"""


def _features(spark, d):
    g = V.aligned(V.weekly(spark, d))
    back = lambda n: ratio(F.col("price"), R.lag("price", n)) - 1
    return g.withColumns({"x1": back(1), "x2": back(4), "t": ratio(F.lead("price", 5).over(R.by()), F.col("price")) - 1}).select("symbol", "session", "ix", "x1", "x2", "t")


def predictions(spark, d):
    """Walk-forward least squares: moments are summed once a session and accumulated over
    sessions, so each block's training set costs one lookup, not one pass."""
    f = _features(spark, d).filter("x1 is not null and x2 is not null")
    m = M.moments(f.filter("t is not null"), ["x1", "x2"], "t", "ix")
    upto = W.orderBy("ix").rowsBetween(W.unboundedPreceding, 0)  # one row a session
    m = m.select("ix", *[F.sum(c).over(upto).alias(c) for c in m.columns if c != "ix"])
    b = _blocks(spark, d)
    at = F.broadcast(b).join(m, F.col("ix") <= F.col("train_to")).withColumn("_rn", F.row_number().over(W.partitionBy("block").orderBy(F.desc("ix")))).filter("_rn = 1").drop("ix", "_rn")
    beta = M.solve2(at, "x1", "x2").select("block", "lo", "hi", "b0", "b1", "b2", F.col("one__one").alias("n"))
    got = f.join(F.broadcast(beta), (F.col("ix") >= F.col("lo")) & (F.col("ix") < F.col("hi")))
    return got.withColumn("pred", F.col("b0") + F.col("b1") * F.col("x1") + F.col("b2") * F.col("x2"))


@query(f"""WITH {_FEATS} SELECT symbol, ix, block, n::BIGINT AS n, {S.r6('mt + b1 * (x1 - m1) + b2 * (x2 - m2)')} AS pred FROM f JOIN beta ON ix >= lo AND ix < hi WHERE x1 IS NOT NULL AND x2 IS NOT NULL""")
def wf_ols_predict(spark, d):
    return predictions(spark, d).select("symbol", "ix", "block", F.col("n").cast("long").alias("n"), r6(F.col("pred")).alias("pred"))


_PRED = f"""{_FEATS}, pred AS (SELECT symbol, session, f.ix, block, t, mt, mt + b1 * (x1 - m1) + b2 * (x2 - m2) AS p FROM f JOIN beta ON ix >= lo AND ix < hi JOIN cal USING (ix) WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND t IS NOT NULL)"""


@query(f"""WITH {_PRED} SELECT block, count(*)::BIGINT AS n, {S.r6('1 - sum((t - p) * (t - p)) / sum((t - mt) * (t - mt))')} AS r2, {S.r6('corr(p, t)')} AS corr FROM pred GROUP BY block HAVING count(*) > 2""")
def r2_oos(spark, d):
    """Out-of-sample R2 against the training mean, per block."""
    p = predictions(spark, d).filter("t is not null")
    f = _features(spark, d).filter("x1 is not null and x2 is not null and t is not null")
    m = f.groupBy("ix").agg(F.sum("t").alias("s"), F.count("t").alias("k"))
    mt = F.broadcast(_blocks(spark, d)).join(m, F.col("ix") <= F.col("train_to")).groupBy("block").agg(ratio(F.sum("s"), F.sum("k")).alias("mt"))
    p = p.join(F.broadcast(mt), "block")
    sq = lambda a: F.sum((F.col("t") - F.col(a)) * (F.col("t") - F.col(a)))
    return p.groupBy("block").agg(F.count(F.lit(1)).alias("n"), r6(1 - ratio(sq("pred"), sq("mt"))).alias("r2"), r6(correlation("pred", "t")).alias("corr")).filter("n > 2")


_IC = f"""{_SCORED}, k AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY score, symbol) AS a, row_number() OVER (PARTITION BY session ORDER BY y, symbol) AS b FROM used),
ic AS (SELECT session, count(*) AS n, corr(a, b) AS ic FROM k GROUP BY session HAVING count(*) >= 10), st AS (SELECT *, row_number() OVER (ORDER BY session) - 1 AS step FROM ic)"""


def ic(spark, d):
    w = W.partitionBy("session")
    k = scored(spark, d).select("session", F.row_number().over(w.orderBy("score", "symbol")).alias("a"), F.row_number().over(w.orderBy("y", "symbol")).alias("b"))
    return k.groupBy("session").agg(F.count(F.lit(1)).alias("n"), correlation("a", "b").alias("ic")).filter("n >= 10")


@query(f"WITH {_IC} SELECT session, n::BIGINT AS n, {S.r6('ic')} AS ic FROM ic")
def ic_daily(spark, d):
    """Rank correlation of score and outcome, per session."""
    return ic(spark, d).select("session", "n", r6(F.col("ic")).alias("ic"))


@query(f"""WITH {_IC} SELECT count(*)::BIGINT AS steps, {S.r6('avg(ic)')} AS mean, {S.r6('avg(ic) FILTER (step % 5 = 0) / (stddev_samp(ic) FILTER (step % 5 = 0) / sqrt(count(*) FILTER (step % 5 = 0)))')} AS t FROM st""")
def ic_tstat(spark, d):
    """Mean over all steps; t-statistic over every fifth, whose horizons don't overlap."""
    st = ic(spark, d).withColumn("step", F.row_number().over(W.orderBy("session")) - 1)  # a row a session
    own = F.when(F.col("step") % 5 == 0, F.col("ic"))
    return st.agg(F.count(F.lit(1)).alias("steps"), r6(F.avg("ic")).alias("mean"), r6(ratio(F.avg(own), F.stddev_samp(own) / F.sqrt(F.count(own)))).alias("t"))


@query(f"WITH {_IC} SELECT year(session)::VARCHAR || CASE WHEN month(session) <= 6 THEN 'H1' ELSE 'H2' END AS half, count(*)::BIGINT AS n, {S.r6('avg(ic)')} AS mean, {S.r6('avg((ic > 0)::INT)')} AS hit FROM ic GROUP BY ALL")
def ic_by_half(spark, d):
    return ic(spark, d).groupBy(half_label(F.col("session")).alias("half")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ic")).alias("mean"), r6(F.avg((F.col("ic") > 0).cast("int"))).alias("hit"))


@query(f"""WITH {_IC}, e AS (SELECT step, ic - avg(ic) OVER () AS e, avg(ic) OVER () AS m, count(*) OVER () AS n FROM st),
l AS (SELECT n, m, e * e AS g0, {', '.join(f'e * lag(e, {k}) OVER (ORDER BY step) AS g{k}' for k in range(1, 5))} FROM e)
SELECT any_value(n)::BIGINT AS n, {S.r6('any_value(m) / sqrt((sum(g0) + 2 * (0.8 * sum(g1) + 0.6 * sum(g2) + 0.4 * sum(g3) + 0.2 * sum(g4))) / any_value(n) / any_value(n))')} AS t FROM l""")
def newey_west_t(spark, d):
    """t-statistic of the mean IC with four lags of autocovariance (a row a session)."""
    st = ic(spark, d)
    m = F.broadcast(st.agg(F.avg("ic").alias("m"), F.count(F.lit(1)).alias("total")))
    e = st.join(m).withColumn("e", F.col("ic") - F.col("m"))
    w = W.orderBy("session")
    e = e.withColumns({f"g{k}": F.col("e") * (F.lag("e", k).over(w) if k else F.col("e")) for k in range(5)})
    n = F.first("total")
    s = F.sum("g0") + 2 * (0.8 * F.sum("g1") + 0.6 * F.sum("g2") + 0.4 * F.sum("g3") + 0.2 * F.sum("g4"))
    return e.agg(n.alias("n"), r6(F.first("m") / F.sqrt(s / n / n)).alias("t"))


_OUT = f"""out AS (SELECT l.doc_id, quality AS y, (ntile - 0.5) / 10 AS p, n_chars, ntile FROM labels l JOIN (SELECT doc_id, n_chars, ntile(10) OVER (ORDER BY n_chars, doc_id) AS ntile FROM documents SEMI JOIN labels USING (doc_id)) USING (doc_id))"""


def outcomes(spark, d):
    """Labelled documents with a forecast from the decile of their length. Exact deciles
    from ranks within value ranges, so no task orders the whole table."""
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars").join(V.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    n = F.broadcast(docs.agg(F.count(F.lit(1)).alias("total")))
    coarse = docs.withColumn("g", F.floor(F.col("n_chars") / 64))
    before = coarse.groupBy("g").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("g", "before")
    k = coarse.join(before, "g").withColumn("rn", F.col("before") + F.row_number().over(W.partitionBy("g").orderBy("n_chars", "doc_id"))).join(n)
    size, extra = F.floor(F.col("total") / 10), F.col("total") % 10
    cut = extra * (size + 1)
    tile = F.when(F.col("rn") <= cut, F.ceil(F.col("rn") / (size + 1))).otherwise(extra + F.ceil((F.col("rn") - cut) / size)).cast("int")
    return k.select("doc_id", F.col("quality").alias("y"), tile.alias("ntile"), "n_chars").withColumn("p", (F.col("ntile") - 0.5) / 10)


@query(f"WITH {_OUT}, b AS (SELECT avg(y) AS base FROM out) SELECT count(*)::BIGINT AS n, {S.r6('avg((p - y) * (p - y))')} AS brier, {S.r6('1 - avg((p - y) * (p - y)) / avg((base - y) * (base - y))')} AS skill FROM out, b")
def brier_skill(spark, d):
    o = outcomes(spark, d)
    o = o.join(F.broadcast(o.agg(F.avg("y").alias("base"))))
    sq = lambda a: F.avg((F.col(a) - F.col("y")) * (F.col(a) - F.col("y")))
    return o.agg(F.count(F.lit(1)).alias("n"), r6(sq("p")).alias("brier"), r6(1 - ratio(sq("p"), sq("base"))).alias("skill"))


@query(f"WITH {_OUT} SELECT ntile::INT AS bin, count(*)::BIGINT AS n, {S.r6('avg(p)')} AS said, {S.r6('avg(y)')} AS was FROM out GROUP BY ntile")
def reliability(spark, d):
    return outcomes(spark, d).groupBy(F.col("ntile").alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("said"), r6(F.avg("y")).alias("was"))


@query(f"""WITH {_OUT}, r AS (SELECT y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rk FROM out)
SELECT {S.r6('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))')} AS auc FROM r""")
def auc_rank(spark, d):
    """AUC from average ranks, by counts per value: ties and totals come from one aggregate."""
    v = outcomes(spark, d).groupBy("n_chars").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("k"))
    w = W.orderBy("n_chars").rowsBetween(W.unboundedPreceding, -1)  # a row a distinct value
    v = v.withColumn("rk", F.coalesce(F.sum("k").over(w), F.lit(0)) + (F.col("k") + 1) / 2)
    p, n = F.sum("pos"), F.sum(F.col("k") - F.col("pos"))
    return v.agg(r6((F.sum(F.col("rk") * F.col("pos")) - p * (p + 1) / 2) / (p * n)).alias("auc"))


_BAND = f"""{_PRED}, q AS (SELECT b.block, quantile_cont(e.t - e.p, 0.1) AS lo10, quantile_cont(e.t - e.p, 0.9) AS hi90, count(*) AS n FROM blocks b JOIN pred e ON e.ix <= b.train_to GROUP BY b.block HAVING count(*) >= 100)"""


def bands(spark, d):
    """Residual quantiles of the rows known before each block, none of which is copied a block."""
    p = predictions(spark, d).filter("t is not null").withColumn("e", F.col("t") - F.col("pred"))
    q = Q.exact(p.select("ix", "e"), "e", "ix", _blocks(spark, d), [0.1, 0.9])
    return p, q.select(F.col("block").alias("b"), F.col("q0").alias("lo10"), F.col("q1").alias("hi90"), F.col("n").alias("k")).filter("k >= 100")


@query(f"WITH {_BAND} SELECT block, {S.r6('lo10')} AS lo10, {S.r6('hi90')} AS hi90, n::BIGINT AS n FROM q")
def residual_quantile_bands(spark, d):
    return bands(spark, d)[1].select(F.col("b").alias("block"), r6(F.col("lo10")).alias("lo10"), r6(F.col("hi90")).alias("hi90"), F.col("k").alias("n"))


@query(f"""WITH {_BAND}, c AS (SELECT block, t, p + lo10 AS lo, p + hi90 AS hi FROM pred JOIN q USING (block)) SELECT block, count(*)::BIGINT AS n, {S.r6('avg((t BETWEEN lo AND hi)::INT)')} AS inside,
{S.r6('avg(greatest(0.1 * (t - lo), -0.9 * (t - lo)))')} AS pinball10, {S.r6('avg(greatest(0.9 * (t - hi), -0.1 * (t - hi)))')} AS pinball90 FROM c GROUP BY block""")
def coverage_pinball(spark, d):
    """How often the 10-90 band holds, and its quantile losses."""
    p, q = bands(spark, d)
    c = p.join(F.broadcast(q), p.block == q.b).withColumns({"lo": F.col("pred") + F.col("lo10"), "hi": F.col("pred") + F.col("hi90")})
    loss = lambda a, e: F.avg(F.greatest(a * e, (a - 1) * e))
    return c.groupBy("block").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("t").between(F.col("lo"), F.col("hi")).cast("int"))).alias("inside"), r6(loss(0.1, F.col("t") - F.col("lo"))).alias("pinball10"), r6(loss(0.9, F.col("t") - F.col("hi"))).alias("pinball90"))


@query(f"""WITH {_SCORED}, k AS (SELECT session, y, least(floor((row_number() OVER (PARTITION BY session ORDER BY score, symbol) - 1) / count(*) OVER (PARTITION BY session) * 10), 9)::INT AS decile FROM used),
g AS (SELECT decile, session, sum(y) AS s, count(*) AS n FROM k GROUP BY ALL)
SELECT decile, session, {S.r6('sum(s) OVER w / sum(n) OVER w')} AS past_mean, (sum(n) OVER w)::BIGINT AS past_n FROM g WINDOW w AS (PARTITION BY decile ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def pit_decile_table(spark, d):
    """Mean outcome of each decile as known before each session."""
    w = W.partitionBy("session")
    k = scored(spark, d).withColumn("decile", F.least(F.floor((F.row_number().over(w.orderBy("score", "symbol")) - 1) / F.count(F.lit(1)).over(w) * 10), F.lit(9)).cast("int"))
    g = k.groupBy("decile", "session").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("n"))
    past = W.partitionBy("decile").orderBy("session").rowsBetween(W.unboundedPreceding, -1)
    return g.select("decile", "session", r6(F.sum("s").over(past) / F.sum("n").over(past)).alias("past_mean"), F.sum("n").over(past).alias("past_n"))


@query(f"""WITH {_IC} SELECT draw, {S.r6('avg(ic)')} AS mean FROM (SELECT d AS draw, step, (('0x' || substr(md5(d::VARCHAR || ':' || step::VARCHAR), 1, 8))::BIGINT % k.n) AS pick FROM st, (SELECT count(*) AS n FROM st) k, (SELECT unnest(range(200)) AS d)) x
JOIN (SELECT step AS pick, ic FROM st) USING (pick) GROUP BY draw""")
def boot_cluster(spark, d):
    """200 bootstrap means over sessions. A draw is a hash of its number, so any run gives the same."""
    st = ic(spark, d).select("ic", (F.row_number().over(W.orderBy("session")) - 1).cast("long").alias("step"))
    n = F.broadcast(st.agg(F.count(F.lit(1)).alias("n")))  # st has no other n
    draws = st.select("step").join(n).select("step", "n", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("draw"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", "draw", "step")), 1, 8), 16, 10).cast("long") % F.col("n")
    return draws.select("draw", pick.alias("pick")).join(st.select(F.col("step").alias("pick"), "ic"), "pick").groupBy("draw").agg(r6(F.avg("ic")).alias("mean"))


@query(f"""WITH {_IC}, s AS (SELECT d, avg(ic * CASE WHEN ('0x' || substr(md5('s' || d::VARCHAR || ':' || step::VARCHAR), 1, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END) AS m FROM st, (SELECT unnest(range(400)) AS d) GROUP BY d)
SELECT {S.r6('(1 + count(*) FILTER (abs(m) >= abs((SELECT avg(ic) FROM st)))) / (1.0 + count(*))')} AS p FROM s""")
def perm_signflip(spark, d):
    """Two-sided p-value of the mean IC under random signs."""
    st = ic(spark, d).select("ic", (F.row_number().over(W.orderBy("session")) - 1).cast("long").alias("step"))
    sign = F.when(F.conv(F.substring(F.md5(F.concat(F.lit("s"), F.col("d").cast("string"), F.lit(":"), F.col("step").cast("string"))), 1, 8), 16, 10).cast("long") % 2 == 0, 1).otherwise(-1)
    m = st.select("ic", "step", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("d")).groupBy("d").agg(F.avg(F.col("ic") * sign).alias("m"))
    m = m.join(F.broadcast(st.agg(F.avg("ic").alias("real"))))
    return m.agg(r6((1 + F.count(F.when(F.abs("m") >= F.abs("real"), 1))) / (1.0 + F.count(F.lit(1)))).alias("p"))


@query(f"""WITH {_IC}, b AS (SELECT d, k, (('0x' || substr(md5('b' || d::VARCHAR || ':' || k::VARCHAR), 1, 8))::BIGINT % (n - 9)) AS start FROM (SELECT count(*) AS n FROM st), (SELECT unnest(range(100)) AS d), (SELECT unnest(range(30)) AS k))
SELECT d AS draw, {S.r6('avg(ic)')} AS mean FROM b JOIN st ON step >= start AND step < start + 10 GROUP BY d""")
def boot_block(spark, d):
    """100 moving-block means: 30 blocks of ten sessions each."""
    st = ic(spark, d).select("ic", (F.row_number().over(W.orderBy("session")) - 1).cast("long").alias("step"))
    n = st.agg(F.count(F.lit(1)).alias("n"))
    b = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("draw")).select("n", "draw", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"))
    start = F.conv(F.substring(F.md5(F.concat(F.lit("b"), F.col("draw").cast("string"), F.lit(":"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long") % (F.col("n") - 9)
    steps = b.select("draw", F.explode(F.sequence(start, start + 9)).alias("step"))
    return steps.join(st, "step").groupBy("draw").agg(r6(F.avg("ic")).alias("mean"))


@query(f"""WITH {_OUT}, c AS (SELECT cut, count(*) FILTER (p >= cut AND y = 1) AS tp, count(*) FILTER (p >= cut AND y = 0) AS fp, count(*) FILTER (p < cut AND y = 1) AS fn, count(*) FILTER (p < cut AND y = 0) AS tn FROM out, (SELECT unnest([0.2, 0.5, 0.8]) AS cut) GROUP BY cut)
SELECT cut::DOUBLE AS cut, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, {S.r6('tp / (tp + fp)')} AS prec, {S.r6('tp / (tp + fn)')} AS rec FROM c""")
def confusion_precision_recall(spark, d):
    o = outcomes(spark, d).select("y", "p", F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias("cut"))
    n = lambda hi, y: F.count(F.when((F.col("p") >= F.col("cut") if hi else F.col("p") < F.col("cut")) & (F.col("y") == y), 1))
    c = o.groupBy("cut").agg(n(True, 1).alias("tp"), n(True, 0).alias("fp"), n(False, 1).alias("fn"), n(False, 0).alias("tn"))
    return c.withColumns({"prec": r6(F.col("tp") / (F.col("tp") + F.col("fp"))), "rec": r6(F.col("tp") / (F.col("tp") + F.col("fn")))})
