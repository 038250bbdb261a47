"""Walk-forward estimators of any kind, their bands, calibrators and second stages."""

from pyspark.sql import functions as F

from ..functions.scalars import r6, ratio
from ..operators import calibration as C
from ..operators import histboost as B
from ..operators import models as M
from ..operators import quantiles as Q
from ..operators import walkforward as K
from ..sources.staging import staged
from . import sql as S
from .catalog import query
from .estimators import _BASE, _FORECASTS, _SQL, _XS, _feats, _ranges
from .stages import apply, chain, weekly_grid

_FIRST, _STEP, _AHEAD = 100, 21, 5


def _spans(source: str, first: int = _FIRST, step: int = _STEP, ahead: int = _AHEAD) -> str:
    """The blocks over the sessions of a source, for the oracles."""
    return f"blocks AS (SELECT ((lo - {first}) // {step})::INT AS block, lo, least(lo + {step}, last + 1) AS hi, lo - 1 - {ahead} AS train_to FROM (SELECT max(ix) AS last FROM {source}), LATERAL (SELECT unnest(range({first}, last + 1, {step})) AS lo))"


def _blocks(rows):
    return M.blocks(rows.select("ix"), _FIRST, _STEP, _AHEAD)


# --- linear, group and blended forecasts ---------------------------------------------------

_N = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


@query(f"""{_SQL}, {_spans('f')}, m AS (SELECT block, lo, hi, count(*) AS n, avg(t) AS mt, {', '.join(f'avg({x}) AS a{i}' for i, x in enumerate(_XS))}, {', '.join(f'covar_pop({x}, t) * count(*) AS y{i}' for i, x in enumerate(_XS))}, {', '.join(f'covar_pop({_XS[i]}, {_XS[j]}) * count(*) + {0.5 if i == j else 0} AS c{i}{j}' for i in range(3) for j in range(i, 3))}
FROM blocks JOIN f ON f.ix <= train_to GROUP BY ALL), b AS (SELECT *, {', '.join(f"{_det([[f'y{r}' if k == i else _N[r][k] for k in range(3)] for r in range(3)])} / {_det(_N)} AS b{i}" for i in range(3))} FROM m)
SELECT symbol, ix, block, n::BIGINT AS trained, {S.r6('mt + b0 * (x1 - a0) + b1 * (x2 - a1) + b2 * (x3 - a2)')} AS pred FROM f JOIN b ON ix >= lo AND ix < hi WHERE n >= 200""")
def wf_ridge_predict(spark, d):
    """Ridge on three regressors, walked forward from running moments."""
    got = K.walk_forward(_feats(spark, d), K.Ridge(_XS, "t", 0.5), first=_FIRST, step=_STEP, embargo=_AHEAD, min_train=200)
    return got.select("symbol", "ix", "block", "trained", r6(F.col("pred")).alias("pred"))


@query(f"""{_SQL}, g AS (SELECT *, symbol % 6 AS grp, x1 > 0 AS up, (t > 0)::INT AS rose FROM f), {_spans('f')}, r AS (SELECT block, grp, up, count(*) AS k, avg(rose) AS rate FROM blocks JOIN g ON g.ix <= train_to GROUP BY ALL), o AS (SELECT block, lo, hi, count(*) AS n, avg(rose) AS overall FROM blocks JOIN g ON g.ix <= train_to GROUP BY ALL)
SELECT symbol, ix, o.block, n::BIGINT AS trained, {S.r6('CASE WHEN coalesce(k, 0) >= 100 THEN rate ELSE overall END')} AS pred FROM g JOIN o ON ix >= lo AND ix < hi LEFT JOIN r ON r.block = o.block AND r.grp = g.grp AND r.up = g.up WHERE EXISTS (SELECT 1 FROM blocks b JOIN g h ON h.ix <= b.train_to WHERE h.grp = g.grp AND h.up = g.up)""")
def wf_group_rates(spark, d):
    """The past rate of a group, or of all where the group has few, known before each block."""
    rows = _feats(spark, d).select("symbol", "ix", (F.col("symbol") % 6).alias("grp"), (F.col("x1") > 0).alias("up"), (F.col("t") > 0).cast("int").alias("rose"))
    got = K.walk_forward(rows, K.Rates(["grp", "up"], "rose", 100), first=_FIRST, step=_STEP, embargo=_AHEAD)
    return got.select("symbol", "ix", "block", "trained", r6(F.col("pred")).alias("pred"))


def _cof(i: int, j: int) -> str:
    """Of the symmetric matrix c, the entry (i, j) of its adjugate."""
    r, c = [k for k in range(3) if k != j], [k for k in range(3) if k != i]
    n = lambda p, q: f"c{min(p, q)}{max(p, q)}"
    return f"({'-' if (i + j) % 2 else ''}({n(r[0], c[0])} * {n(r[1], c[1])} - {n(r[0], c[1])} * {n(r[1], c[0])}))"


def _se(j: int) -> str:
    terms = " + ".join(f"{_cof(j, p)} * m{min(p, q)}{max(p, q)} * {_cof(q, j)}" for p in range(3) for q in range(3))
    return f"sqrt(greatest(0, {terms})) / abs({_det(_N)})"


@query(f"""{_SQL}, m AS (SELECT count(*) AS n, avg(t) AS mt, {', '.join(f'avg({x}) AS a{i}' for i, x in enumerate(_XS))}, {', '.join(f'covar_pop({x}, t) * count(*) AS y{i}' for i, x in enumerate(_XS))}, {', '.join(f'covar_pop({_XS[i]}, {_XS[j]}) * count(*) AS c{i}{j}' for i in range(3) for j in range(i, 3))} FROM f),
b AS (SELECT *, {', '.join(f"{_det([[f'y{r}' if k == i else _N[r][k] for k in range(3)] for r in range(3)])} / {_det(_N)} AS b{i}" for i in range(3))} FROM m),
g AS (SELECT ix, {', '.join(f'sum(({x} - a{i}) * (t - mt - b0 * (x1 - a0) - b1 * (x2 - a1) - b2 * (x3 - a2))) AS s{i}' for i, x in enumerate(_XS))} FROM f, b GROUP BY ix), k AS (SELECT count(*) AS clusters, {', '.join(f'sum(s{i} * s{j}) AS m{i}{j}' for i in range(3) for j in range(i, 3))} FROM g)
{' UNION ALL '.join(f"SELECT '{x}' AS x, {S.r6(f'b{i}')} AS b, {S.r6(_se(i))} AS se, {S.r6(f'b{i} / nullif({_se(i)}, 0)')} AS t, n::BIGINT AS n, clusters::BIGINT AS clusters FROM b, k" for i, x in enumerate(_XS))}""")
def clustered_panel_ols(spark, d):
    """Three slopes at once, with a covariance clustered by session."""
    return M.clustered(_feats(spark, d), list(_XS), "t", "ix").select("x", *[r6(F.col(c)).alias(c) for c in ("b", "se", "t")], "n", "clusters")


_MIX = ("f_last", "f_month", "f_year")
_a = lambda i, j: f"a{min(i, j)}{max(i, j)}"


def _pair(i: int, j: int) -> str:
    return f"(b{i} - b{j} + {_a(j, j)} - {_a(i, j)}) / nullif({_a(i, i)} + {_a(j, j)} - 2 * {_a(i, j)}, 0)"


def _candidates() -> str:
    """Every support of the weights, each with its best point: corners, edges, the inside."""
    ws = [["1e0" if k == i else "0e0" for k in range(3)] for i in range(3)]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        ws.append([f"({_pair(i, j)})" if k == i else f"(1 - {_pair(i, j)})" if k == j else "0e0" for k in range(3)])
    d11, d12, d22 = "(a00 - 2 * a02 + a22)", "(a01 - a02 - a12 + a22)", "(a11 - 2 * a12 + a22)"
    e1, e2 = "(b0 - b2 - a02 + a22)", "(b1 - b2 - a12 + a22)"
    det = f"nullif({d11} * {d22} - {d12} * {d12}, 0)"
    u, v = f"(({e1} * {d22} - {e2} * {d12}) / {det})", f"(({d11} * {e2} - {d12} * {e1}) / {det})"
    ws.append([u, v, f"(1 - {u} - {v})"])
    return " UNION ALL ".join(f"SELECT block, trained, {', '.join(f'{w} AS w{k}' for k, w in enumerate(c))}, a00, a01, a02, a11, a12, a22, b0, b1, b2 FROM m" for c in ws)


@query(f"""{chain(S.GRID, "grid", *_FORECASTS)}, f AS (SELECT ix, y, f_last, f_month, f_year FROM t1 WHERE y IS NOT NULL AND f_last IS NOT NULL AND f_month IS NOT NULL AND f_year IS NOT NULL), {_spans('f')},
m AS (SELECT block, count(*) AS trained, {', '.join(f'sum({_MIX[i]} * {_MIX[j]}) AS a{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'sum({x} * y) AS b{i}' for i, x in enumerate(_MIX))} FROM blocks JOIN f ON f.ix <= train_to GROUP BY block),
c AS ({_candidates()}), k AS (SELECT *, a00 * w0 * w0 + a11 * w1 * w1 + a22 * w2 * w2 + 2 * (a01 * w0 * w1 + a02 * w0 * w2 + a12 * w1 * w2) - 2 * (b0 * w0 + b1 * w1 + b2 * w2) AS loss FROM c WHERE w0 >= -1e-9 AND w1 >= -1e-9 AND w2 >= -1e-9)
SELECT block, trained::BIGINT AS trained, {', '.join(f'{S.r6(f"arg_min(w{i}, loss)")} AS {x}' for i, x in enumerate(_MIX))} FROM k GROUP BY block, trained""")
def blend_weights(spark, d):
    """Weights of three range forecasts, none negative and one in sum, before each block."""
    f = apply(weekly_grid(spark, d), *_FORECASTS).select("ix", "y", *_MIX).dropna()
    w = K.Blend(_MIX, "y").fit_blocks(f, _blocks(f), "ix")
    return w.select("block", "trained", *[r6(F.col(f"b_{x}")).alias(x) for x in _MIX])


# --- boosted trees ---------------------------------------------------------------------------


@query()
def wf_boosted_bands(spark, d):
    """Lower and upper deciles of the size of the move to come, by boosted trees with quantile
    loss, walked forward; a block is a year."""
    rows = _feats(spark, d).select("symbol", "ix", *_XS, F.abs("t").alias("size"))
    walk = lambda a: K.walk_forward(rows, K.Boosted(_XS, "size", loss="quantile", alpha=a, trees=5, depth=2, rate=0.3), first=_FIRST, step=104, embargo=_AHEAD, min_train=200)
    low, high = walk(0.1).withColumnRenamed("pred", "lo"), walk(0.9).select("symbol", "ix", F.col("pred").alias("hi"))
    return low.join(high, ["symbol", "ix"]).select("symbol", "ix", "block", "trained", r6(F.least("lo", "hi")).alias("lo"), r6(F.greatest("lo", "hi")).alias("hi"))


@query()
def boosted_losses(spark, d):
    """Trees of four losses on the size of the move to come, trained up to an embargo before
    the last year: their errors, and those of the best constant."""
    f = staged(_feats(spark, d).select("ix", *_XS, F.abs("t").alias("y")), "losses")
    last = f.agg(F.max("ix")).first()[0] or 0
    train, test = f.filter(F.col("ix") < last - 52 - _AHEAD), f.filter(F.col("ix") >= last - 52)
    out = None
    for loss, alpha in (("l2", 0.5), ("l1", 0.5), ("huber", 0.1), ("quantile", 0.9)):
        model = B.fit(train, _XS, "y", loss=loss, alpha=alpha, trees=5, depth=2, rate=0.4)
        e = F.col("y") - F.col("pred")
        error = {"l2": e * e, "l1": F.abs(e), "huber": F.when(F.abs(e) <= alpha, e * e / 2).otherwise(alpha * (F.abs(e) - alpha / 2)), "quantile": F.greatest(alpha * e, (alpha - 1) * e)}[loss]
        got = model.predict(test).withColumns({"error": error, "below": (F.col("y") <= F.col("pred")).cast("int")})
        base = B.Model(model.xs, model.edges, model.start, model.rate, []).predict(test).agg(F.avg(error).alias("flat"))
        row = got.agg(F.lit(loss).alias("loss"), F.count(F.lit(1)).alias("n"), r6(F.avg("error")).alias("error"), r6(F.avg("below")).alias("below")).join(F.broadcast(base.select(r6(F.col("flat")).alias("flat"))))
        out = row if out is None else out.unionByName(row)
    return out


# --- bands, calibrators and second stages in time --------------------------------------------


@query(f"""{_BASE}, e AS (SELECT ix, y / b AS e FROM f), {_spans('e', 60, 13, 0)}, q AS (SELECT block, count(*)::BIGINT AS n, quantile_cont(e, 0.1) AS lo, quantile_cont(e, 0.5) AS mid, quantile_cont(e, 0.9) AS hi FROM blocks JOIN e ON e.ix <= train_to GROUP BY block)
SELECT block, n, {S.r6('lo')} AS lo, {S.r6('mid')} AS mid, {S.r6('hi')} AS hi FROM q""")
def prefix_quantiles(spark, d):
    """Quantiles of all ratios of range to usual range known before each block."""
    e = _ranges(spark, d).select("ix", (F.col("y") / F.col("b")).alias("e"))
    q = Q.exact(e, "e", "ix", M.blocks(e.select("ix"), 60, 13, 0), [0.1, 0.5, 0.9])
    return q.select("block", "n", r6(F.col("q0")).alias("lo"), r6(F.col("q1")).alias("mid"), r6(F.col("q2")).alias("hi"))


_RAW = "(row_number() OVER (PARTITION BY ix ORDER BY x2, symbol) - 0.5) / count(*) OVER (PARTITION BY ix)"


@query(f"""{_SQL}, s AS (SELECT symbol % 2 AS grp, ix, floor(({_RAW}) * 64 + 0.5)::INT AS g, (t > 0)::INT AS y FROM f), {_spans('f')}, n AS (SELECT grp, block, g, sum(y) AS s, count(*) AS n FROM blocks JOIN s ON s.ix <= train_to GROUP BY ALL),
c AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn, sum(n) OVER (PARTITION BY grp, block) AS total FROM n WINDOW w AS (PARTITION BY grp, block ORDER BY g)),
p AS (SELECT a.grp, a.block, a.g AS lo, e.g AS hi, (e.cs - a.cs + a.s) / (e.cn - a.cn + a.n) AS v FROM c a JOIN c e ON a.grp = e.grp AND a.block = e.block AND a.g <= e.g),
i AS (SELECT grp, block, lo, hi, min(v) OVER (PARTITION BY grp, block, lo ORDER BY hi DESC) AS v FROM p)
SELECT c.grp, c.block, c.g / 64 AS score, c.n::BIGINT AS n, {S.r6('any_value(c.s / c.n)')} AS raw, {S.r6('max(i.v)')} AS iso FROM c JOIN i ON i.grp = c.grp AND i.block = c.block AND i.hi = c.g WHERE total >= 300 GROUP BY ALL""")
def calibrator_refits(spark, d):
    """Isotonic calibrators of a rank as a chance to rise, refitted before each block."""
    return _calibrators(spark, d)[1].select("grp", "block", "score", "n", r6(F.col("raw")).alias("raw"), r6(F.col("iso")).alias("iso"))


def _calibrators(spark, d):
    rows = _feats(spark, d).select((F.col("symbol") % 2).alias("grp"), "ix", F.expr(_RAW).alias("score"), (F.col("t") > 0).cast("int").alias("y"))
    blocks = _blocks(rows)
    return rows, C.refits(rows, blocks, score="score", y="y", at="ix", by=["grp"], grid=64, min_rows=300), blocks


@query()
def calibrator_card(spark, d):
    """Brier scores of the raw and the recalibrated chance, and of the past rate, by block."""
    rows, curves, blocks = _calibrators(spark, d)
    inside = (F.col("ix") >= F.col("lo")) & (F.col("ix") < F.col("hi"))
    ahead = rows.join(F.broadcast(blocks.select("block", "lo", "hi")), inside)
    got = C.apply(ahead, curves, score="score", by=["grp"]).filter("calibrated is not null")
    sq = lambda c: F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
    return got.groupBy("grp", "block").agg(F.count(F.lit(1)).alias("n"), r6(sq("score")).alias("brier_raw"), r6(sq("calibrated")).alias("brier"), r6(1 - ratio(sq("calibrated"), sq("score"))).alias("skill"))


class Correction:
    """A multiplier of a frozen forecast ``p`` for rows of events: least squares of the log
    ratio y / p, clipped at its 1 and 99.5 % quantiles, on the regressors, times the mean of
    exp(residual), which undoes the bias of logs; kept within 0.5 and 6."""

    def __init__(self, xs, y: str, p: str):
        self.xs, self.y, self.p = list(xs), y, p

    def fit(self, train):
        own = train.filter((F.col(self.y) > 0) & (F.col(self.p) > 0)).dropna(subset=self.xs).withColumn("_l", F.ln(F.col(self.y) / F.col(self.p)))
        cut = own.agg(F.percentile("_l", 0.01).alias("lo"), F.percentile("_l", 0.995).alias("hi")).first()
        if cut.lo is None:
            return None
        own = own.withColumn("_l", F.greatest(F.lit(cut.lo), F.least(F.lit(cut.hi), F.col("_l"))))
        fit = K.Ridge(self.xs, "_l")
        one = own.sparkSession.createDataFrame([(0, 0, 1, 0)], "block int, lo long, hi long, train_to long")
        b = fit.fit_blocks(own.withColumn("_at", F.lit(0)), one, "_at").first()
        if b is None or any(b[f"b_{x}"] is None for x in self.xs):
            return None
        line = sum((F.lit(b[f"b_{x}"]) * F.col(x) for x in self.xs), F.lit(b.b_one))
        return line, own.agg(F.avg(F.exp(F.col("_l") - line))).first()[0]

    def predict(self, model, rows):
        if model is None:
            return rows.withColumn("pred", F.col(self.p))
        line, smear = model
        return rows.withColumn("pred", F.col(self.p) * F.greatest(F.lit(0.5), F.least(F.lit(6.0), F.exp(line) * smear)))


_EVENT = f"""{_BASE}, ev AS (SELECT symbol, ix, y, b, ln(b) AS lb, x FROM (SELECT *, lag(ln(y / b)) OVER (PARTITION BY symbol ORDER BY ix) AS x, state AS s FROM f) WHERE s = 'moved' AND x IS NOT NULL),
{_spans('ev', 104, 52, 0)}, l AS (SELECT block, lo, hi, ln(y / b) AS l, lb, x FROM blocks JOIN ev ON ev.ix <= train_to), q AS (SELECT block, quantile_cont(l, 0.01) AS ql, quantile_cont(l, 0.995) AS qh FROM l GROUP BY block),
z AS (SELECT l.block, lo, hi, lb, x, greatest(ql, least(qh, l)) AS l FROM l JOIN q ON q.block = l.block), m AS (SELECT block, lo, hi, count(*) AS n, covar_pop(lb, l) AS c1, covar_pop(x, l) AS c2, var_pop(lb) AS s11, var_pop(x) AS s22, covar_pop(lb, x) AS s12, avg(l) AS ml, avg(lb) AS m1, avg(x) AS m2 FROM z GROUP BY ALL),
beta AS (SELECT *, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m), sm AS (SELECT z.block, avg(exp(l - ml - b1 * (lb - m1) - b2 * (x - m2))) AS smear FROM z JOIN beta ON beta.block = z.block GROUP BY ALL),
got AS (SELECT beta.block, n, y, b, b * greatest(0.5, least(6, smear * exp(ml + b1 * (lb - m1) + b2 * (x - m2)))) AS p FROM ev JOIN beta ON ix >= lo AND ix < hi JOIN sm ON sm.block = beta.block WHERE n >= 50)"""


@query(f"""{_EVENT} SELECT block, any_value(n)::BIGINT AS trained, count(*)::BIGINT AS n, {S.r6('1 - sum((y - b) * (y - b)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0)')} AS r2_base, {S.r6('1 - sum((y - p) * (y - p)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0)')} AS r2, {S.r6('1 - sum((y - p) * (y - p)) / sum((y - b) * (y - b))')} AS gain FROM got GROUP BY block""")
def event_correction_card(spark, d):
    """Ranges of sessions with a large move: a frozen forecast, and its multiplier fitted on
    such sessions before each block."""
    from pyspark.sql import Window as W

    f = _ranges(spark, d).withColumn("x", F.lag(F.ln(F.col("y") / F.col("b"))).over(W.partitionBy("symbol").orderBy("ix")))
    ev = f.filter("state = 'moved' and x is not null").select("symbol", "ix", "y", "b", F.ln("b").alias("lb"), "x")
    got = K.walk_forward(ev, Correction(["lb", "x"], "y", "b"), first=104, step=52, embargo=0, min_train=50)
    y = F.col("y")
    err = lambda c: F.sum((y - F.col(c)) * (y - F.col(c)))
    spread = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(F.lit(1))
    return got.groupBy("block").agg(F.first("trained").alias("trained"), F.count(F.lit(1)).alias("n"), r6(1 - ratio(err("b"), spread)).alias("r2_base"), r6(1 - ratio(err("pred"), spread)).alias("r2"), r6(1 - ratio(err("pred"), err("b"))).alias("gain"))
