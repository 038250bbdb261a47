"""Estimators as aggregates, and the scorecards of what they predict."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import correlation, half_label, r6, ratio
from ..operators import hmm as H
from ..operators import models as M
from ..sources import views as V
from ..sources.staging import staged
from . import sql as S
from .catalog import query
from .stages import ahead, apply, chain, div, lag, ln, mean, slots, weekly_grid

_XS = ("x1", "x2", "x3")
_BACK = {"x1": 1, "x2": 4, "x3": 13}
_FEATS = [{n: f"{div('price', lag('price', k))} - 1" for n, k in _BACK.items()} | {"t": f"{div(ahead('price', 5), 'price')} - 1"}]
_SQL = f"{chain(S.GRID, 'grid', *_FEATS)}, f AS (SELECT symbol, session, ix, x1, x2, x3, t FROM t0 WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL AND t IS NOT NULL)"


def _feats(spark, d):
    return apply(weekly_grid(spark, d), *_FEATS).select("symbol", "session", "ix", *_XS, "t").dropna()


def _standardized(f):
    """Regressors as z values clipped at three deviations; the scale is one row."""
    s = f.agg(*[F.avg(x).alias(f"m_{x}") for x in _XS], *[F.stddev_samp(x).alias(f"s_{x}") for x in _XS])
    z = lambda x: F.greatest(F.lit(-3.0), F.least(F.lit(3.0), ratio(F.col(x) - F.col(f"m_{x}"), F.col(f"s_{x}"))))
    return f.join(F.broadcast(s)).select("symbol", "session", "ix", "t", *[z(x).alias(x) for x in _XS])


_Z = f"{_SQL}, sc AS (SELECT {', '.join(f'avg({x}) AS m_{x}, stddev_samp({x}) AS s_{x}' for x in _XS)} FROM f), z AS (SELECT symbol, session, ix, t, {', '.join(f'greatest(-3, least(3, ({x} - m_{x}) / nullif(s_{x}, 0))) AS {x}' for x in _XS)} FROM f, sc)"


def _det(m: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_A = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
_LAMBDA = 10.0


@query(f"""{_Z}, m AS (SELECT count(*) AS n, avg(t) AS mt, {', '.join(f'avg({x}) AS a{i}' for i, x in enumerate(_XS))}, {', '.join(f'covar_pop({_XS[i]}, {_XS[j]}) * count(*) + {_LAMBDA if i == j else 0} AS c{i}{j}' for i in range(3) for j in range(i, 3))},
{', '.join(f'covar_pop({x}, t) * count(*) AS y{i}' for i, x in enumerate(_XS))} FROM z), b AS (SELECT *, {', '.join(f"{_det([[f'y{r}' if k == i else _A[r][k] for k in range(3)] for r in range(3)])} / {_det(_A)} AS b{i + 1}" for i in range(3))} FROM m)
SELECT n::BIGINT AS n, {S.r6('mt - b1 * a0 - b2 * a1 - b3 * a2')} AS b0, {', '.join(f'{S.r6(f"b{i}")} AS b{i}' for i in (1, 2, 3))} FROM b""")
def ridge_fit(spark, d):
    """Ridge on standardized, clipped regressors; one aggregation of moments."""
    z = _standardized(_feats(spark, d))
    n = F.count(F.lit(1))
    m = z.agg(n.alias("n"), F.avg("t").alias("mt"), *[F.avg(x).alias(f"a_{x}") for x in _XS], *[(F.covar_pop(x, y) * n).alias(f"{x}_{y}") for i, x in enumerate(_XS) for y in _XS[i:]], *[(F.covar_pop(x, "t") * n).alias(f"{x}_t") for x in _XS])
    a = [[F.col(f"{min(x, y)}_{max(x, y)}") + (_LAMBDA if x == y else 0.0) for y in _XS] for x in _XS]
    s = M.solve(m, a, [F.col(f"{x}_t") for x in _XS], ["b1", "b2", "b3"])
    b0 = F.col("mt") - sum((F.col(f"b{i + 1}") * F.col(f"a_{x}") for i, x in enumerate(_XS)), F.lit(0.0))
    return s.select("n", r6(b0).alias("b0"), *[r6(F.col(f"b{i}")).alias(f"b{i}") for i in (1, 2, 3)])


@query(f"""{_SQL}, b AS (SELECT regr_slope(t, x1) AS b, regr_intercept(t, x1) AS a, avg(x1) AS mx FROM f), g AS (SELECT ix, sum((x1 - mx) * (t - a - b * x1)) AS g, sum((x1 - mx) * (x1 - mx)) AS sxx, count(*) AS n, any_value(a) AS a, any_value(b) AS b FROM f, b GROUP BY ix)
SELECT sum(n)::BIGINT AS n, count(*)::BIGINT AS dates, {S.r6('any_value(a)')} AS a, {S.r6('any_value(b)')} AS b, {S.r6('sqrt(sum(g * g)) / sum(sxx)')} AS se, {S.r6('any_value(b) / nullif(sqrt(sum(g * g)) / sum(sxx), 0)')} AS t FROM g""")
def clustered_ols(spark, d):
    """Slope with a covariance clustered by date: the scores are summed within dates first."""
    f = _feats(spark, d)
    b = f.agg(F.regr_slope("t", "x1").alias("b"), F.regr_intercept("t", "x1").alias("a"), F.avg("x1").alias("mx"))
    dev = F.col("x1") - F.col("mx")
    g = f.join(F.broadcast(b)).groupBy("ix").agg(F.sum(dev * (F.col("t") - F.col("a") - F.col("b") * F.col("x1"))).alias("g"), F.sum(dev * dev).alias("sxx"), F.count(F.lit(1)).alias("n"), F.first("a").alias("a"), F.first("b").alias("b"))
    se = F.sqrt(F.sum(F.col("g") * F.col("g"))) / F.sum("sxx")
    return g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("dates"), r6(F.first("a")).alias("a"), r6(F.first("b")).alias("b"), r6(se).alias("se"), r6(ratio(F.first("b"), se)).alias("t"))


def _newton(k: int) -> str:
    """Step k of the logistic fit, from n{k-1} (a, b)."""
    return f"""n{k} AS (SELECT a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - p) AS g0, sum((y - p) * x) - any_value(b) AS g1,
sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) + 1 AS h11 FROM (SELECT a, b, y, x, 1 / (1 + exp(-(a + b * x))) AS p FROM l, n{k - 1})))"""


@query(f"""{_Z}, l AS (SELECT x2 AS x, (t > 0)::INT AS y FROM z), n0 AS (SELECT 0::DOUBLE AS a, 0::DOUBLE AS b), {', '.join(_newton(k) for k in range(1, 6))}
SELECT {S.r6('any_value(a)')} AS a, {S.r6('any_value(b)')} AS b, {S.r6('-avg(y * ln(p) + (1 - y) * ln(1 - p))')} AS logloss FROM (SELECT a, b, y, 1 / (1 + exp(-(a + b * x))) AS p FROM l, n5)""")
def logistic_newton(spark, d):
    """Five Newton steps of a logistic curve with a unit penalty on its slope. A step is one
    aggregation of five sums; only those reach the driver."""
    lines = staged(_standardized(_feats(spark, d)).select(F.col("x2").alias("x"), (F.col("t") > 0).cast("int").alias("y")), "lines")
    a = b = 0.0
    for _ in range(5):
        p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        w = p * (1 - p)
        s = lines.agg(F.sum(F.col("y") - p).alias("g0"), F.sum((F.col("y") - p) * F.col("x")).alias("g1"), F.sum(w).alias("h00"), F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11")).first()
        if s.h00 is None or s.h01 is None:
            break
        g1, h11 = s.g1 - b, s.h11 + 1
        det = s.h00 * h11 - s.h01 * s.h01
        if not det:  # all chances at 0 or 1: no step to take
            break
        a, b = a + (h11 * s.g0 - s.h01 * g1) / det, b + (s.h00 * g1 - s.h01 * s.g0) / det
    p = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
    y = F.col("y")
    return lines.agg(r6(F.lit(a)).alias("a"), r6(F.lit(b)).alias("b"), r6(-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("logloss"))


@query(f"""{_Z}, b AS (SELECT floor((x1 + 3) * 3)::INT AS bin, sum((t > 0)::INT) AS s, count(*) AS n FROM z GROUP BY ALL), c AS (SELECT bin, s, n, sum(s) OVER (ORDER BY bin) AS cs, sum(n) OVER (ORDER BY bin) AS cn FROM b),
m AS (SELECT a.bin AS lo, e.bin AS hi, (e.cs - a.cs + a.s) / (e.cn - a.cn + a.n) AS v FROM c a JOIN c e ON a.bin <= e.bin), i AS (SELECT c.bin, m.lo, min(m.v) AS v FROM c JOIN m ON m.lo <= c.bin AND m.hi >= c.bin GROUP BY ALL)
SELECT i.bin, any_value(n)::BIGINT AS n, {S.r6('any_value(s / n)')} AS raw, {S.r6('max(v)')} AS iso FROM i JOIN b ON b.bin = i.bin GROUP BY i.bin""")
def isotonic_bins(spark, d):
    """Isotonic recalibration over bins of a score by the max-min formula of block means. The
    bins are a fixed few, so joining them with themselves is bounded."""
    z = _standardized(_feats(spark, d))
    b = z.groupBy(F.floor((F.col("x1") + 3) * 3).cast("int").alias("bin")).agg(F.sum((F.col("t") > 0).cast("int")).alias("s"), F.count(F.lit(1)).alias("n"))
    w = W.orderBy("bin")
    c = b.withColumns({"cs": F.sum("s").over(w), "cn": F.sum("n").over(w)})
    lo, hi = c.select(F.col("bin").alias("lo"), (F.col("cs") - F.col("s")).alias("s0"), (F.col("cn") - F.col("n")).alias("n0")), c.select(F.col("bin").alias("hi"), F.col("cs").alias("s1"), F.col("cn").alias("n1"))
    m = lo.join(F.broadcast(hi), F.col("lo") <= F.col("hi")).select("lo", "hi", ((F.col("s1") - F.col("s0")) / (F.col("n1") - F.col("n0"))).alias("v"))
    i = c.join(F.broadcast(m), (F.col("lo") <= F.col("bin")) & (F.col("hi") >= F.col("bin"))).groupBy("bin", "n", "s", "lo").agg(F.min("v").alias("v"))
    return i.groupBy("bin").agg(F.first("n").alias("n"), r6(F.first(F.col("s") / F.col("n"))).alias("raw"), r6(F.max("v")).alias("iso"))


_SLOT = [{"open": "first_value(o) OVER (PARTITION BY symbol, session ORDER BY slot)"}, {"x": ln(div("c", "open")), "y": ln(div("last_value(c) OVER (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", "c"))}]


@query(f"""{chain(S.SLOTS, "slots", *_SLOT)}, f AS (SELECT slot, x, y FROM t1 WHERE x IS NOT NULL AND y IS NOT NULL AND slot < 7), b AS (SELECT slot, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n FROM f GROUP BY slot)
SELECT slot, any_value(n)::BIGINT AS n, {S.r6('any_value(a)')} AS a, {S.r6('any_value(b)')} AS b, {S.r6('quantile_cont(y - a - b * x, 0.1)')} AS q10, {S.r6('quantile_cont(y - a - b * x, 0.9)')} AS q90, {S.r6('avg(exp(y - a - b * x))')} AS smear FROM f JOIN b USING (slot) GROUP BY slot""")
def slot_ols(spark, d):
    """A line for each slot of the day, its residual quantiles and smearing factor."""
    f = apply(slots(spark, d), *_SLOT).filter("x is not null and y is not null and slot < 7").select("slot", "x", "y")
    b = f.groupBy("slot").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.count(F.lit(1)).alias("n"))
    e = f.join(F.broadcast(b), "slot").withColumn("e", F.col("y") - F.col("a") - F.col("b") * F.col("x"))
    one = lambda c: F.first(c)
    return e.groupBy("slot").agg(one("n").alias("n"), r6(one("a")).alias("a"), r6(one("b")).alias("b"), r6(F.percentile("e", 0.1)).alias("q10"), r6(F.percentile("e", 0.9)).alias("q90"), r6(F.avg(F.exp("e"))).alias("smear"))


@query(f"""WITH {S.SLOTS}, r AS (SELECT symbol, session, slot, ln(c / o) AS r, row_number() OVER (PARTITION BY symbol, session ORDER BY slot) AS k, row_number() OVER (PARTITION BY symbol, session ORDER BY slot DESC) AS back FROM slots WHERE c > 0 AND o > 0),
p AS (SELECT a.symbol, a.session, a.r AS x, b.r AS y FROM r a JOIN r b ON a.symbol = b.symbol AND a.session = b.session AND a.k = 1 AND b.back = 1 AND b.slot > a.slot)
SELECT symbol, count(*)::BIGINT AS n, {S.r6('regr_slope(y, x)')} AS slope, {S.r6('corr(y, x)')} AS corr, {S.r6('avg(sign(x) * y)')} AS timing, {S.r6('avg(y)')} AS hold FROM p GROUP BY symbol""")
def first_last_slot(spark, d):
    """The last slot's move on the first's: slope, correlation, and the profit of its sign."""
    s = slots(spark, d).filter("c > 0 and o > 0").withColumn("r", F.ln(F.col("c") / F.col("o")))
    p = s.groupBy("symbol", "session").agg(F.min_by("r", "slot").alias("x"), F.max_by("r", "slot").alias("y"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return p.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r6(F.regr_slope("y", "x")).alias("slope"), r6(correlation("y", "x")).alias("corr"), r6(F.avg(F.signum("x") * F.col("y"))).alias("timing"), r6(F.avg("y")).alias("hold"))


_MARKET = [{"r": ln(div("price", lag("price")))}]
#: A calm and a wild state: mean, deviation, and the chance to stay.
_STATES = ((0.0, 0.05), (0.0, 0.2))
_STAY = 0.95


def _density(x: str, k: int) -> str:
    m, s = _STATES[k]
    return f"exp(-0.5 * power(({x} - {m}) / {s}, 2)) / {s}"


@query(f"""{chain(S.GRID, "grid", *_MARKET).replace("WITH ", "WITH RECURSIVE ", 1)}, m AS (SELECT ix, avg(r) AS r, row_number() OVER (ORDER BY ix) AS k FROM t0 WHERE r IS NOT NULL GROUP BY ix),
h AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS ix, 0.5::DOUBLE AS p UNION ALL SELECT k, ix, b / nullif(a + b, 0) FROM (SELECT m.k, m.ix, ({_STAY} * (1 - h.p) + {1 - _STAY} * h.p) * {_density('m.r', 0)} AS a, ({_STAY} * h.p + {1 - _STAY} * (1 - h.p)) * {_density('m.r', 1)} AS b FROM h JOIN m ON m.k = h.k + 1))
SELECT ix, {S.r6('p')} AS p_wild FROM h WHERE k > 0""")
def hmm_filter(spark, d):
    """Forward filter of a two-state Gaussian chain with given parameters over the market's
    weekly return: an ordered fold, one short series."""
    m = apply(weekly_grid(spark, d), *_MARKET).filter("r is not null").groupBy("ix").agg(F.avg("r").alias("r")).withColumn("series", F.lit(0))
    one, other = _STATES
    # the fold starts half and half, one step before the first session
    fits = spark.createDataFrame([{"series": 0} | H.given([0.5, 0.5], [[_STAY, 1 - _STAY], [1 - _STAY, _STAY]], [[one[0]], [other[0]]], [[one[1] ** 2], [other[1] ** 2]])], "series int, pi array<double>, move array<array<double>>, mean array<array<double>>, var array<array<double>>, centre array<double>, scale array<double>")
    return H.filtered(m, fits, ["r"], by=["series"], order="ix").select("ix", r6(F.get("p", F.lit(1))).alias("p_wild"))


@query(f"""{_SQL}, c AS (SELECT {', '.join(f'quantile_cont({x}, 0.5) AS m_{x}' for x in _XS)} FROM f), k AS (SELECT {', '.join(f'quantile_cont(abs({x} - m_{x}), 0.5) * 1.4826 AS s_{x}' for x in _XS)} FROM f, c),
s AS (SELECT date_trunc('month', session)::DATE AS month, t, sqrt(({' + '.join(f'power(({x} - m_{x}) / nullif(s_{x}, 0), 2)' for x in _XS)}) / 3) AS score FROM f, c, k), b AS (SELECT month, least(13, floor(score * 4))::INT AS bin, t < -0.1 AS crash FROM s),
mo AS (SELECT bin, month, avg(crash::INT) AS rate FROM b GROUP BY ALL), q AS (SELECT bin, quantile_cont(rate, 0.1) AS lo, quantile_cont(rate, 0.9) AS hi FROM mo GROUP BY bin)
SELECT bin, count(*)::BIGINT AS n, {S.r6('avg(crash::INT)')} AS rate, {S.r6('any_value(lo)')} AS lo, {S.r6('any_value(hi)')} AS hi FROM b JOIN q USING (bin) GROUP BY bin""")
def robust_score_bins(spark, d):
    """Robust z values (median, 1.4826 MAD) joined to a score, and the crash rate of its 14
    bins with the 10 to 90 % range of the months."""
    f = _feats(spark, d)
    c = f.agg(*[F.percentile(x, 0.5).alias(f"m_{x}") for x in _XS])
    fc = f.join(F.broadcast(c))
    k = fc.agg(*[(F.percentile(F.abs(F.col(x) - F.col(f"m_{x}")), 0.5) * 1.4826).alias(f"s_{x}") for x in _XS])
    z = lambda x: ratio(F.col(x) - F.col(f"m_{x}"), F.col(f"s_{x}"))
    s = fc.join(F.broadcast(k)).select(F.to_date(F.date_trunc("month", "session")).alias("month"), (F.col("t") < -0.1).cast("int").alias("crash"), F.least(F.lit(13), F.floor(F.sqrt(sum((z(x) * z(x) for x in _XS), F.lit(0.0)) / 3) * 4)).cast("int").alias("bin"))
    q = s.groupBy("bin", "month").agg(F.avg("crash").alias("rate")).groupBy("bin").agg(F.percentile("rate", 0.1).alias("lo"), F.percentile("rate", 0.9).alias("hi"))
    return s.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("crash")).alias("rate")).join(F.broadcast(q), "bin").select("bin", "n", "rate", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


_RANGE = [{"y": ln(div("h", "l"))}, {"b": mean("y", 13, 5, -1), "state": f"CASE WHEN abs({div('price', lag('price'))} - 1) > 0.1 THEN 'moved' ELSE 'quiet' END", "late": "ix >= 150"}]
_BASE = f"{chain(S.GRID, 'grid', *_RANGE)}, f AS (SELECT symbol, session, ix, y, b, state, late FROM t1 WHERE y > 0 AND b > 0)"


def _ranges(spark, d):
    return apply(weekly_grid(spark, d), *_RANGE).filter("y > 0 and b > 0").select("symbol", "session", "ix", "y", "b", "state", "late")


@query(f"""{_BASE}, fit AS (SELECT symbol, sum(y) / sum(b) AS scale, count(*) AS n FROM f WHERE NOT late GROUP BY symbol), q AS (SELECT symbol, quantile_cont(y / (scale * b), 0.1) AS lo, quantile_cont(y / (scale * b), 0.9) AS hi FROM f JOIN fit USING (symbol) WHERE NOT late GROUP BY symbol)
SELECT symbol, any_value(n)::BIGINT AS trained, {S.r6('any_value(scale)')} AS scale, {S.r6('any_value(lo)')} AS lo, {S.r6('any_value(hi)')} AS hi, count(*)::BIGINT AS n, {S.r6('avg((y BETWEEN lo * scale * b AND hi * scale * b)::INT)')} AS cover, {S.r6('sum(y) / sum(scale * b)')} AS realized FROM f JOIN fit USING (symbol) JOIN q USING (symbol) WHERE late GROUP BY symbol""")
def ratio_bands(spark, d):
    """Per symbol a ratio-of-sums scale and ratio quantiles from the early sessions, and their
    coverage on the late ones."""
    f = _ranges(spark, d)
    early, late = f.filter("not late"), f.filter("late")
    fit = early.groupBy("symbol").agg((F.sum("y") / F.sum("b")).alias("scale"), F.count(F.lit(1)).alias("trained"))
    rel = F.col("y") / (F.col("scale") * F.col("b"))
    q = early.join(F.broadcast(fit), "symbol").groupBy("symbol").agg(F.percentile(rel, 0.1).alias("lo"), F.percentile(rel, 0.9).alias("hi"), F.first("scale").alias("scale"), F.first("trained").alias("trained"))
    base = F.col("scale") * F.col("b")
    g = late.join(F.broadcast(q), "symbol").groupBy("symbol", "trained", "scale", "lo", "hi")
    out = g.agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("y").between(F.col("lo") * base, F.col("hi") * base).cast("int"))).alias("cover"), r6(F.sum("y") / F.sum(base)).alias("realized"))
    return out.select("symbol", "trained", *[r6(F.col(c)).alias(c) for c in ("scale", "lo", "hi")], "n", "cover", "realized")


@query(f"""{_BASE}, p AS (SELECT quantile_cont(ln(y / b), 0.1) AS lo, quantile_cont(ln(y / b), 0.9) AS hi FROM f WHERE NOT late), s AS (SELECT symbol % 4 AS grp, state, quantile_cont(ln(y / b), 0.1) AS lo, quantile_cont(ln(y / b), 0.9) AS hi, count(*) AS n FROM f WHERE NOT late GROUP BY ALL)
SELECT f.symbol % 4 AS grp, f.state, count(*)::BIGINT AS n, {S.r6('any_value(CASE WHEN s.n >= 200 THEN s.lo ELSE p.lo END)')} AS lo, {S.r6('any_value(CASE WHEN s.n >= 200 THEN s.hi ELSE p.hi END)')} AS hi,
{S.r6('avg((ln(y / b) BETWEEN CASE WHEN s.n >= 200 THEN s.lo ELSE p.lo END AND CASE WHEN s.n >= 200 THEN s.hi ELSE p.hi END)::INT)')} AS cover FROM f LEFT JOIN s ON s.grp = f.symbol % 4 AND s.state = f.state, p WHERE late GROUP BY ALL""")
def state_quantiles(spark, d):
    """Residual quantiles by group and state where there are enough, else the pooled ones; and their coverage later."""
    f = _ranges(spark, d).withColumns({"grp": F.col("symbol") % 4, "e": F.ln(F.col("y") / F.col("b"))})
    early, late = f.filter("not late"), f.filter("late")
    cuts = lambda g: g.agg(F.percentile("e", 0.1).alias("lo"), F.percentile("e", 0.9).alias("hi"), F.count(F.lit(1)).alias("k"))
    p = cuts(early).select(F.col("lo").alias("plo"), F.col("hi").alias("phi"))
    j = late.join(F.broadcast(cuts(early.groupBy("grp", "state"))), ["grp", "state"], "left").join(F.broadcast(p))
    own = F.col("k") >= 200
    j = j.withColumns({"lo": F.when(own, F.col("lo")).otherwise(F.col("plo")), "hi": F.when(own, F.col("hi")).otherwise(F.col("phi"))})
    return j.groupBy("grp", "state").agg(F.count(F.lit(1)).alias("n"), r6(F.first("lo")).alias("lo"), r6(F.first("hi")).alias("hi"), r6(F.avg(F.col("e").between(F.col("lo"), F.col("hi")).cast("int"))).alias("cover"))


# --- scorecards ----------------------------------------------------------------------------


@query(f"""{_BASE}, g AS (SELECT CASE WHEN month(session) <= 6 THEN concat(year(session), 'H1') ELSE concat(year(session), 'H2') END AS half, state, y, b, ntile(3) OVER (PARTITION BY session ORDER BY b, symbol) AS tercile FROM f)
SELECT half, tercile::INT AS tercile, count(*)::BIGINT AS n, {S.r6('avg((y BETWEEN 0.5 * b AND 1.6 * b)::INT)')} AS cover, {S.r6('avg((y < 0.5 * b)::INT)')} AS below, {S.r6('avg((y > 1.6 * b)::INT)')} AS above, {S.r6('sum(y) / sum(b)')} AS ratio FROM g GROUP BY GROUPING SETS ((), (half), (tercile))""")
def coverage_card(spark, d):
    """Coverage of a band overall, by half-year and by the session's tercile of the forecast."""
    f = _ranges(spark, d)
    g = f.select(half_label(F.col("session")).alias("half"), "y", "b", F.ntile(3).over(W.partitionBy("session").orderBy("b", "symbol")).alias("tercile"))
    y, b = F.col("y"), F.col("b")
    share = lambda c: r6(F.avg(c.cast("int")))
    return g.groupingSets([[], ["half"], ["tercile"]], "half", "tercile").agg(F.count(F.lit(1)).alias("n"), share(y.between(0.5 * b, 1.6 * b)).alias("cover"), share(y < 0.5 * b).alias("below"), share(y > 1.6 * b).alias("above"), r6(F.sum(y) / F.sum(b)).alias("ratio"))


_FORECASTS = [{"y": ln(div("h", "l"))}, {"f_last": lag("y"), "f_month": mean("y", 4, 2, -1), "f_year": mean("y", 52, 20, -1)}]


@query(f"""{chain(S.GRID, "grid", *_FORECASTS)}, c AS (SELECT session, y, f_last, f_month, f_year FROM t1 WHERE y IS NOT NULL AND f_last IS NOT NULL AND f_month IS NOT NULL AND f_year IS NOT NULL),
u AS (SELECT session, y, 'f_last' AS model, f_last AS p, f_year AS base FROM c UNION ALL SELECT session, y, 'f_month', f_month, f_year FROM c UNION ALL SELECT session, y, 'f_year', f_year, f_year FROM c),
day AS (SELECT model, session, avg((y - base) * (y - base) - (y - p) * (y - p)) AS gain FROM u GROUP BY ALL), t AS (SELECT model, avg(gain) / nullif(stddev_samp(gain) / sqrt(count(*)), 0) AS t, count(*) AS days FROM day GROUP BY model)
SELECT model, count(*)::BIGINT AS n, any_value(days)::BIGINT AS days, {S.r6('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS r2, {S.r6('1 - sum((y - p) * (y - p)) / sum((y - base) * (y - base))')} AS gain, {S.r6('any_value(t)')} AS t, {S.r6('quantile_cont(abs(y - p), 0.5)')} AS mid_error, {S.r6('regr_slope(y, p)')} AS slope FROM u JOIN t USING (model) GROUP BY model""")
def forecast_compare(spark, d):
    """Several forecasts on their common cells: R2, gain over the base, the t of the daily
    gain, median error and calibration slope."""
    c = apply(weekly_grid(spark, d), *_FORECASTS).select("session", "y", "f_last", "f_month", "f_year").dropna().withColumn("base", F.col("f_year"))
    u = c.unpivot(["session", "y", "base"], ["f_last", "f_month", "f_year"], "model", "p")
    se, sb = (F.col("y") - F.col("p")) * (F.col("y") - F.col("p")), (F.col("y") - F.col("base")) * (F.col("y") - F.col("base"))
    day = u.groupBy("model", "session").agg(F.avg(sb - se).alias("gain"))
    t = day.groupBy("model").agg(ratio(F.avg("gain"), F.stddev_samp("gain") / F.sqrt(F.count(F.lit(1)))).alias("t"), F.count(F.lit(1)).alias("days"))
    g = u.groupBy("model").agg(F.count(F.lit(1)).alias("n"), r6(1 - ratio(F.avg(se), F.var_pop("y"))).alias("r2"), r6(1 - ratio(F.sum(se), F.sum(sb))).alias("gain"), r6(F.percentile(F.abs(F.col("y") - F.col("p")), 0.5)).alias("mid_error"), r6(F.regr_slope("y", "p")).alias("slope"))
    return g.join(F.broadcast(t), "model").select("model", "n", "days", "r2", "gain", r6(F.col("t")).alias("t"), "mid_error", "slope")


@query(f"""{_SQL}, q AS (SELECT t, x2, least(9, floor((row_number() OVER (PARTITION BY ix ORDER BY x2, symbol) - 1) * 10.0 / count(*) OVER (PARTITION BY ix)))::INT AS bin FROM f)
SELECT bin, count(*)::BIGINT AS n, {S.r6('avg(x2)')} AS said, {S.r6('avg(t)')} AS came, {S.r6('avg((t > 0)::INT)')} AS rose FROM q GROUP BY bin""")
def decile_calibration(spark, d):
    """Mean forecast and outcome by the session's decile of the forecast."""
    f = _feats(spark, d)
    w = W.partitionBy("ix")
    k = F.least(F.lit(9), F.floor((F.row_number().over(w.orderBy("x2", "symbol")) - 1) * 10.0 / F.count(F.lit(1)).over(w))).cast("int")
    return f.withColumn("bin", k).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x2")).alias("said"), r6(F.avg("t")).alias("came"), r6(F.avg((F.col("t") > 0).cast("int"))).alias("rose"))


@query(f"""{_SQL}, day AS (SELECT session, avg(t) FILTER (x1 > 0) - avg(t) FILTER (x1 < 0) AS pnl FROM f GROUP BY session HAVING count(*) FILTER (x1 > 0) >= 2 AND count(*) FILTER (x1 < 0) >= 2)
SELECT CASE WHEN month(session) <= 6 THEN concat(year(session), 'H1') ELSE concat(year(session), 'H2') END AS half, count(*)::BIGINT AS days, {S.r6('avg(pnl)')} AS mean, {S.r6('avg(pnl) / nullif(stddev_samp(pnl) / sqrt(count(*)), 0)')} AS t, {S.r6('avg((pnl > 0)::INT)')} AS hit FROM day GROUP BY ROLLUP (1)""")
def sign_long_short(spark, d):
    """Daily profit of buying risers and selling fallers, by half-year and in all."""
    f = _feats(spark, d)
    up, down = F.when(F.col("x1") > 0, F.col("t")), F.when(F.col("x1") < 0, F.col("t"))
    day = f.groupBy("session").agg((F.avg(up) - F.avg(down)).alias("pnl"), F.count(up).alias("u"), F.count(down).alias("v")).filter("u >= 2 and v >= 2")
    return day.rollup(half_label(F.col("session")).alias("half")).agg(F.count(F.lit(1)).alias("days"), r6(F.avg("pnl")).alias("mean"), r6(ratio(F.avg("pnl"), F.stddev_samp("pnl") / F.sqrt(F.count(F.lit(1))))).alias("t"), r6(F.avg((F.col("pnl") > 0).cast("int"))).alias("hit"))


@query(f"""{chain(S.SLOTS, "slots", *_SLOT)}, f AS (SELECT session, slot, symbol, rank() OVER (PARTITION BY session, slot ORDER BY x) AS a, rank() OVER (PARTITION BY session, slot ORDER BY y) AS b FROM t1 WHERE x IS NOT NULL AND y IS NOT NULL AND slot < 7), d AS (SELECT slot, session, corr(a, b) AS ic FROM f GROUP BY ALL HAVING count(*) >= 4 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0)
SELECT slot, count(*)::BIGINT AS days, {S.r6('avg(ic)')} AS ic, {S.r6('avg(ic) / nullif(stddev_samp(ic) / sqrt(count(*)), 0)')} AS t FROM d GROUP BY slot""")
def slot_ic(spark, d):
    """Rank correlation of the move so far with the rest of the day, by slot, over days."""
    f = apply(slots(spark, d), *_SLOT).filter("x is not null and y is not null and slot < 7")
    w = W.partitionBy("session", "slot")
    k = f.withColumns({"a": F.rank().over(w.orderBy("x")), "b": F.rank().over(w.orderBy("y"))})
    day = k.groupBy("slot", "session").agg(correlation("a", "b").alias("ic"), F.count(F.lit(1)).alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb")).filter("n >= 4 and sa > 0 and sb > 0")
    return day.groupBy("slot").agg(F.count(F.lit(1)).alias("days"), r6(F.avg("ic")).alias("ic"), r6(ratio(F.avg("ic"), F.stddev_samp("ic") / F.sqrt(F.count(F.lit(1))))).alias("t"))


@query("""WITH o AS (SELECT o_orderpriority AS arm, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_totalprice IS NOT NULL)
SELECT arm, any_value(n)::BIGINT AS n, min(x) FILTER (k >= ceil(0.05 * n)) AS p5, min(x) FILTER (k >= ceil(0.5 * n)) AS p50, min(x) FILTER (k >= ceil(0.95 * n)) AS p95 FROM o GROUP BY arm""")
def nearest_rank(spark, d):
    """Nearest-rank quantiles, which are always values of the data."""
    o = V.table(spark, d, "orders").filter("o_totalprice is not null")
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY o_totalprice)")
    return o.groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count(F.lit(1)).alias("n"), disc(0.05).alias("p5"), disc(0.5).alias("p50"), disc(0.95).alias("p95"))


@query(f"""{_SQL}, m AS (SELECT date_trunc('month', session)::DATE AS month, avg(t) AS v, count(*) AS n FROM f GROUP BY ALL) SELECT count(*)::BIGINT AS months, sum(n)::BIGINT AS n, {S.r6('avg(v)')} AS mean, {S.r6('avg(v) / nullif(stddev_samp(v) / sqrt(count(*)), 0)')} AS t, {S.r6('avg((v > 0)::INT)')} AS up FROM m""")
def month_t(spark, d):
    """The mean of monthly means and its t over months."""
    m = _feats(spark, d).groupBy(F.date_trunc("month", "session")).agg(F.avg("t").alias("v"), F.count(F.lit(1)).alias("n"))
    return m.agg(F.count(F.lit(1)).alias("months"), F.sum("n").alias("n"), r6(F.avg("v")).alias("mean"), r6(ratio(F.avg("v"), F.stddev_samp("v") / F.sqrt(F.count(F.lit(1))))).alias("t"), r6(F.avg((F.col("v") > 0).cast("int"))).alias("up"))


@query(f"""{_BASE} SELECT session, count(*)::BIGINT AS n, {S.r6('sum(y)')} AS sy, {S.r6('sum(y * y)')} AS syy, {S.r6('sum((y - b) * (y - b))')} AS se, {S.r6('sum((y - 1.1 * b) * (y - 1.1 * b))')} AS se2, sum((y < 0.5 * b)::INT)::BIGINT AS below, sum((y > 1.6 * b)::INT)::BIGINT AS above,
{S.r6('1 - sum((y - b) * (y - b)) / nullif(sum(y * y) - sum(y) * sum(y) / count(*), 0)')} AS r2 FROM f GROUP BY session""")
def day_sums(spark, d):
    """Sufficient statistics of two forecasts a day, from which any pooled R2, coverage or
    resampled gain follows without the rows."""
    y, b = F.col("y"), F.col("b")
    sq = lambda x: F.sum(x * x)
    n = F.count(F.lit(1))
    return _ranges(spark, d).groupBy("session").agg(n.alias("n"), r6(F.sum(y)).alias("sy"), r6(sq(y)).alias("syy"), r6(sq(y - b)).alias("se"), r6(sq(y - 1.1 * b)).alias("se2"), F.sum((y < 0.5 * b).cast("int")).alias("below"), F.sum((y > 1.6 * b).cast("int")).alias("above"), r6(1 - ratio(sq(y - b), sq(y) - F.sum(y) * F.sum(y) / n)).alias("r2"))


@query(f"""{chain(S.GRID, "grid", *_FEATS)}, ok AS (SELECT ix, avg((x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL)::INT) AS share FROM t0 GROUP BY ix) SELECT min(ix) FILTER (share >= 0.5) AS first_half, min(ix) FILTER (share >= 0.9) AS first_most, count(*) FILTER (share >= 0.5)::BIGINT AS usable FROM ok""")
def first_complete_session(spark, d):
    """The first session on which half (nine tenths) of the symbols have every feature."""
    p = apply(weekly_grid(spark, d), *_FEATS)
    ok = p.groupBy("ix").agg(F.avg((F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("x3").isNotNull()).cast("int")).alias("share"))
    at = lambda s: F.min(F.when(F.col("share") >= s, F.col("ix")))
    return ok.agg(at(0.5).alias("first_half"), at(0.9).alias("first_most"), F.count(F.when(F.col("share") >= 0.5, 1)).alias("usable"))
