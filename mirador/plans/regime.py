"""The market's regime: its series, chains fitted to it, walk-forward states, and how well
they foretell events."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf, r6, ratio
from ..operators import hmm
from ..operators import models as M
from ..sources import views as V
from ..sources.staging import staged
from . import sql as S
from .catalog import query

FEATURES = ["r1", "lrv4", "lrv13", "breadth", "ldisp4"]
#: Events over the next sessions: the market's lowest level more than so far below today's, or its rise.
EVENTS = {"dd3_4": (4, 0.03), "dd8_4": (4, 0.08), "dd8_13": (13, 0.08), "up4": (4, None)}


def market(spark, d):
    """A row a session: the mean return, its realized volatility, breadth and dispersion, and
    what came after. The windows run over sessions, one row each."""
    by_symbol = W.partitionBy("symbol").orderBy("ix")
    usual = W.partitionBy("symbol").orderBy("ix").rowsBetween(-12, 0)
    g = V.aligned(V.weekly(spark, d))
    g = g.withColumns({"r": F.when((F.col("price") > 0) & (F.lag("price").over(by_symbol) > 0), F.ln(F.col("price") / F.lag("price").over(by_symbol))), "above": F.when((F.count("price").over(usual) == 13) & F.col("price").isNotNull(), (F.col("price") > F.avg("price").over(usual)).cast("int"))})
    m = g.groupBy("ix", "session").agg(F.avg("r").alias("r1"), F.stddev_samp("r").alias("disp"), F.avg("above").alias("breadth"), F.count("r").alias("n")).filter("n >= 2")
    full = lambda c, lo, hi, n: F.when(F.count(c).over(W.orderBy("ix").rowsBetween(lo, hi)) == n, F.avg(c).over(W.orderBy("ix").rowsBetween(lo, hi)))
    ln = lambda c: F.when(c > 0, F.ln(c))
    m = m.withColumn("sq", F.col("r1") * F.col("r1"))
    m = m.withColumns({"lrv4": ln(F.sqrt(52 * full("sq", -3, 0, 4))), "lrv13": ln(F.sqrt(52 * full("sq", -12, 0, 13))), "ldisp4": ln(full("disp", -3, 0, 4)), "vol4": ln(F.sqrt(52 * full("sq", 1, 4, 4))), "level": F.sum("r1").over(W.orderBy("ix").rowsBetween(W.unboundedPreceding, 0))})
    for name, (h, x) in EVENTS.items():
        w = W.orderBy("ix").rowsBetween(1, h)
        came = F.lead("level", h).over(W.orderBy("ix")) > F.col("level") if x is None else F.exp(F.min("level").over(w) - F.col("level")) - 1 < -x
        m = m.withColumn(name, F.when(F.count("level").over(w) == h, came.cast("int")))
    return m.select("ix", "session", *FEATURES, "vol4", *EVENTS)


def _event_sql(h: int, x: float | None) -> str:
    w = f"(ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    came = f"lead(level, {h}) OVER (ORDER BY ix) > level" if x is None else f"exp(min(level) OVER {w} - level) - 1 < -{x}"
    return f"CASE WHEN count(level) OVER {w} = {h} THEN ({came})::INT END"


_SERIES = f"""{S.RET}, a AS (SELECT ix, session, CASE WHEN price > 0 THEN r END AS r, CASE WHEN price IS NOT NULL AND count(price) OVER u = 13 THEN (price > avg(price) OVER u)::INT END AS above FROM ret WINDOW u AS (PARTITION BY symbol ORDER BY ix ROWS 12 PRECEDING)),
m AS (SELECT ix, session, avg(r) AS r1, stddev_samp(r) AS disp, avg(above) AS breadth FROM a GROUP BY ALL HAVING count(r) >= 2),
l AS (SELECT *, CASE WHEN count(r1) OVER w4 = 4 THEN sqrt(52 * avg(r1 * r1) OVER w4) END AS v4, CASE WHEN count(r1) OVER w13 = 13 THEN sqrt(52 * avg(r1 * r1) OVER w13) END AS v13, CASE WHEN count(disp) OVER w4 = 4 THEN avg(disp) OVER w4 END AS d4, CASE WHEN count(r1) OVER n4 = 4 THEN sqrt(52 * avg(r1 * r1) OVER n4) END AS f4, sum(r1) OVER (ORDER BY ix) AS level FROM m
WINDOW w4 AS (ORDER BY ix ROWS 3 PRECEDING), w13 AS (ORDER BY ix ROWS 12 PRECEDING), n4 AS (ORDER BY ix ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
series AS (SELECT ix, session, r1, CASE WHEN v4 > 0 THEN ln(v4) END AS lrv4, CASE WHEN v13 > 0 THEN ln(v13) END AS lrv13, breadth, CASE WHEN d4 > 0 THEN ln(d4) END AS ldisp4, CASE WHEN f4 > 0 THEN ln(f4) END AS vol4, {', '.join(f'{_event_sql(*e)} AS {n}' for n, e in EVENTS.items())} FROM l)"""


@query(f"WITH {_SERIES} SELECT ix, session, {', '.join(f'{S.r6(c)} AS {c}' for c in [*FEATURES, 'vol4'])}, {', '.join(EVENTS)} FROM series")
def regime_series(spark, d):
    """The features the chains see and the events to come, a row a session."""
    return market(spark, d).select("ix", "session", *[r6(F.col(c)).alias(c) for c in [*FEATURES, "vol4"]], *EVENTS)


@query()
def hmm_fit(spark, d):
    """Chains of two and three states fitted to the whole series from five starts each, a row
    a state: the start and steps that won, whether the likelihood rose at each step, the
    chance to stay, and the state's mean volatility and return."""
    m = staged(market(spark, d).select("ix", *FEATURES), "market")
    fits = None
    for k in (2, 3):
        own = hmm.best(hmm.fit(m, FEATURES, by=[], order="ix", states=k, key="lrv13"), []).withColumn("states", F.lit(k))
        fits = own if fits is None else fits.unionByName(own)
    rises = F.forall(F.sequence(F.lit(1), F.size("trace") - 1), lambda i: F.get("trace", i) >= F.get("trace", i - 1) - 1e-9)
    at = {f: FEATURES.index(f) for f in ("lrv13", "r1")}
    back = lambda f: F.get(F.get("mean", F.col("state")), F.lit(at[f])) * F.get("scale", F.lit(at[f])) + F.get("centre", F.lit(at[f]))
    rows = fits.withColumn("rises", F.when(F.size("trace") > 1, rises).otherwise(True)).withColumn("state", F.explode(F.sequence(F.lit(0), F.col("states") - 1)))
    return rows.select("states", "state", "start", "steps", "rises", r6(F.col("loglik")).alias("loglik"), r6(F.get(F.get("move", F.col("state")), F.col("state"))).alias("stay"), r6(F.exp(back("lrv13"))).alias("vol"), r6(back("r1")).alias("mean_return"))


def _walk(spark, d, states: int):
    """(block, lo, ix, p) for the sessions up to each block's end, by the chain that fits the
    sessions before the block; and the series."""
    m = staged(market(spark, d), "market")
    blocks = staged(M.blocks(m.select("ix"), 150, 21, 0).select("block", "lo", "hi"), "blocks")
    past = m.join(F.broadcast(blocks), F.col("ix") < F.col("hi"))  # a row a session and block
    fits = hmm.best(hmm.fit(past.filter("ix < lo").select("block", "ix", *FEATURES), FEATURES, by=["block"], order="ix", states=states, key="lrv13"), ["block"])
    p = hmm.filtered(past.select("block", "ix", *FEATURES), staged(fits, "fits"), FEATURES, by=["block"], order="ix")
    return m, p.join(F.broadcast(blocks), "block")


def _event_probabilities(spark, d, states: int):
    """(ix, target, y, p, base, walk): the states' past event rates weighted by today's
    probabilities, the plain past rate, and the reflection law of a random walk. Only events
    that were over before the block count as past."""
    m, p = _walk(spark, d, states)
    ys = m.select("ix", "lrv13", *[F.col(n).cast("double").alias(n) for n in EVENTS]).unpivot(["ix", "lrv13"], list(EVENTS), "target", "y")
    h, x = F.create_map(*[F.lit(v) for n, e in EVENTS.items() for v in (n, e[0])]), F.create_map(*[F.lit(v) for n, e in EVENTS.items() for v in (n, e[1] or 0.0)])
    ys = ys.withColumns({"h": F.element_at(h, F.col("target")), "x": F.element_at(x, F.col("target"))})
    rows = staged(p.join(ys, "ix"), "states")
    known = rows.filter((F.col("ix") + F.col("h") < F.col("lo")) & F.col("y").isNotNull()).select("block", "target", "y", F.posexplode("p").alias("state", "w"))
    rate = known.groupBy("block", "target", "state").agg(F.when(F.sum("w") > 1e-6, F.sum(F.col("w") * F.col("y")) / F.sum("w")).otherwise(F.avg("y")).alias("rate"), F.avg("y").alias("base"))
    rates = rate.groupBy("block", "target").agg(F.transform(F.sort_array(F.collect_list(F.struct("state", "rate"))), lambda s: s["rate"]).alias("rates"), F.first("base").alias("base"))
    now = rows.filter("ix >= lo and ix < hi").join(F.broadcast(rates), ["block", "target"])
    said = F.aggregate(F.zip_with("p", "rates", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    far = F.ln(1 - F.col("x")) / (F.exp("lrv13") / 52**0.5 * F.sqrt("h"))
    walk = F.when(F.col("x") > 0, F.least(F.lit(1.0), 2 * normal_cdf(far))).otherwise(0.5)
    return now.select("ix", "target", "y", said.alias("p"), "base", walk.alias("walk"))


@query()
def regime_states(spark, d):
    """Probability of a calm, a usual and a stressed state, by chains that saw only sessions
    before their block; and the mean volatility that these states had."""
    m, p = _walk(spark, d, 3)
    now = p.filter("ix >= lo and ix < hi").join(m.select("ix", "session", "lrv13"), "ix")
    return now.select("session", "ix", "block", *[r6(F.get("p", F.lit(k))).alias(n) for k, n in enumerate(("p_calm", "p_usual", "p_stressed"))], r6(F.exp("lrv13")).alias("vol13"))


@query()
def regime_event_card(spark, d):
    """How well the regimes foretell events: Brier score and skill over the past rate and over
    a random walk, log loss and area under the curve, by target and number of states."""
    out = None
    for k in (2, 3):
        e = staged(_event_probabilities(spark, d, k).filter("y is not null"), "events")
        w = W.partitionBy("target")
        ranks = e.withColumn("rk", F.rank().over(w.orderBy("p")) + (F.count(F.lit(1)).over(W.partitionBy("target", "p")) - 1) / 2)
        sq = lambda c: F.avg((F.col(c) - F.col("y")) * (F.col(c) - F.col("y")))
        pc, y = F.greatest(F.lit(0.005), F.least(F.lit(0.995), F.col("p"))), F.col("y")
        up, down = F.sum("y"), F.sum(1 - y)
        card = ranks.groupBy("target").agg(
            F.count(F.lit(1)).alias("n"), up.cast("long").alias("events"), r6(F.avg("y")).alias("rate"), r6(sq("p")).alias("brier"), r6(1 - ratio(sq("p"), sq("base"))).alias("skill_base"), r6(1 - ratio(sq("p"), sq("walk"))).alias("skill_walk"),
            r6(-F.avg(y * F.ln(pc) + (1 - y) * F.ln(1 - pc))).alias("logloss"), r6(ratio(F.sum(F.col("rk") * y) - up * (up + 1) / 2, up * down)).alias("auc"),
        ).select(F.lit(k).alias("states"), "*")
        out = card if out is None else out.unionByName(card)
    return out


@query()
def regime_reliability(spark, d):
    """Said and observed frequencies by bin of the probability, three states."""
    e = _event_probabilities(spark, d, 3).filter("y is not null")
    p = F.col("p")
    label = F.when(p < 0.05, "0.00-0.05").when(p < 0.15, "0.05-0.15").when(p < 0.3, "0.15-0.30").when(p < 0.5, "0.30-0.50").otherwise("0.50-1.00")
    return e.groupBy("target", label.alias("bin")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("said"), r6(F.avg("y")).alias("came"))
