"""Episodes chosen from a calendar, newness of texts, and rows set apart."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..operators import episodes as E
from ..operators import isolation as I
from ..operators import novelty as N
from ..sources import views as V
from . import sql as S
from .catalog import query
from .estimators import _SQL, _XS, _feats
from .stages import weekly_grid

_GAP = 2


@query(f"""{_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, c AS (SELECT symbol, ix AS s, ix + 2 + v % 12 AS e FROM grid WHERE price IS NOT NULL),
r AS (SELECT symbol, -1 AS place, NULL::BIGINT AS s, -1000::BIGINT AS e FROM (SELECT DISTINCT symbol FROM c) UNION ALL SELECT r.symbol, r.place + 1, n.x.s, n.x.e FROM r, LATERAL (SELECT arg_min({{'s': c.s, 'e': c.e}}, (c.e, -c.s)) AS x FROM c WHERE c.symbol = r.symbol AND c.s > r.e + {_GAP}) n WHERE n.x IS NOT NULL)
SELECT symbol, s AS start_ix, e::BIGINT AS end_ix, place::INT AS place FROM r WHERE place >= 0""")
def episodes_selected(spark, d):
    """As many episodes of a symbol as fit without overlap, two sessions apart; their lengths vary."""
    g = weekly_grid(spark, d).filter("price is not null").select("symbol", F.col("ix").alias("start_ix"), (F.col("ix") + 2 + F.col("v") % 12).alias("end_ix"))
    return E.non_overlapping(g, ["symbol"], "start_ix", "end_ix", gap=_GAP)


@query(f"""WITH {S.GRID}, s AS (SELECT DISTINCT symbol % 3 AS split, ix FROM grid WHERE price IS NOT NULL), k AS (SELECT split, ix, row_number() OVER (PARTITION BY split ORDER BY ix) - 1 AS k, count(*) OVER (PARTITION BY split) AS n FROM s)
SELECT split, ix AS start_ix, i::INT AS place FROM k JOIN (SELECT unnest(range(12)) AS i) p ON k.k = (i * (n - 1)) // 11 WHERE n >= 12""")
def episode_starts(spark, d):
    """Twelve starts of each split, evenly spread over its sessions."""
    g = weekly_grid(spark, d).filter("price is not null").select((F.col("symbol") % 3).alias("split"), F.col("ix").alias("start_ix"))
    return E.even_starts(g, ["split"], "start_ix", 12)


_HOURS = 12


@query(f"""WITH i AS (SELECT vec_id AS id, label AS symbol, epoch_us(ts) // 1000000 AS t, embedding::DOUBLE[] AS v FROM embeddings JOIN events ON event_id = vec_id)
SELECT a.id, {S.r6('greatest(0, least(1, coalesce(1 - max(list_dot_product(a.v, b.v)), 1)))')} AS novelty, count(b.id)::BIGINT AS seen FROM i a LEFT JOIN i b ON b.symbol = a.symbol AND b.t < a.t AND b.t >= a.t - {_HOURS * 3600} GROUP BY a.id""")
def novelty_in_time(spark, d):
    """One less the highest cosine with the symbol's items of the twelve hours before."""
    e = V.table(spark, d, "events").select(F.col("event_id").alias("vec_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    items = V.table(spark, d, "embeddings").join(e, "vec_id").select(F.col("vec_id").alias("id"), F.col("label").alias("symbol"), "at", F.col("embedding").alias("v"))
    return N.novelty(items, window=_HOURS * 3600).select("id", r6(F.col("novelty")).alias("novelty"), "seen")


def isolated(spark, d):
    """Rows with robust scores of their features, their isolation, and whether a fall came."""
    f = _feats(spark, d)
    mid = f.agg(*[F.percentile(x, 0.5).alias(f"m_{x}") for x in _XS])
    far = f.join(F.broadcast(mid)).select("symbol", "ix", "t", *_XS, *[(F.col(x) - F.col(f"m_{x}")).alias(f"d_{x}") for x in _XS])
    wide = far.agg(*[(1.4826 * F.percentile(F.abs(f"d_{x}"), 0.5)).alias(f"s_{x}") for x in _XS])
    z = lambda x: F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col(f"d_{x}") / F.when(F.col(f"s_{x}") > 0, F.col(f"s_{x}")).otherwise(1.0)))
    rows = far.join(F.broadcast(wide)).select("symbol", "ix", *[z(x).alias(f"z_{x}") for x in _XS], (F.col("t") < -0.3).cast("int").alias("fell"))
    names = [f"z_{x}" for x in _XS]
    return I.fit(rows, names, ["symbol", "ix"]).score(rows), names


@query()
def isolation_scores(spark, d):
    """How far apart a row stands: isolation by random cuts, and its robust distance."""
    rows, names = isolated(spark, d)
    return rows.select("symbol", "ix", r6(F.col("isolation")).alias("isolation"), r6(F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)) / len(names))).alias("distance"), "fell")


@query()
def isolation_card(spark, d):
    """By which of two scores rows before a fall stand out: area under the curve, and the rate
    of falls in the top twentieth against that of all."""
    s = isolation_scores(spark, d).unpivot(["symbol", "ix", "fell"], ["isolation", "distance"], "score", "x")
    w, y = W.partitionBy("score"), F.col("fell")
    k = s.withColumns({"rk": F.rank().over(w.orderBy("x")) + (F.count(F.lit(1)).over(W.partitionBy("score", "x")) - 1) / 2, "n": F.count(F.lit(1)).over(w)})
    up, down = F.sum(y), F.sum(1 - y)
    top = F.avg(F.when(F.col("rk") > 0.95 * F.col("n"), y))
    return k.groupBy("score").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(y)).alias("rate"), r6(top).alias("top_rate"), r6(F.try_divide(F.sum(F.col("rk") * y) - up * (up + 1) / 2, up * down)).alias("auc"))
