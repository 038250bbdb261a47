"""Finite tables through streams with state and timers, equal to batch."""

from pyspark.sql import functions as F

from ..functions.scalars import r6
from ..sources import views as V
from . import sql as S
from .catalog import query


@query("""SELECT event_type AS sleeve, make_timestamp((epoch_us(ts) // 10800000000 + 1) * 10800000000) AS look, count(*)::BIGINT AS n, sum(floor(value * 100)::BIGINT)::BIGINT AS cents, min(event_id)::BIGINT AS first_id FROM events WHERE ts IS NOT NULL GROUP BY ALL""")
def stream_look_reports(spark, d):
    """What each sleeve hears at its three-hourly looks: every execution once, though records
    come out of order and repeatedly, over several micro-batches with a timer a look."""
    from ..streaming.stateful import run_look_reports

    e = V.table(spark, d, "events").filter("ts is not null")
    own = e.select(F.col("event_type").alias("sleeve"), F.col("event_id").alias("exec_id"), "ts", F.floor(F.col("value") * 100).cast("long").alias("cents"))
    return run_look_reports(spark, own).select("sleeve", F.col("look").cast("timestamp_ntz").alias("look"), "n", "cents", "first_id")


@query(f"""WITH {S.BARS}, cut AS (SELECT min(session) AS a FROM bars), old AS (SELECT symbol, session, c FROM bars, cut WHERE session <= a + 20), new AS (SELECT symbol, session, CASE WHEN symbol % 4 = 0 THEN c * 1.001 ELSE c END AS c FROM bars, cut WHERE session >= a + 15),
base AS (SELECT DISTINCT o.symbol FROM old o JOIN new n ON n.symbol = o.symbol AND n.session = o.session WHERE o.c <> 0 AND abs(n.c / o.c - 1) > 0.0005)
SELECT symbol, session, {S.r6('c')} AS c, symbol IN (SELECT symbol FROM base) AS rebased FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE symbol NOT IN (SELECT symbol FROM base) AND NOT EXISTS (SELECT 1 FROM new n WHERE n.symbol = old.symbol AND n.session = old.session))""")
def stream_bar_store(spark, d):
    """Histories of symbols from overlapping updates in three batches; where an update tells of
    another basis the history starts anew."""
    from ..streaming.stateful import run_bar_store

    bars = V.bars_daily(spark, d).select("symbol", "session", "c")
    bars = bars.join(F.broadcast(bars.agg(F.min("session").alias("a")))).withColumn("k", F.datediff("session", "a"))
    moved = F.when(F.col("symbol") % 4 == 0, F.col("c") * 1.001).otherwise(F.col("c"))
    cut = lambda lo, hi, c, part: bars.filter((F.col("k") >= lo) & (F.col("k") <= hi)).select("symbol", "session", c.alias("c"), F.lit(part).alias("version"), F.lit(part).alias("part"))
    updates = cut(0, 20, F.col("c"), 0).unionByName(cut(15, 24, moved, 1)).unionByName(cut(22, 10_000, moved, 2))
    return run_bar_store(spark, updates).select("symbol", "session", r6(F.col("c")).alias("c"), "rebased")
