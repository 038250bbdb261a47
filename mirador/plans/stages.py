"""Panels as stages of named expressions over a view.

A stage is a table of name to expression in the SQL that Spark and DuckDB share; later
stages see the columns of earlier ones. Spark gets them as projections, so Catalyst merges
them and plans the windows by their partitioning; the oracle gets them as common table
expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import views as V
from .catalog import ORACLES, QUERIES
from .sql import r6

Stage = dict[str, str]


def over(n: int | str, end: int | str = 0, by: str = "symbol", order: str = "ix") -> str:
    """Rows of the ``n`` rows that end ``end`` rows after this one ("all": unbounded)."""
    bound = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    first = "UNBOUNDED PRECEDING" if n == "all" else bound(end - n + 1)
    last = "UNBOUNDED FOLLOWING" if end == "all" else bound(end)
    return f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {first} AND {last})"


def lag(x: str, n: int = 1, by: str = "symbol", order: str = "ix") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order})"


def ahead(x: str, n: int = 1, by: str = "symbol", order: str = "ix") -> str:
    return f"lead({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order})"


def ln(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def mean(x: str, n: int, least: int, end: int = 0, agg: str = "avg", by: str = "symbol") -> str:
    """An aggregate of the frame where at least ``least`` of its values are there."""
    w = over(n, end, by)
    return f"CASE WHEN count({x}) {w} >= {least} THEN {agg}({x}) {w} END"


def rank(x: str, least: int = 10, by: str = "session", key: str = "symbol") -> str:
    """Ordinal rank / (n - 1) - 0.5 among the valid values of a session, ties by key."""
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER (PARTITION BY {by}) > {least} THEN (row_number() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST, {key}) - 1) / (count({x}) OVER (PARTITION BY {by}) - 1e0) - 0.5 END"


def apply(df: DataFrame, *stages: Stage) -> DataFrame:
    for stage in stages:
        df = df.withColumns({n: F.expr(e) for n, e in stage.items()})
    return df


def chain(base: str, source: str, *stages: Stage) -> str:
    """Common table expressions t0, t1 ... over ``source`` of the expressions ``base``."""
    out, here = [base], source
    for k, stage in enumerate(stages):
        out.append(f"t{k} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {here})")
        here = f"t{k}"
    return "WITH " + ", ".join(out)


def panel(name: str, doc: str, view, base: str, source: str, stages: list[Stage], keys: list[str], values: list[str], where: str = "true") -> None:
    """Register ``keys`` and the rounded ``values`` of the last stage."""

    def run(spark, d):
        return apply(view(spark, d), *stages).filter(where).selectExpr(*keys, *[f"{r6(v)} AS {v}" for v in values])

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLES[name] = f"{chain(base, source, *stages)} SELECT {', '.join(keys)}, {', '.join(f'{r6(v)} AS {v}' for v in values)} FROM t{len(stages) - 1} WHERE {where}"


# --- the views that panels stand on -------------------------------------------------------


def daily_grid(spark, d) -> DataFrame:
    """Every symbol on every day: o, h, l, c, v, null where it has no bar."""
    return V.aligned(V.bars_daily(spark, d))


def weekly_grid(spark, d) -> DataFrame:
    return V.aligned(V.weekly(spark, d))


def slots(spark, d) -> DataFrame:
    """Bars of three hours by event type: symbol (the type), session, slot 0..7."""
    return V.bars_of(V.ticks(spark, d).withColumn("symbol", F.col("event_type")), "symbol", F.to_date("ts").alias("session"), F.expr("int(hour(ts) div 3)").alias("slot"))


def _spark(e: str) -> str:
    """The few words in which the two dialects differ, in Spark's."""
    e = re.sub(r"daynum\((\w+)\)", r"unix_date(\1)", e.replace("\\", "\\\\"))
    e = re.sub(r"sha256\((\w+)\)", r"sha2(\1, 256)", e)
    return e.replace("isodow(", "1 + weekday(").replace("rxcount(", "regexp_count(")


def _duck(e: str) -> str:
    e = re.sub(r"daynum\((\w+)\)", r"(\1 - DATE '1970-01-01')", e)
    e = re.sub(r"rxcount\((\w+), ('[^']*')\)", r"len(regexp_extract_all(\1, \2))::INT", e)
    return e.replace("rlike(", "regexp_matches(")


def rules(name: str, doc: str, table: str, keys: list[str], *stages: Stage, rounded: tuple[str, ...] = (), plain: tuple[str, ...] = (), where: str = "true") -> None:
    """Register column rules over a table: ``plain`` columns as they are, ``rounded`` ones at
    six decimals. Rules stay projections, so the scan reads only their columns."""
    spark_stages = [{n: _spark(e) for n, e in s.items()} for s in stages]
    duck_stages = [{n: _duck(e) for n, e in s.items()} for s in stages]

    def run(spark, d):
        return apply(V.table(spark, d, table), *spark_stages).filter(where).selectExpr(*keys, *plain, *[f"{r6(c)} AS {c}" for c in rounded])

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    body = chain(f"src AS (SELECT * FROM {table})", "src", *duck_stages)
    ORACLES[name] = f"{body} SELECT {', '.join([*keys, *plain, *(f'{r6(c)} AS {c}' for c in rounded)])} FROM t{len(stages) - 1} WHERE {where}"
