"""Episodes that do not overlap, and starts spread evenly over a calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def non_overlapping(episodes: DataFrame, by: Sequence[str], start: str, end: str, *, gap: int = 0) -> DataFrame:
    """(by, start, end, place): as many episodes of each group as can be, none of which starts
    within ``gap`` sessions after the end of another: of those that may follow always the one
    that ends first, of several the latest start.

    Of the episodes that end in one session only the latest start can be chosen, so a group's
    fold is over at most one a session, however many episodes there are. Episodes with a null
    end, or that end before they start, are left out.
    """
    own = episodes.filter(F.col(end) >= F.col(start)).groupBy(*by, F.col(end).alias("e")).agg(F.max(start).alias("s"))
    rows = own.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("e").cast("long").alias("e"), F.col("s").cast("long").alias("s")))).alias("rows"))
    kind = "array<struct<e:bigint,s:bigint>>"

    def step(kept: Column, x: Column) -> Column:
        free = (F.size(kept) == 0) | (x["s"] > F.element_at(kept, -1)["e"] + gap)
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    # an episode may only follow the last one kept, so the fold looks at one element
    kept = rows.select(*by, F.aggregate("rows", F.array().cast(kind), step).alias("kept"))
    return kept.select(*by, F.posexplode("kept").alias("place", "x")).select(*by, F.col("x.s").alias(start), F.col("x.e").alias(end), "place")


def even_starts(episodes: DataFrame, by: Sequence[str], start: str, count: int) -> DataFrame:
    """(by, start, place): ``count`` of each group's distinct starts, evenly spread from the
    first to the last; groups with fewer starts give none."""
    if count < 2:
        raise ValueError("at least two starts")
    each = episodes.select(*by, start).dropna(subset=[start]).distinct()
    own = W.partitionBy(*by)
    ranked = each.withColumns({"_k": F.row_number().over(own.orderBy(start)) - 1, "_n": F.count(F.lit(1)).over(own)}).filter(F.col("_n") >= count)
    picks = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("place")
    sizes = ranked.filter("_k = 0").select(*by, "_n", picks).withColumn("_k", F.floor(F.col("place") * (F.col("_n") - 1) / (count - 1)).cast("int"))
    return ranked.drop("_n").join(sizes.drop("_n"), [*by, "_k"]).select(*by, start, "place")
