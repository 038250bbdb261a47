"""Operator 11: a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``points`` places on a ring of 64-bit hashes; a row goes to the first place
clockwise from the hash of its doc_id, and from a shard that is full on to the next place.
A shard is full at ceil((1 + slack) * rows / shards) rows; with ``slack`` 0 the first
``rows % shards`` shards take one row more than the others, so counts are at most one apart.

Rows meet the places in waves: in wave w the rows of each arc, in the order of the ring and
among equals of (position, doc_id, checksum, size), ask the w-th place after their own. So
only the count of rows of each arc is needed to know which ranks of which arc go where: a
table of at most arcs + shards stretches, whatever the number of rows, that the driver fills
and every task gets. Ranks come from counts of small cells of an arc. Rows equal in doc_id,
checksum and size are one row with a count until the end, so a doc_id that a third of all
rows share is no hot task.

Edge cases: a null text has no bytes (size 1, checksum 0); a null doc_id is a key like any
other; repeated rows have slots of their own; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_dir, staged

#: The ring's places are found by the top bits of a position.
TOP_BITS = 10
#: Rows of a cell, about; and rows that a repeated row is cut to.
CELL_ROWS, COPIES = 50_000, 50_000


class Stretch(NamedTuple):
    """Ranks lo to hi - 1 of an arc go to ``shard``, from ``slot`` on, ``walked`` places on."""

    arc: int
    lo: int
    hi: int
    shard: int
    slot: int
    walked: int


def places(shards: int, points: int) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise. One more shard adds places and
    moves none."""
    at = lambda s, k: int.from_bytes(hashlib.blake2b(f"{s}:{k}".encode(), digest_size=8).digest(), "little", signed=True)
    return sorted((at(s, k), s) for s in range(shards) for k in range(points))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [math.ceil((1 + slack) * rows / shards)] * shards


def fill(counts: Sequence[int], owners: Sequence[int], room: Sequence[int]) -> list[Stretch]:
    """The waves, by counts alone."""
    left, free, used = list(counts), list(room), [0] * len(room)
    open_, out = [a for a, n in enumerate(left) if n], []
    for walked in range(len(owners)):
        for a in open_:
            s = owners[(a + walked) % len(owners)]
            if take := min(left[a], free[s]):
                lo = counts[a] - left[a]
                out.append(Stretch(a, lo, lo + take, s, used[s], walked))
                left[a], free[s], used[s] = left[a] - take, free[s] - take, used[s] + take
        open_ = [a for a in open_ if left[a]]
    return out


def _arcs(spark: SparkSession, ring: list[tuple[int, int]]) -> DataFrame:
    """(top, first, inside): by the top bits of a position the places before them, and those
    with them."""
    width = 64 - TOP_BITS
    tops = range(-(1 << (TOP_BITS - 1)), 1 << (TOP_BITS - 1))
    held: dict[int, list[int]] = {t: [] for t in tops}
    for at, _ in ring:
        held[at >> width].append(at)
    rows, first = [], 0
    for t in tops:
        rows.append((t, first, held[t]))
        first += len(held[t])
    return spark.createDataFrame(rows, "top long, first int, inside array<long>")


def keyed(docs: DataFrame, ring: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, size, text_crc32, pos, arc), a row a document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    own = own.withColumn("pos", F.xxhash64(F.lit("ring"), "doc_id")).withColumn("top", F.shiftright("pos", 64 - TOP_BITS))
    met = own.join(F.broadcast(_arcs(docs.sparkSession, ring)), "top")  # 2 ** TOP_BITS rows
    before = F.col("first") + F.size(F.filter("inside", lambda p: p < F.col("pos")))
    return met.select("doc_id", "size", "text_crc32", "pos", F.pmod(before, F.lit(len(ring))).alias("arc"))


def stretches(docs: DataFrame, *, shards: int, points: int, slack: float) -> DataFrame:
    """(doc_id, size, text_crc32, pos, lo, hi, shard, slot, home_shard, walked): stretches of
    equal rows and where they go, from ``slot`` on."""
    spark = docs.sparkSession
    ring = places(shards, points)
    owners = [s for _, s in ring]
    rows = staged(keyed(docs, ring), "keyed")
    n = rows.count()
    bits = min(40, max(0, math.ceil(math.log2(max(1, n / CELL_ROWS)))))
    cell = F.shiftright("pos", 63 - bits)
    same = ["pos", "doc_id", "text_crc32", "size"]
    classes = staged(rows.withColumn("cell", cell).groupBy("arc", "cell", *same).agg(F.count(F.lit(1)).alias("m")), "classes")
    cells = staged(classes.groupBy("arc", "cell").agg(F.sum("m").alias("m")), "cells")
    counts = [0] * len(ring)
    for r in cells.groupBy("arc").agg(F.sum("m").alias("m")).collect():  # a row an arc
        counts[r.arc] = r.m
    plan = spark.createDataFrame(fill(counts, owners, capacities(n, shards, slack)) or [], "at int, lo long, hi long, shard int, slot long, walked int")
    before = F.coalesce(F.sum("m").over(W.partitionBy("arc").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = cells.select("arc", "cell", before.alias("start"))
    within = F.coalesce(F.sum("m").over(W.partitionBy("arc", "cell").orderBy(*same).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = classes.withColumn("within", within).join(starts, ["arc", "cell"]).withColumn("rank", F.col("start") + F.col("within"))
    met = ranked.join(F.broadcast(plan), (F.col("arc") == F.col("at")) & (F.col("lo") < F.col("rank") + F.col("m")) & (F.col("hi") > F.col("rank")))  # at most arcs + shards rows
    lo = F.greatest("lo", "rank")
    home = F.element_at(F.lit(owners).cast("array<int>"), F.col("arc") + 1)
    return met.select("doc_id", "size", "text_crc32", "pos", lo.alias("lo"), F.least("hi", F.col("rank") + F.col("m")).alias("hi"), "shard", (F.col("slot") + lo - F.col("lo")).alias("slot"), home.alias("home_shard"), "walked")


def place(docs: DataFrame, *, shards: int = 16, points: int = 64, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 in a shard), home_shard (the
    ring's own, without bounds) and walked (places passed), a row a document."""
    found = staged(stretches(docs, shards=shards, points=points, slack=slack), "stretches")
    part = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(COPIES).cast("long")))
    parts = found.withColumn("from", part).withColumn("to", F.least("hi", F.col("from") + COPIES))
    if (found.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0) > COPIES:
        parts = parts.repartition("pos", "from")
    rows = parts.withColumn("at", F.explode(F.sequence("from", F.col("to") - 1)))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("at") - F.col("lo")).alias("slot"), "home_shard", "walked")


def moved(docs: DataFrame, *, shards: int, points: int = 64, slack: float = 0.0) -> DataFrame:
    """(rows, moved): rows that another shard holds once there is one shard more. Rows equal
    in doc_id, checksum and size count as they are in number on each shard."""
    count = lambda n, name: place(docs, shards=n, points=points, slack=slack).groupBy("doc_id", "size", "text_crc32", "shard").agg(F.count(F.lit(1)).alias(name))
    old, new = count(shards, "was").alias("old"), count(shards + 1, "now").alias("new")
    same = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in ("doc_id", "size", "text_crc32", "shard")]
    stay = F.coalesce(F.least("was", "now"), F.lit(0))
    return old.join(new, same, "left").agg(F.sum("was").alias("rows"), F.sum(F.when(F.col("now").isNull(), F.col("was")).otherwise(F.col("was") - stay)).alias("moved"))


def write_shards(docs: DataFrame, *, shards: int = 16, points: int = 64, slack: float = 0.0, folder: str | None = None) -> str:
    """Parquet files of (doc_id, text, slot) in a folder a shard, in the order of slots."""
    folder = folder or fresh_dir(docs.sparkSession, "shards")
    placed = place(docs, shards=shards, points=points, slack=slack).alias("p")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    texts = texts.groupBy("doc_id", "size", "text_crc32").agg(F.first("text").alias("text")).alias("t")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "size", "text_crc32")]
    rows = placed.join(texts, same).select("p.doc_id", "t.text", "p.slot", "p.shard")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
    return folder
