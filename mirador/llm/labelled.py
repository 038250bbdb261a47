"""What the two classifiers share: hold-out and labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id has none."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int) -> DataFrame:
    """doc_id, text and y for at most ``limit`` documents of each label, chosen by a hash of
    doc_id among the rows that may be learned from. The bound is ``limit``; a doc_id with
    several labels has the larger, and one with several rows the text of the smallest hash;
    only the chosen ids (no texts) are ordered, and the texts are found by a broadcast of at
    most 2 x ``limit`` ids."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).filter(learn)
    pick = lambda y: known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id")).limit(limit)
    chosen = pick(0).unionByName(pick(1))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text"))
