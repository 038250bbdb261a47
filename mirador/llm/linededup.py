"""Operator 5: line deduplication, in DataFrame functions alone.

A line is known by a 128-bit hash of its key (spaces stripped at both ends, A-Z
lower-cased). Every text is hashed once, to a table of its lines' hashes. Each document's
distinct hashes, with the place where it has them first, are combined to one row a hash and
salt (documents, first document and position), so a line that a third of all rows share is
a few rows. Those are range-partitioned by hash, with a secondary sort by document and
position, and streamed: the first row of a hash is its first occurrence, the sum over its
rows its documents. The verdicts meet the positions of such lines, and what comes back per
document is a run-length compressed bitmap of the lines to keep, not text; ``apply_bitmap``
puts it to a text.

Range-partitioning the raw lines instead would send every copy of a hot line to one task,
so they are combined first.

Two rules: ``drop`` = "all" removes every occurrence of a line found in at least
``min_docs`` documents; "later" keeps its first occurrence in (doc_id, position) order.

Edge cases: a null or empty text is one empty line; keys shorter than ``min_chars`` are
always kept; every row is a document, and rows that agree in doc_id and text get the same
answer; a null doc_id is a value like any other; an empty table gives no rows; other columns
stay as they are, whatever their names, but ``dedup_documents`` replaces ``n_lines`` and
``n_dropped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_SPACE, ascii_lower, staged

#: Rows that a hash can have at most after combining.
SALTS = 16


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def hashes(docs: DataFrame, *, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, n_lines, keys): per line its hash (h, g), or null where the key
    is too short to count."""
    text = F.col("text").cast("string")
    key = lambda line: F.btrim(line, F.lit(ASCII_SPACE))
    hashed = lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit("line"), k).alias("g")))
    lowered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash().alias("text_hash"), F.transform(lines_of(ascii_lower(text)), key).alias("lines"))
    return staged(lowered.select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.transform("lines", hashed).alias("keys")), "hashes")


def verdicts(hashed: DataFrame, *, min_docs: int) -> DataFrame:
    """(h, g, n_docs, first): lines of at least ``min_docs`` documents, and the document and
    position that has each first."""
    placed = F.sort_array(F.filter(F.transform("keys", lambda k, i: F.when(k.isNotNull(), F.struct(k["h"].alias("h"), k["g"].alias("g"), i.alias("pos")))), lambda x: x.isNotNull()))
    own = hashed.select("doc_id", "text_hash", placed.alias("p"))
    new = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1)["h"] != x["h"]) | (F.get("p", i - 1)["g"] != x["g"]))
    seen = own.select("doc_id", "text_hash", F.explode(new).alias("k")).select("k.h", "k.g", F.pmod("text_hash", F.lit(SALTS)).alias("salt"), F.struct("doc_id", "text_hash", "k.pos").alias("at"))
    combined = seen.groupBy("h", "g", "salt").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    ordered = combined.repartitionByRange("h", "g").sortWithinPartitions("h", "g", "at")
    stream = W.partitionBy("h", "g").orderBy("at")
    streamed = ordered.select("h", "g", F.col("at").alias("first"), F.row_number().over(stream).alias("nth"), F.sum("n").over(stream.rowsBetween(W.currentRow, W.unboundedFollowing)).alias("n_docs"))
    return staged(streamed.filter((F.col("nth") == 1) & (F.col("n_docs") >= min_docs)).select("h", "g", "n_docs", "first"), "verdicts")


def keep_bitmaps(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, drop: str = "all") -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep) for the documents that lose a line; the others
    keep all. ``keep`` is the bitmap by its runs of ones: (at, n) for n lines from line at."""
    hashed = hashes(docs, min_chars=min_chars)
    found = verdicts(hashed, min_docs=min_docs)
    lines = hashed.select("doc_id", "text_hash", "n_lines", F.posexplode("keys").alias("pos", "k")).filter("k is not null").select("doc_id", "text_hash", "n_lines", "pos", "k.h", "k.g")
    hit = lines.join(found.select("h", "g", "first"), ["h", "g"])
    if drop == "later":
        hit = hit.filter(~F.struct("doc_id", "text_hash", "pos").eqNullSafe(F.col("first")))
    gone = hit.groupBy("doc_id", "text_hash").agg(F.first("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("gone"))
    ends = gone.select("doc_id", "text_hash", F.size("gone").cast("long").alias("n_dropped"), F.concat(F.array(F.lit(-1)), "gone", F.array("n_lines")).alias("e"))
    runs = F.transform(F.slice("e", 1, F.size("e") - 1), lambda x, i: F.struct((x + 1).alias("at"), (F.get("e", i + 1) - x - 1).alias("n")))
    return ends.select("doc_id", "text_hash", "n_dropped", F.filter(runs, lambda r: r["n"] > 0).alias("keep"))


def apply_bitmap(text: Column, keep: Column) -> Column:
    """The kept lines joined by \\n; a null bitmap keeps all. All lines gone: an empty text."""
    kept = F.flatten(F.transform(keep, lambda r: F.slice(lines_of(text), r["at"] + 1, r["n"])))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def _marked(docs: DataFrame, **options) -> DataFrame:
    """(own: the row as it was, text, n_dropped, keep)."""
    marks = keep_bitmaps(docs, **options).withColumnRenamed("doc_id", "id")
    own = docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_hash().alias("row_hash"))
    return own.join(marks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash")), "left").select("own", "text", "n_dropped", "keep")


def drop_lines(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, drop: str = "all") -> DataFrame:
    """``docs`` with ``text`` less the dropped lines, and no other change."""
    marked = _marked(docs, min_docs=min_docs, min_chars=min_chars, drop=drop)
    return marked.select(*[apply_bitmap(F.col("text"), F.col("keep")).alias(c) if c.lower() == "text" else F.col("own")[c].alias(c) for c in docs.columns])


def dedup_documents(docs: DataFrame, *, min_docs: int = 10, min_chars: int = 1, drop: str = "all") -> DataFrame:
    """As ``drop_lines``, with ``n_lines`` and ``n_dropped`` (before them) for columns."""
    marked = _marked(docs, min_docs=min_docs, min_chars=min_chars, drop=drop)
    others = [F.col("own")[c].alias(c) for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    n_lines = F.size(lines_of(F.col("text"))).cast("long")
    return marked.select(*others, apply_bitmap(F.col("text"), F.col("keep")).alias("text"), n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"))
