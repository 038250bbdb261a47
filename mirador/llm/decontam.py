"""Operator 6: benchmark decontamination by greedy string tiling.

Texts are lower-cased words. Five-word windows of the benchmark items are the seeds; a
document meets an item where they share one. On such pairs running Karp-Rabin works down:
the longest common run of words that no tile covers yet becomes a tile, again and again,
until none of ``min_match`` words is left. The share of an item's words under tiles is its
coverage; because tiles may lie in any order, reordered passages are caught too.

The benchmark is read in blocks of at most ``block_seeds`` windows (a bound on what each
task holds, about 100 MB); every block meets all documents, so a larger benchmark costs more
passes and no case is left out. Nothing of the documents is shuffled.

Edge cases: items of fewer than ``min_match`` words can't be matched and flag nothing; null
and empty texts match nothing; repeated items and documents are judged row by row (equal
rows give equal answers, one per (doc_id, item_id)); null ids stay null; empty tables give
no matches; other columns stay as they are in ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
MATCH = "doc_id long, text_hash long, item_id long, coverage double, longest int, tiles int"


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin values of all windows of ``size`` words, modulo 2**64."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(1)) * BASE
        x ^= x >> np.uint64(29)
        for k in range(size):
            h = h * BASE + x[k : k + n]
    return h


def tiles(a: np.ndarray, b: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (place in a, place in b, length), longest
    first; of equals, the first in a, then in b.

    Karp-Rabin values of ``min_match``-word windows give the common windows; neighbours on
    a diagonal join to maximal runs. The longest run becomes a tile if nothing covers it;
    what earlier tiles leave of a run goes back among the runs.
    """
    ha, hb = windows(a, min_match), windows(b, min_match)
    where: dict[int, list[int]] = {}
    for i, h in enumerate(ha.tolist()):
        where.setdefault(h, []).append(i)
    pairs = [(j - i, i) for j in np.flatnonzero(np.isin(hb, ha)).tolist() for i in where[int(hb[j])] if (a[i : i + min_match] == b[j : j + min_match]).all()]
    runs: dict[int, list[tuple[int, int]]] = {}
    pairs.sort()
    for k, (d, i) in enumerate(pairs):
        if k and pairs[k - 1] == (d, i - 1):
            i0, j0, n = last
            last = (i0, j0, n + 1)
        else:
            if k:
                runs.setdefault(last[2], []).append(last[:2])
            last = (i, i + d, min_match)
    if pairs:
        runs.setdefault(last[2], []).append(last[:2])
    done_a, done_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    out = []
    while runs:
        size = max(runs)
        for i, j in sorted(runs.pop(size)):
            taken = done_a[i : i + size] | done_b[j : j + size]
            if not taken.any():
                done_a[i : i + size] = done_b[j : j + size] = True
                out.append((i, j, size))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate(([1], taken, [1]))))
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if e - s >= min_match:
                    runs.setdefault(e - s, []).append((i + s, j + s))
    return out


class Benchmark:
    """A block of items: its words' numbers and its seeds."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int):
        self.min_match = min_match
        self.number: dict[str, int] = {}
        self.items: list[tuple[int | None, np.ndarray]] = []
        seeds, owners = [], []
        for item_id, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number)) for w in words_of(text)], np.int64)
            h = windows(ids, min_match)
            if len(h):
                owners.append(np.full(len(h), len(self.items)))
                self.items.append((item_id, ids))
                seeds.append(h)
        joined, own = (np.concatenate(seeds), np.concatenate(owners)) if seeds else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = joined.argsort(kind="stable")
        self.seeds, self.owners = joined[order], own[order]

    def matches(self, text: str | None) -> Iterator[tuple[int | None, float, int, int]]:
        """(item_id, coverage, longest tile, tiles) for the items that share a seed."""
        get = self.number.get
        ids = np.array([get(w, -1) for w in words_of(text)], np.int64)
        h = windows(ids, self.min_match)
        if not len(h) or not len(self.seeds):
            return
        lo, hi = np.searchsorted(self.seeds, h, "left"), np.searchsorted(self.seeds, h, "right")
        found = {int(o) for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True) for o in self.owners[a:b]}
        for k in sorted(found):
            item_id, item = self.items[k]
            got = tiles(item, ids, self.min_match)
            if got:
                yield item_id, sum(n for _, _, n in got) / len(item), got[0][2], len(got)


def blocks(benchmark: DataFrame, min_match: int, block_seeds: int) -> Iterator[Benchmark]:
    """The items, streamed to the driver and cut into blocks by their count of windows."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        held.append(tuple(r))
        size += len(words_of(r[1]))
        if size >= block_seeds:
            yield Benchmark(held, min_match)
            held, size = [], 0
    if held:
        yield Benchmark(held, min_match)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, min_match: int = 5, coverage: float = 0.6, block_seeds: int = 1_000_000) -> DataFrame:
    """The (document, item) pairs whose coverage reaches the threshold."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark, min_match, block_seeds):
        shared = spark.sparkContext.broadcast(block)  # bounded by block_seeds

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            test = shared.value
            for b in batches:
                rows = []
                for doc_id, h, text in zip(b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist(), b.column("text"), strict=True):
                    rows += [(doc_id, h, *m) for m in test.matches(text.as_py()) if m[1] >= coverage]
                cols = list(zip(*rows, strict=True)) or [()] * 6
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "text_hash", "item_id", "coverage", "longest", "tiles"])

        found = own.mapInArrow(run, MATCH)
        if out is not None:  # one pass over the documents a block, written as it ends
            found = out.unionByName(found)
        out = staged(found, "contaminated")
    return out if out is not None else spark.createDataFrame([], MATCH)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` less the contaminated documents, its columns as they are."""
    hits = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    own = docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("own_hash"))
    return own.join(hits, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left_anti").select("own.*")
