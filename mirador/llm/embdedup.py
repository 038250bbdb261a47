"""Operator 7: embedding near-dedup with an inverted multi-index.

Two codebooks, one for each half of a vector, are fitted on a bounded sample; their
product grid is the index, and every vector is stored in the cell of its two nearest
codewords. A query walks the cells by the multi-sequence order (rising sum of its halves'
distances) for as many cells as reached the target recall on the sample, however many. Pairs whose cells
are reached from either side are verified by cosine in double precision, block by block.

Equal vectors are one class with a multiplicity. A cell's members are cut into blocks of
about ``block`` classes and its queries into chunks, and a unit of work is a block and a
chunk: a hot cell is many units, no task holds a cell, and a unit returns degrees and a
spanning forest, never its pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and
those of another than the commonest dimension, link with nothing; a null vec_id names no
component unless alone; repeated rows are vectors of their own; an empty table gives none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components

UNIT = "cid long, links long, root long"


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Codewords by Lloyd's rounds from distinct random rows."""
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, words)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[count > 0] = sums[count > 0] / count[count > 0, None]
    return words


def distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)[None, :]


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(x[i : i + 4096], words).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def multi_sequence(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of places in two rising lists by rising sum, each pushed once both its
    predecessors are out."""
    heap, out = [(float(a[0] + b[0]), 0, 0)], set()
    while heap:
        _, i, j = heapq.heappop(heap)
        out.add((i, j))
        yield i, j
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in out):
            heapq.heappush(heap, (float(a[i + 1] + b[j]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in out):
            heapq.heappush(heap, (float(a[i] + b[j + 1]), i, j + 1))


class MultiIndex:
    def __init__(self, first: np.ndarray, second: np.ndarray, probes: int = 1):
        self.first, self.second, self.probes = first, second, probes

    def visits(self, x: np.ndarray, probes: int | None = None) -> list[list[int]]:
        """Per row of unit vectors the cells it visits, its own first."""
        h, k = self.first.shape[1], len(self.second)
        probes = min(probes or self.probes, len(self.first) * k)
        d1, d2 = distances(x[:, :h], self.first), distances(x[:, h:], self.second)
        o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
        out = []
        for n in range(len(x)):
            walk = multi_sequence(d1[n, o1[n, :probes]], d2[n, o2[n, :probes]])
            out.append([int(o1[n, i]) * k + int(o2[n, j]) for (i, j), _ in zip(walk, range(probes), strict=False)])
        return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so tiny and huge components survive squaring."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def leaders(x: np.ndarray, cosine: float) -> np.ndarray:
    """Rows no two of which are as near as ``cosine``, with every other row that near to one."""
    open_, kept = np.ones(len(x), bool), []
    for n in range(len(x)):
        if open_[n]:
            kept.append(n)
            open_ &= x @ x[n] < cosine
    return x[kept]


def steps(index: MultiIndex, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per pair of rows the cells that come before it is found, from the nearer side."""
    h, least = index.first.shape[1], np.full(len(a), np.iinfo(np.int64).max)
    some = max(1, (1 << 22) // (len(index.first) * len(index.second)))
    for q, x in ((a, b), (b, a)):
        for at in range(0, len(q), some):
            d1, d2 = distances(q[at : at + some, :h], index.first), distances(q[at : at + some, h:], index.second)
            i, j = nearest(x[at : at + some, :h], index.first), nearest(x[at : at + some, h:], index.second)
            n = np.arange(len(d1))
            before = (d1[:, :, None] + d2[:, None, :] < (d1[n, i] + d2[n, j])[:, None, None]).sum((1, 2))
            least[at : at + some] = np.minimum(least[at : at + some], before)
    return least


def fit(sample: np.ndarray, population: int, *, cosine: float, recall: float, cell_rows: int = 16) -> MultiIndex:
    """Codebooks for about ``cell_rows`` vectors a cell, and the probes that reach the
    target recall both on neighbours at exactly ``cosine`` from the sample's vectors (the
    hardest there are) and on the sample's own pairs.

    The codebooks are fitted on leaders of the sample: a large group of near vectors would
    draw codewords into itself and be spread over the cells between them."""
    x = unit(sample)
    far = leaders(x, cosine)
    h = max(1, x.shape[1] // 2)
    k = int(np.clip(round((population / cell_rows) ** 0.5), 1, max(1, len(far) // 8)))
    index = MultiIndex(kmeans(far[:, :h], k), kmeans(far[:, h:], k) if x.shape[1] > h else np.zeros((1, 0)))
    rng = np.random.default_rng(11)
    drawn = rng.choice(len(x), min(512, len(x)), replace=False)
    q = x[drawn]
    side = rng.standard_normal(q.shape)
    side -= (side * q).sum(1, keepdims=True) * q
    norm = np.sqrt((side * side).sum(1, keepdims=True))
    near = cosine * q + (1 - cosine**2) ** 0.5 * side / np.where(norm > 0, norm, 1)
    own = q @ x.T >= cosine
    own[np.arange(len(q)), drawn] = False
    a, b = np.nonzero(own)
    some = rng.permutation(len(a))[:4096]
    found = [steps(index, q, near)] + ([steps(index, q[a[some]], x[b[some]])] if len(a) else [])
    index.probes = max(int(np.quantile(f, recall, method="higher")) + 1 for f in found)
    return index


def verify(cell: int, members: dict, queries: dict, cosine: float) -> list[tuple[int, int, int | None]]:
    """Degrees and a spanning forest of one unit: a block of a cell's members and a chunk
    of the queries that visit the cell.

    Two vectors of one cell meet once in each role, and each time the query's degree
    grows. Vectors of two cells that visit each other meet in both cells and count in the
    lower; else they meet in one.
    """
    hit = unit(np.asarray(queries["v"])) @ unit(np.asarray(members["v"])).T >= cosine
    home = np.array(queries["cell"])
    own = home == cell
    hit &= ~(own[:, None] & (np.array(queries["cid"])[:, None] == np.array(members["cid"])[None, :]))
    for q in np.flatnonzero((home < cell) & hit.any(1)):
        back = np.flatnonzero(hit[q])
        hit[q, back[[home[q] in members["visits"][k] for k in back]]] = False
    dq, dm = hit @ np.array(members["m"]), (hit & ~own[:, None]).T @ np.array(queries["m"])
    ids, n = [*queries["cid"], *members["cid"]], len(own)
    links, root = [*dq.tolist(), *dm.tolist()], np.full(len(ids), -1)
    for s in np.flatnonzero(hit.any(1)):
        stack = [s] if root[s] < 0 else []
        while stack:
            here = stack.pop()
            root[here] = s
            side, off = (hit[here], n) if here < n else (hit[:, here - n], 0)
            new = np.flatnonzero(side) + off
            new = new[root[new] < 0]
            root[new] = s
            stack += new.tolist()
    return [(c, int(d), ids[r] if r >= 0 and ids[r] != c else None) for c, d, r in zip(ids, links, root.tolist(), strict=True) if d or r >= 0]


def _valid(v):
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda e: e != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, *, cosine: float = 0.9, recall: float = 0.97, sample: int = 8192, block: int = 256) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = rows.filter(_valid(F.col("embedding")))
    top = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    alone = lambda df: df.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if top is None:
        return alone(rows)
    ok = F.when(_valid(F.col("embedding")) & (F.size("embedding") == top.n), F.col("embedding"))
    keyed = rows.withColumn("embedding", ok).withColumn("h", F.when(ok.isNotNull(), F.xxhash64("embedding"))).withColumn("g", F.xxhash64(F.lit("vector"), "embedding"))
    keyed = staged(keyed, "vectors")
    classes = keyed.filter("h is not null").groupBy("h", "g").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"), F.first("embedding").alias("v"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    drawn = classes.select("h", "v").orderBy("h").limit(sample).collect()  # bounded: the fit's sample
    index = fit(np.array([r.v for r in drawn]), classes.count(), cosine=cosine, recall=recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            visits = index.visits(unit(np.array(b.column("v").to_pylist()))) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("m"), b.column("v"), pa.array([v[0] for v in visits], pa.int64()), pa.array(visits, pa.list_(pa.int64()))], ["cid", "m", "v", "cell", "visits"])

    vector = classes.schema["v"].dataType.simpleString()
    placed = staged(classes.select("cid", "m", "v").mapInArrow(walk, f"cid long, m long, v {vector}, cell long, visits array<long>"), "placed")
    ceil = lambda rows: F.ceil(F.count(F.lit(1)) / rows).cast("int")
    part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    visit = placed.select("cid", "m", "v", F.col("cell").alias("home"), F.explode("visits").alias("cell"))
    sizes = placed.groupBy("cell").agg(ceil(block).alias("ni"))
    sizes = staged(sizes.join(visit.select("cell").groupBy("cell").agg(ceil(4 * block).alias("nj")), "cell"), "cells")
    # block i of a cell's members meets chunk j of its queries; only hot cells have several
    members = placed.join(sizes, "cell").withColumn("i", some("ni")).withColumn("j", part("nj"))
    members = members.groupBy("cell", "i", "j").agg(F.collect_list(F.struct("cid", "m", "v", "visits")).alias("members"))
    queries = visit.join(sizes, "cell").withColumn("j", some("nj")).withColumn("i", part("ni"))
    queries = queries.groupBy("cell", "i", "j").agg(F.collect_list(F.struct("cid", "m", "v", F.col("home").alias("cell"))).alias("queries"))
    met = members.join(queries, ["cell", "i", "j"]).select("cell", "members", "queries")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = lambda s: {k.name: s.values.field(k.name).to_pylist() for k in s.values.type}
        for batch in batches:
            rows = [verify(batch.column("cell")[n].as_py(), turn(batch.column("members")[n]), turn(batch.column("queries")[n]), cosine) for n in range(batch.num_rows)]
            cols = list(zip(*(r for found in rows for r in found), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cid", "links", "root"])

    found = staged(met.mapInArrow(check, UNIT), "links")
    degree = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = classes.select("cid", "h", "g", "m", "least").join(degree, "cid", "left").join(labels, F.col("cid") == F.col("node"), "left")
    named = staged(named.select("h", "g", "least", F.coalesce("component", "cid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links")), "named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("h", "g", "links", "component_id")
    joined = keyed.select("vec_id", "h", "g").join(named, ["h", "g"], "left")
    single = F.col("links").isNull()
    component = F.when(single, F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
