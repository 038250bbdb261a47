"""Operator 13: hard negatives by inner product, through a pivot table.

Every vector of whole numbers x is augmented by sqrt(M - |x|^2), M the largest squared
length, and an anchor q by zero. Then |q' - x'|^2 = |q|^2 + M - 2 q.x, so a larger inner
product is a smaller distance, and the triangle inequality over the stored distances to a
few pivots brackets each score. The pivots are chosen, each the farthest from those before
it, in a bounded sample; the distances of every row are stored beside it.

A unit of work is a block of rows and a chunk of anchors. Rows are sorted by their nearest
pivot into tiles; a tile whose distances to some pivot rule it out for an anchor isn't
looked at, of the others only rows whose bracket reaches what the anchor still needs, and
those are scored exactly. A unit returns the best rows of each anchor, so what meets again
grows with the anchors and not with the pairs. The stated anchors meet all rows in blocks,
in two rounds: positives first, then the negatives in the positives' bands.

Rows: a null vec_id, label or vector and null or non-finite components take no part;
shorter vectors count as if padded with zeros; rows that repeat a vec_id are rows of their
own, but never positives or negatives of one another; ties go to the smaller vec_id. An
anchor without positives, and a positive without a negative, give no row. Scores that
might not fit a long raise an error. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Whole numbers below this are exact in double precision; sums of products up to a long.
EXACT, LARGEST = float(2**53), float(2**62)
#: Rows of a tile.
TILE = 256
NO = np.iinfo(np.int64).min


def prepare(vectors: DataFrame, *, scale: float) -> DataFrame:
    """(vec_id, label, q) of the rows that take part, q the components floor(scale * x)."""
    v = F.col("embedding")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    own = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    scaled = F.transform(v, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")))
    huge = F.exists(v, lambda e: F.abs(F.lit(float(scale)) * e.cast("double")) >= 2.0**31)
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.when(huge, F.raise_error(F.lit("scores do not fit a long"))).otherwise(scaled.cast("array<int>")).alias("q"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles, shorter ones padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    out, sizes, flat = np.zeros((len(lists), width)), lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class Pivots:
    """Pivots as augmented points, and distances to them."""

    def __init__(self, sample: np.ndarray, most: float, count: int):
        self.most = most
        rest = np.sqrt(np.maximum(most - (sample * sample).sum(1), 0))
        points = np.column_stack([sample, rest])
        chosen = [int((points * points).sum(1).argmin())] if len(points) else []
        far = np.full(len(points), np.inf)
        while len(chosen) < min(count, len(points)):
            far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.points = points[chosen]

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._distances(np.column_stack([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))]))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return self._distances(np.column_stack([q, np.zeros(len(q))]))

    def _distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.points.T + (self.points * self.points).sum(1)[None, :], 0))

    def slack(self, q: np.ndarray) -> np.ndarray:
        """More than rounding can move a bracket, in units of the score. A distance near zero
        loses the most, the root of its square's rounding."""
        reach = (q * q).sum(1) + self.most
        return 1 + 1e-5 * reach


class Rows:
    """A block of rows, sorted by nearest pivot and the distance to it, in tiles."""

    def __init__(self, table: pa.Table, width: int):
        far = matrix(table["far"], len(table["far"][0])) if table.num_rows else np.zeros((0, 1))
        near = far.argmin(1)
        order = np.lexsort((far[np.arange(len(far)), near], near))
        self.far = far[order]
        self.id, self.label = (table[c].to_numpy()[order] for c in ("vec_id", "label"))
        self.x = matrix(table["q"], width)[order]
        self.tiles = [slice(a, min(a + TILE, len(order))) for a in range(0, len(order), TILE)]
        self.low = np.array([self.far[t].min(0) for t in self.tiles])
        self.high = np.array([self.far[t].max(0) for t in self.tiles])


def bracket(reach: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score, an anchor a row, of points whose distances to the pivots
    lie in [low, high], a point or tile a column."""
    nearest, farthest = np.zeros((len(far), len(low))), np.full((len(far), len(low)), np.inf)
    for p in range(far.shape[1]):
        f = far[:, p, None]
        nearest = np.maximum(nearest, np.maximum(f - high[None, :, p], low[None, :, p] - f))
        farthest = np.minimum(farthest, f + high[None, :, p])
    return (reach[:, None] - farthest**2) / 2, (reach[:, None] - nearest**2) / 2


def scores(q: np.ndarray, x: np.ndarray, hit: np.ndarray, exact: bool) -> np.ndarray:
    """Scores of the pairs marked in ``hit``, and NO elsewhere. In whole numbers where sums
    could pass the exact range of doubles."""
    out = np.full(hit.shape, NO, np.int64)
    if not exact:
        i, j = np.nonzero(hit)
        out[i, j] = np.einsum("ij,ij->i", q[i].astype(np.int64), x[j].astype(np.int64))
    elif hit.mean() > 0.05:
        out[hit] = (q @ x.T)[hit].astype(np.int64)
    else:
        i, j = np.nonzero(hit)
        out[i, j] = np.einsum("ij,ij->i", q[i], x[j]).astype(np.int64)
    return out


class Best:
    """The ``k`` best (score, smaller id first) of each of some lists."""

    def __init__(self, lists: int, k: int):
        self.score, self.id = np.full((lists, k), NO, np.int64), np.full((lists, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows ``at`` get the scores of their row; NO is none."""
        k = self.score.shape[1]
        if score.shape[1] > 4 * k:  # no more than k of a row can stay, but ties at the k-th all may
            edge = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            keep = (score >= np.maximum(edge, self.least[at])[:, None]) & (score > NO)
        else:
            keep = score > NO
        r, c = np.nonzero(keep)
        had_r, had_c = np.nonzero(self.score[at] > NO)
        row = np.concatenate([had_r, r])
        value = np.concatenate([self.score[at][had_r, had_c], score[r, c]])
        name = np.concatenate([self.id[at][had_r, had_c], ids[c]])
        order = np.lexsort((name, -value, row))
        row, value, name = row[order], value[order], name[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < k
        self.score[at[row[top]], place[top]], self.id[at[row[top]], place[top]] = value[top], name[top]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.score > NO)
        return at, self.id[at, place], self.score[at, place]


def search(rows: Rows, anchors: dict[str, np.ndarray], pivots: Pivots, best: Best, group: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, exact: bool) -> None:
    """Adds to ``best`` the rows of the label asked for whose score lies in [low, high].
    List n belongs to anchor ``group[n]``; the lists of an anchor share its scores."""
    if not rows.tiles or not len(group):
        return
    q, far, reach = anchors["q"], anchors["far"], (anchors["q"] ** 2).sum(1) + pivots.most
    slack = pivots.slack(q)
    least, most = bracket(reach, far, rows.low, rows.high)
    for n in np.argsort(-most.max(0), kind="stable"):
        need = np.full(len(q), np.inf)
        np.minimum.at(need, group, np.maximum(low, best.least))
        limit = np.full(len(q), -np.inf)
        np.maximum.at(limit, group, high)
        open_ = np.flatnonzero((most[:, n] + slack >= need) & (least[:, n] - slack <= limit))
        t = rows.tiles[n]
        for at in (open_[i : i + 512] for i in range(0, len(open_), 512)):
            under, over = bracket(reach[at], far[at], rows.far[t], rows.far[t])
            hit = (over + slack[at, None] >= need[at, None]) & (under - slack[at, None] <= limit[at, None])
            hit &= ((anchors["label"][at, None] == rows.label[None, t]) == same) & (anchors["id"][at, None] != rows.id[None, t])
            if not hit.any():
                continue
            got = scores(q[at], rows.x[t], hit, exact)
            place = np.full(len(q), -1)
            place[at] = np.arange(len(at))
            lists = np.flatnonzero(place[group] >= 0)
            own = got[place[group[lists]]]
            own = np.where((own >= low[lists, None]) & (own <= high[lists, None]), own, NO)
            some = (own > NO).any(1)
            best.add(lists[some], own[some], rows.id[t])


def _units(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int):
    """Every block of rows against every chunk of anchors, once."""
    dealt = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk"))


def hard_negatives(vectors: DataFrame, *, anchor: Column, scale: float = 256, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95), pivots: int = 16, sample: int = 2048, block: int = 2048, chunk: int = 32768) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` (over vec_id and label) marks the anchors. An anchor's positives are the
    ``positives`` best other rows of its label; for each, the ``negatives`` best rows of
    other labels with band[0] * p <= 100 * score <= band[1] * p. ``sample`` bounds the rows
    among which pivots are chosen, which results do not depend on.
    """
    spark = vectors.sparkSession
    rows = staged(prepare(vectors, scale=scale).withColumn("nn", F.aggregate("q", F.lit(0.0), lambda s, e: s + e.cast("double") * e)), "rows")
    width, most, n = rows.agg(F.max(F.size("q")), F.max("nn"), F.count(F.lit(1))).first()
    columns = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], columns)
    if most >= LARGEST:
        raise ValueError("scores do not fit a long")
    width, exact = max(width, 1), most < EXACT
    drawn = rows.select("q", F.xxhash64("vec_id", "q").alias("h")).orderBy("h").limit(sample).select("q").toArrow()  # bounded
    table = Pivots(matrix(drawn["q"], width), most, pivots)
    blocks = max(1, -(-n // block))

    def store(batches):
        for b in batches:
            far = table.of_rows(matrix(b.column("q"), width))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("vec_id", "label", "q")] + [pa.array(list(far), pa.list_(pa.float64()))], ["vec_id", "label", "q", "far"])

    marked = staged(rows.select("vec_id", "label", "q").mapInArrow(store, "vec_id long, label long, q array<int>, far array<double>").withColumn("row", F.monotonically_increasing_id()), "pivots")
    dealt = marked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).drop("row")
    asked = marked.filter(anchor).select("row", F.col("vec_id").alias("anchor_id"), "label", "q")
    chunks = max(1, -(-asked.count() // chunk))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))

    def told(table_: pa.Table) -> dict[str, np.ndarray]:
        q = matrix(table_["q"], width)
        return {"q": q, "far": table.of_anchors(q), "label": table_["label"].to_numpy(), "id": table_["anchor_id"].to_numpy()}

    def positive(left: pa.Table, right: pa.Table) -> pa.Table:
        own, best = told(right), Best(right.num_rows, positives)
        anyway = np.full(right.num_rows, NO, np.int64)
        search(Rows(left, width), own, table, best, np.arange(right.num_rows), anyway + 1, -(anyway + 1), True, exact)
        at, ids, score = best.found()
        return pa.table({"row": right["row"].to_numpy()[at], "positive_id": ids, "positive_score": score})

    def negative(left: pa.Table, right: pa.Table) -> pa.Table:
        own = told(right)
        p = matrix(right["scores"], positives).astype(np.int64) if exact else np.array([r + [0] * (positives - len(r)) for r in right["scores"].to_pylist()], np.int64).reshape(-1, positives)
        size = right["scores"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        group, nth = np.nonzero(np.arange(positives)[None, :] < size[:, None])
        exactly = p[group, nth].astype(object)
        low = np.array([-(-band[0] * int(v) // 100) for v in exactly], np.int64)
        high = np.array([band[1] * int(v) // 100 for v in exactly], np.int64)
        best = Best(len(group), negatives)
        search(Rows(left, width), own, table, best, group, low, high, False, exact)
        at, ids, score = best.found()
        return pa.table({"row": right["row"].to_numpy()[group[at]], "nth": nth[at].astype(np.int32), "negative_id": ids, "negative_score": score})

    order = lambda *by: W.partitionBy(*by)
    first = staged(_units(dealt, asked, blocks, chunks).applyInArrow(positive, "row long, positive_id long, positive_score long"), "positives")
    by_anchor = order("row").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("nth", F.row_number().over(by_anchor) - 1).filter(F.col("nth") < positives)
    lists = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("p"))
    known = staged(asked.join(lists, "row").withColumn("scores", F.col("p.positive_score")), "anchors")
    ask = known.select("row", "anchor_id", "label", "q", "chunk", "scores")
    found = staged(_units(dealt, ask, blocks, chunks).applyInArrow(negative, "row long, nth int, negative_id long, negative_score long"), "negatives")
    ranked = found.withColumn("rank", F.row_number().over(order("row", "nth").orderBy(F.desc("negative_score"), "negative_id"))).filter(F.col("rank") <= negatives)
    pairs = known.select("row", "anchor_id", F.posexplode("p.positive_id").alias("nth", "positive_id"), "p").select("row", "anchor_id", "nth", "positive_id", F.get("p.positive_score", F.col("nth")).alias("positive_score"))
    return pairs.join(ranked, ["row", "nth"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
