"""Operator 10: quality by random-indexing word vectors and a small calibrated network.

Every word falls in one of ``BUCKETS`` by a hash, so the model has one size whatever the
vocabulary. Each bucket has a sparse random index vector; a bucket's context vector is the
sum of the index vectors of the words within ``REACH`` places of its words, over all
documents: tasks add up their own, and Spark sums them by bucket with partial aggregation.
A document is pooled (mean and deviation of its words' unit context vectors); a two-layer numpy network gives a probability, whose temperature
is set on rows kept from its training.

Learning takes at most ``limit`` labelled rows of each label (documented bound); the word
vectors come from all documents. Scoring is a map over whole texts with a model of fixed size.

Edge cases: a null or empty text has a zero vector and is scored like any; labels other
than 0 and 1 teach nothing; with one label only the score is 0.5 for all; a
null doc_id is held out; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .labelled import fold, labelled

BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 48, 4, 2
KEPT_WORDS = 500_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Bucket(dict):
    def __missing__(self, word: str) -> int:
        got = zlib.crc32(word.encode()) % BUCKETS
        if len(self) < KEPT_WORDS:
            self[word] = got
        return got


_bucket = _Bucket()


def tokens(text: str | None) -> np.ndarray:
    """The buckets of the words and runs of signs of a text, case kept."""
    found = _TOKEN.findall(text or "")
    return np.fromiter(map(_bucket.__getitem__, found), np.int32, len(found))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its index vector's non-zero components."""
    rng = np.random.default_rng(20240)
    return rng.integers(0, DIMS, (BUCKETS, NONZERO)), rng.choice(np.array([-1, 1], np.int64), (BUCKETS, NONZERO))


def add_contexts(total: np.ndarray, ids: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to ``total`` (flat, BUCKETS x DIMS) what the words ``ids`` see around them."""
    for d in range(1, REACH + 1):
        for word, seen in ((ids[d:], ids[:-d]), (ids[:-d], ids[d:])):
            base = word.astype(np.int64) * DIMS
            for k in range(NONZERO):
                np.add.at(total, base + places[seen, k], signs[seen, k])


def contexts(docs: DataFrame) -> DataFrame:
    """(bucket, v array<double>): summed context vectors over all of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(BUCKETS * DIMS, np.int64)
        for b in batches:
            for t in b.column("text"):
                ids = tokens(t.as_py())
                if len(ids) > 1:
                    add_contexts(total, ids, places, signs)
        rows = total.reshape(BUCKETS, DIMS)
        some = np.flatnonzero(np.abs(rows).max(1) > 0)
        flat = pa.array(rows[some].ravel(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.FixedSizeListArray.from_arrays(flat, DIMS).cast(pa.list_(pa.int64()))], ["bucket", "v"])

    part = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket int, v array<long>")
    # whole numbers, so the order of adding does not matter
    sums = part.groupBy("bucket").agg(*[F.sum(F.get("v", F.lit(i)).cast("long")).cast("double").alias(f"v{i}") for i in range(DIMS)])
    return sums.select("bucket", F.array(*[f"v{i}" for i in range(DIMS)]).alias("v"))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIMS unit vectors, centred; bounded by BUCKETS rows."""
    rows = staged(contexts(docs), "contexts").toPandas()
    out = np.zeros((BUCKETS, DIMS))
    if len(rows):
        v = np.array(rows["v"].tolist())
        v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
        v -= v.mean(0)
        out[rows["bucket"].to_numpy()] = v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-9)
    return out.astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """Mean and deviation of a document's word vectors."""
    ids = tokens(text)
    if not len(ids):
        return np.zeros(2 * vectors.shape[1], np.float32)
    which, count = np.unique(ids, return_counts=True)
    v, p = vectors[which], (count / len(ids)).astype(np.float32)[:, None]
    mean = (v * p).sum(0)
    return np.concatenate([mean, np.sqrt(np.maximum((v * v * p).sum(0) - mean * mean, 0))])


class Network:
    """Two layers; inputs standardized; logits divided by a temperature."""

    def __init__(self, mean, scale, w1, b1, w2, b2, temperature=1.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.temperature = mean, scale, w1, b1, w2, b2, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, rounds: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Network:
    """Adam on four fifths of the rows, the temperature by least log loss on the rest."""
    if len(x) < 10 or len(set(y.tolist())) < 2:
        n = max(1, x.shape[1])
        return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    kept, used = order[: len(x) // 5], order[len(x) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-6
    z, t = (x[used] - mean) / scale, y[used].astype(float)
    p = [rng.standard_normal((x.shape[1], hidden)) / x.shape[1] ** 0.5, np.zeros(hidden), rng.standard_normal(hidden) / hidden**0.5, np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, rounds + 1):
        h = np.tanh(z @ p[0] + p[1])
        e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - t) / len(t)
        back = np.outer(e, p[2]) * (1 - h * h)
        grads = [z.T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], e.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    logit, yk = net.logits(x[kept]), y[kept]
    loss = lambda T: float(np.logaddexp(0, np.where(yk == 1, -1, 1) * logit / T).mean())
    net.temperature = min(np.geomspace(0.5, 8, 41), key=loss)
    return net


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, *, folds: int = 5, held: int = 0, limit: int = 4000) -> Network:
    """Learn from at most ``limit`` rows of each label outside the held-out fold; only
    their pooled vectors reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [pooled(t.as_py(), shared.value).astype(float).tolist() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = labelled(docs, labels, "quality", fold(F.col("doc_id"), folds) != held, limit)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "y", F.col("text").cast("string").alias("text"))
    got = sorted(rows.mapInArrow(run, "doc_id long, y int, x array<double>").collect(), key=lambda r: (r.doc_id, r.x))
    return train(np.array([r.x for r in got]).reshape(len(got), 2 * DIMS), np.array([r.y for r in got], int))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, n = shared.value
        for b in batches:
            x = np.array([pooled(t.as_py(), v) for t in b.column("text")]).reshape(b.num_rows, 2 * DIMS)
            p = n.probability(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype("int32"), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
