"""Operator 2: SimHash near-duplicate detection with BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles.
Fingerprints within ``radius`` bits are linked, and links are closed into components.

Candidates are routed without loss: of ``radius + 2`` bit blocks, two fingerprints within
``radius`` bits agree on at least two, so every pair of blocks gives a mask and a shard is
(mask, fingerprint & mask). A shard with more than ``tree_size`` distinct fingerprints is
split again by the same argument over its free bits, until it is small: no task ever holds
an unbounded group. Each shard then builds a BK-tree (children keyed by their integer
Hamming distance to the parent) and every fingerprint follows only the edges within the
radius. Exact copies share a fingerprint and take part once.

The trees are built in the task to which a shard's fingerprints are shuffled. Broadcasting
them would need all fingerprints on the driver, which grows with the corpus.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other;
a null ``doc_id`` keeps its row and never names a component (whose id is null only if all
its members' are); an empty table gives no rows; further input columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components

ALL_BITS = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle_words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint. UTF-8 bytes lower-case A-Z only and split on
    exactly the six ASCII spaces, as the definition asks."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends = ends[shingle_words - 1 :] if len(words) >= shingle_words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in part], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, shingle_words: int = 3, seed: int = 42, keyed: bool = False) -> DataFrame:
    """(doc_id, fp long): the fingerprint as a signed long, from whole texts. ``keyed``: with
    row_key and row_hash too."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(_row(text) if keyed else ()), text.alias("text"))
    names = own.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py(), shingle_words, seed)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(fps, pa.int64())], [*names, "fp"])

    return own.mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "fp"]))


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self._root: tuple[int, dict] | None = None

    def add(self, value: int) -> None:
        if self._root is None:
            self._root = (value, {})
            return
        node = self._root
        while d := (node[0] ^ value).bit_count():
            if (child := node[1].get(d)) is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        stack = [self._root] if self._root else []
        while stack:
            here, children = stack.pop()
            d = (here ^ value).bit_count()
            if d <= radius:
                yield here
            for edge, child in children.items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def link_shard(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning star of every component within a shard: (member, first member)."""
    tree, root = BKTree(), {v: v for v in values}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for v in sorted(root):
        for near in tree.within(v, radius):
            a, b = find(near), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        tree.add(v)
    return [(v, find(v)) for v in root if find(v) != v]


def block_masks(bits: int, blocks: int, equal: int) -> list[int]:
    """Masks of every choice of ``equal`` out of ``blocks`` parts of the set bits."""
    where = [i for i in range(64) if bits >> i & 1]
    parts = [sum(1 << i for i in where[k::blocks]) for k in range(blocks)]
    return [sum(c) for c in combinations(parts, equal)]


def link(fps: DataFrame, *, radius: int = 3, tree_size: int = 1024) -> DataFrame:
    """Distinct fingerprints (fp) to edges (a, b) that connect exactly the fingerprints
    that chains of links within ``radius`` bits connect."""
    keyed = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in block_masks(ALL_BITS, radius + 2, 2)])).alias("mask"))
    out = None
    for _ in range(64):
        keyed = keyed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        counts = staged(keyed.groupBy("mask", "key").count().filter("count > 1"), "shards")
        small = keyed.join(counts.filter(F.col("count") <= tree_size), ["mask", "key"])
        edges = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(_link_batches(radius), "a long, b long")
        out = edges if out is None else out.unionByName(edges)
        large = counts.filter(F.col("count") > tree_size)
        if large.isEmpty():
            return out
        masks = {r.mask for r in large.select("mask").distinct().collect()}  # a few hundred at most: they come from the block layout
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(_signed(m % (1 << 64) | s)) for s in block_masks(ALL_BITS & ~m, radius + 1, 1)]))])
        keyed = keyed.join(large, ["mask", "key"]).select("fp", F.explode(finer[F.col("mask")]).alias("mask")).distinct()
        keyed = staged(keyed, "hot")
    raise RuntimeError("shards of distinct fingerprints can't stay large with all bits equal")


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = [e for fps in b.column("fps").to_pylist() for e in link_shard([f % (1 << 64) for f in fps], radius)]
            a, c = [_signed(x) for x, _ in edges], [_signed(y) for _, y in edges]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def linked(reps: DataFrame, *, radius: int = 3) -> DataFrame:
    """``reps``, a row for each distinct fingerprint (fp), with the component of each."""
    labels = components(link(reps.select("fp"), radius=radius))
    return staged(reps.join(labels, reps.fp == labels.node, "left").select(*reps.columns, F.coalesce("component", "fp").alias("component")), "named")


def near_duplicates(docs: DataFrame, *, shingle_words: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """Per document: doc_id, fp (signed long), component_id (smallest doc_id reachable)."""
    rows = staged(fingerprints(docs, shingle_words=shingle_words, seed=seed), "fingerprints")
    named = linked(staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct"), radius=radius)
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(ids, "component").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_linked(docs: DataFrame, *, shingle_words: int = 3, seed: int = 42, radius: int = 3) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id (null last;
    of equal ids that of the smallest text hash), once."""
    rows = fingerprints(docs, shingle_words=shingle_words, seed=seed, keyed=True)
    named = linked(staged(rows.groupBy("fp").agg(_first()), "distinct"), radius=radius)
    return _kept(docs, named.select("component", "first.*"))


def hex_fingerprint(fp):
    """Sixteen lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- groups of similar documents, for filtering -------------------------------------------

#: Minimum hashes a document, a byte of each is its sketch; the first BANDS x WIDE of them name its shards.
SKETCH, BANDS, WIDE = 128, 24, 3


def _shingle_hashes(text: str | None, shingle_words: int) -> np.ndarray:
    """The distinct XXH64 values of a text's word shingles, rising; none for a blank text."""
    import xxhash

    words = (text or "").encode().lower().split()
    n = max(1, len(words) - shingle_words + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(b" ".join(words[i : i + shingle_words]), 42) for i in range(n)}), dtype=np.uint64)


def sketches(docs: DataFrame, *, shingle_words: int = 5) -> DataFrame:
    """Per row of ``docs``: row_key and row_hash (of doc_id and text), doc_id, fp (majority
    fingerprint of the distinct shingles), sig (equal for equal shingle sets), bands (a key
    of each WIDE minimum hashes) and sketch. Blank texts have a null fp."""
    import xxhash

    rng = np.random.default_rng(64)
    factors = rng.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text"):
                h = _shingle_hashes(text.as_py(), shingle_words)
                if not len(h):
                    rows.append((None, 0, [], b""))
                    continue
                ones, least = np.zeros(64, np.int64), np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(h), 4096):
                    part = h[at : at + 4096]
                    ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
                    with np.errstate(over="ignore"):
                        mixed = part[None, :] * factors[:, None]
                        mixed ^= mixed >> np.uint64(31)
                    least = np.minimum(least, mixed.min(axis=1))
                fp = int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")
                sig = int(np.bitwise_xor.reduce(h)) ^ len(h)
                bands = [_signed(xxhash.xxh64_intdigest(least[k * WIDE : (k + 1) * WIDE].tobytes(), k)) for k in range(BANDS)]
                rows.append((_signed(fp), _signed(sig), bands, (least >> np.uint64(8)).astype(np.uint8).tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            arrays = [b.column("row_key"), b.column("row_hash"), b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["row_key", "row_hash", "doc_id", "fp", "sig", "bands", "sketch"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(*_row(text), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return own.mapInArrow(run, "row_key long, row_hash long, doc_id long, fp long, sig long, bands array<long>, sketch binary")


def _row(text):
    """Two hashes that name a row by doc_id and text; neither is null."""
    return F.xxhash64(F.col("doc_id").cast("long"), text).alias("row_key"), F.xxhash64(text).alias("row_hash")


def _jaccard(a: bytes, b: bytes) -> float:
    """Of two sets of 64-bit values, neither empty."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(x) + len(y) - len(np.union1d(x, y))
    return both / (len(x) + len(y) - both)


def link_similar(left: list[dict], right: list[dict], similarity: float) -> list[tuple[int, int]]:
    """Edges between two blocks of a shard's members (cid, label, sketch, shingles) that
    join all labels which pairs of at least ``similarity`` join. Sketches only nominate, by
    a cut of six standard deviations below; the shingle sets decide."""
    root = {m["label"]: m["label"] for m in left + right}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    cut = SKETCH * similarity - 6 * (SKETCH * similarity * (1 - similarity)) ** 0.5
    theirs, edges = np.frombuffer(b"".join(m["sketch"] for m in right), np.uint8).reshape(-1, SKETCH), []
    for m in left:
        for k in np.flatnonzero((theirs == np.frombuffer(m["sketch"], np.uint8)).sum(axis=1) >= cut).tolist():
            a, b = find(m["label"]), find(right[k]["label"])
            if a != b and _jaccard(m["shingles"], right[k]["shingles"]) >= similarity:
                root[max(a, b)] = min(a, b)
                edges.append((m["cid"], right[k]["cid"]))
    return edges


def similar_groups(docs: DataFrame, *, shingle_words: int = 5, similarity: float = 0.8, tree_size: int = 512) -> DataFrame:
    """Per row of ``docs``: row_key, row_hash, doc_id, component (equal within a group):
    chains of texts whose shingle sets have at least the given Jaccard similarity.

    Texts of equal shingle sets are one class. Two classes are candidates where they share a
    band, which pairs at ``similarity`` miss with a chance of (1 - similarity ** WIDE) **
    BANDS, 3e-8 at 0.8; each band is a shard. First every member meets its shard's pivot,
    the member with the most company. Members of a shard that this leaves in several groups
    then meet in blocks: those outside the shard's commonest group against all, so no pair
    goes uncompared but for those already in one group, and no task holds a shard.
    """
    rows = staged(sketches(docs, shingle_words=shingle_words), "sketches")
    # blank texts are one class of their own
    one = F.first(F.struct("row_key", "row_hash", "bands", "sketch")).alias("one")
    classes = rows.groupBy("fp", "sig").agg(one).select("fp", "sig", "one.*", F.monotonically_increasing_id().alias("cid"))
    classes = staged(classes, "classes")
    keyed = classes.filter("fp is not null").select("cid", F.explode("bands").alias("key"))
    keyed = staged(keyed.join(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "key"), "keyed")
    company = keyed.groupBy("cid").agg(F.sum("n").alias("company"))
    pivots = keyed.join(company, "cid").groupBy("key").agg(F.max(F.struct("company", "cid")).alias("top"))
    shards = staged(keyed.join(pivots, "key").select("key", "cid", F.col("top.cid").alias("pivot")).filter("cid <> pivot"), "shards")
    pairs = staged(shards.select("cid", "pivot").distinct(), "pairs")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_shingle_hashes(t.as_py(), shingle_words).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("sketch"), pa.array(sets, pa.binary())], ["cid", "sketch", "shingles"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    used = pairs.select("cid").unionByName(pairs.select(F.col("pivot").alias("cid"))).distinct()
    used = classes.join(used, "cid").select("cid", "row_key", "row_hash", "sketch")
    texts = docs.select(*_row(text), text.alias("text")).join(used, ["row_key", "row_hash"]).dropDuplicates(["cid"])
    sets = staged(texts.select("cid", "sketch", "text").mapInArrow(shingle, "cid long, sketch binary, shingles binary"), "shingles")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = [_jaccard(x.as_py(), y.as_py()) >= similarity for x, y in zip(b.column("x"), b.column("y"), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    met = pairs.join(sets.select("cid", F.col("shingles").alias("x")), "cid").join(sets.select(F.col("cid").alias("pivot"), F.col("shingles").alias("y")), "pivot")
    edges = staged(met.select(F.col("cid").alias("a"), F.col("pivot").alias("b"), "x", "y").mapInArrow(decide, "a long, b long"), "similar")
    labels = components(edges)
    marked = shards.join(labels, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("component", "cid").alias("label"))
    parts = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).filter("parts > 1")
    half = max(1, tree_size // 2)
    ceil = lambda n: F.ceil(n / half).cast("int")
    main = main.select("key", F.col("top.label").alias("main"), ceil(F.col("n") - F.col("top.n")).alias("ni"), ceil(F.col("n")).alias("nj"))
    unsettled = staged(marked.join(main, "key"), "unsettled")
    if not unsettled.isEmpty():
        some = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
        part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        full = unsettled.join(sets, "cid").select("key", "label", "main", "ni", "nj", "cid", "sketch", "shingles")
        left = full.filter("label <> main").withColumn("i", some("ni")).withColumn("j", part("nj")).select("key", "i", "j", *MEMBER)
        right = full.withColumn("j", some("nj")).withColumn("i", part("ni"))
        # the two sides come from the same rows, so one has names of its own
        right = right.select(*[F.col(c).alias(f"r_{c}") for c in ("key", "i", "j", *MEMBER)])
        met = left.groupBy("key", "i", "j").cogroup(right.groupBy("r_key", "r_i", "r_j"))
        found = met.applyInArrow(_link_blocks(similarity), "a long, b long")  # a pair of blocks at a time
        labels = components(edges.unionByName(staged(found, "linked")))
    named = classes.join(labels, F.col("cid") == F.col("node"), "left").select("fp", "sig", F.coalesce("component", "cid").alias("component"))
    same = rows.fp.eqNullSafe(named.fp) & (rows.sig == named.sig)
    return rows.join(named, same).select("row_key", "row_hash", "doc_id", "component")


MEMBER = ("cid", "label", "sketch", "shingles")


def _link_blocks(similarity: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        x = left.select(list(MEMBER)).to_pylist()
        y = right.select([f"r_{c}" for c in MEMBER]).rename_columns(list(MEMBER)).to_pylist()
        cols = list(zip(*(link_similar(x, y, similarity) if x and y else []), strict=True)) or [(), ()]
        return pa.table({"a": pa.array(cols[0], pa.int64()), "b": pa.array(cols[1], pa.int64())})

    return run


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of similar ones: that of the smallest
    doc_id (null last; of equal ids that of the smallest text hash), once."""
    return _kept(docs, similar_groups(docs, **options))


def _first():
    """The least of some rows (doc_id, row_hash, row_key)."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash", "row_key")).alias("first")


def _kept(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their component, each once."""
    kept = groups.groupBy("component").agg(_first()).select(F.col("first.row_key").alias("key"), F.col("first.row_hash").alias("hash"))
    key, hash_ = _row(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = docs.select(F.struct("*").alias("own"), key.alias("key"), hash_.alias("hash"))
    return own.join(kept, ["key", "hash"]).dropDuplicates(["key", "hash"]).select("own.*")
