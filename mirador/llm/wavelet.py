"""Operator 8: token ids as wavelet-matrix shards.

Documents are range-partitioned and sorted by doc_id and each task writes its ids to
shards of about ``shard_tokens`` tokens. A shard is one file: the distinct ids by falling
frequency, the documents with their lengths, and a wavelet matrix over the ids' ranks,
bit-plane by bit-plane, with the counts that rank and select start from. Its planes are
cut into zstandard frames of their own, so access, count and select expand only the blocks
they touch; a shard decodes whole by undoing the partitions plane by plane.

Edge cases: a null or empty text is the end token alone; a null doc_id sorts first and
stays null; equal doc_ids sort by a hash of the text; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_dir, staged
from .files import put
from .tokens import encoder

MAGIC = b"WVM2"
HEAD = "<4sQIIBII"
#: Bytes of a plane between two stored counts of ones, and in a compressed block.
SUPER, BLOCK = 64, 1 << 16


class Plane:
    """A bit vector in bytes with the count of ones before every ``SUPER`` bytes (6 % of
    its size). The bytes come whole, or block by block from ``load`` when asked for."""

    def __init__(self, n: int, counts: np.ndarray, whole: np.ndarray | None = None, load=None):
        self.n, self.counts, self._whole, self._load = n, counts, whole, load
        self._blocks: dict[int, np.ndarray] = {}
        self.ones = int(counts[-1])
        self.zeros = n - self.ones

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        whole = np.packbits(bits)
        per = np.add.reduceat(np.bitwise_count(whole), np.arange(0, len(whole), SUPER), dtype=np.uint32) if len(whole) else np.zeros(0, np.uint32)
        return cls(len(bits), np.concatenate(([0], np.cumsum(per))).astype("<u4"), whole)

    def bytes(self) -> np.ndarray:
        if self._whole is None:
            self._whole = np.concatenate([self._load(k) for k in range(-(-self.n // (8 * BLOCK)))]) if self.n else np.zeros(0, np.uint8)
            self._blocks = {}
        return self._whole

    def part(self, lo: int, hi: int) -> np.ndarray:
        """Bytes lo to hi, which lie within a block."""
        if self._whole is not None:
            return self._whole[lo:hi]
        k = lo // BLOCK
        if k not in self._blocks:
            self._blocks[k] = self._load(k)
        return self._blocks[k][lo - k * BLOCK : hi - k * BLOCK]

    def bit(self, i: int) -> int:
        return int(self.part(i >> 3, (i >> 3) + 1)[0]) >> (7 - (i & 7)) & 1

    def rank(self, i: int) -> int:
        """Ones before position i."""
        block, rest = divmod(i, 8 * SUPER)
        if not rest:
            return int(self.counts[block])
        own = int.from_bytes(self.part(block * SUPER, (i + 7) >> 3).tobytes(), "big") >> (-i & 7)
        return int(self.counts[block]) + own.bit_count()

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero."""
        if not 0 <= k < (self.ones if bit else self.zeros):
            raise IndexError(k)
        before = (lambda b: int(self.counts[b])) if bit else (lambda b: min(b * 8 * SUPER, self.n) - int(self.counts[b]))
        lo, hi = 0, len(self.counts) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if before(mid) <= k else (lo, mid)
        bits = np.unpackbits(self.part(lo * SUPER, min(lo * SUPER + SUPER, (self.n + 7) >> 3)))
        return lo * 8 * SUPER + int(np.flatnonzero(bits == bit)[k - before(lo)])


class WaveletMatrix:
    """Bit-planes from the highest bit down; in each, zeros keep their order and go first."""

    def __init__(self, n: int, planes: list[Plane]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ranks: np.ndarray, bits: int) -> WaveletMatrix:
        planes, here = [], ranks
        for b in range(bits - 1, -1, -1):
            one = (here & here.dtype.type(1 << b)) != 0
            planes.append(Plane.of(one))
            here = np.concatenate((here.take(np.flatnonzero(~one)), here.take(np.flatnonzero(one))))
        return cls(len(ranks), planes)

    def decode(self, step: int = 1 << 15) -> np.ndarray:
        """All ranks in order: from the last plane up, each partition is undone."""
        here = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, plane in enumerate(reversed(self.planes)):
            ones = np.unpackbits(plane.bytes(), count=self.n).view(bool)
            z, o = 0, plane.zeros
            here[o:] |= here.dtype.type(1 << b)
            before = np.empty_like(here)
            for at in range(0, self.n, step):
                one, out = ones[at : at + step], before[at : at + step]
                high, low = np.flatnonzero(one), np.flatnonzero(~one)
                out[high], out[low] = here[o : o + len(high)], here[z : z + len(low)]
                z, o = z + len(low), o + len(high)
            here = before
        return here

    def access(self, i: int) -> int:
        value = 0
        for plane in self.planes:
            bit, ones = plane.bit(i), plane.rank(i)
            i = plane.zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _span(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for level, plane in enumerate(self.planes):
            a, b = plane.rank(lo), plane.rank(hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = plane.zeros + a, plane.zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._span(value, lo, self.n if hi is None else hi)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence."""
        lo, hi = self._span(value, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            plane, bit = self.planes[level], value >> (len(self.planes) - 1 - level) & 1
            at = plane.select(bit, at - plane.zeros if bit else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


class Shard:
    """The documents (doc_ids, lengths) and ids of one file.

    The file: a fixed head; the ends of all frames; and the frames, each zstandard on its
    own: first the alphabet, documents and counts of ones, then the planes' blocks.
    """

    def __init__(self, alphabet: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, matrix: WaveletMatrix):
        self.alphabet, self.doc_ids, self.lengths, self.matrix = alphabet, doc_ids, lengths, matrix

    @classmethod
    def of(cls, ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> Shard:
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        alphabet = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())].astype(np.uint32)
        rank = np.zeros(len(counts), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        rank[alphabet] = np.arange(len(alphabet), dtype=rank.dtype)
        matrix = WaveletMatrix.build(rank.take(ids), max(1, (max(1, len(alphabet)) - 1).bit_length()))
        return cls(alphabet, doc_ids, np.asarray(lengths, np.int64), matrix)

    def to_bytes(self) -> bytes:
        import zstandard

        m, press = self.matrix, zstandard.ZstdCompressor(level=1).compress
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        known = np.array([d or 0 for d in self.doc_ids], "<i8")
        counts = [p.counts.astype("<u4") for p in m.planes]
        index = [self.alphabet.astype("<u4"), known, null, self.lengths.astype("<i8"), *counts]
        frames = [press(b"".join(x.tobytes() for x in index))]
        for p in m.planes:
            frames += [press(p.bytes()[at : at + BLOCK].tobytes()) for at in range(0, -(-m.n // 8), BLOCK)]
        head = struct.pack(HEAD, MAGIC, m.n, len(self.doc_ids), len(self.alphabet), len(m.planes), len(counts[0]), len(frames))
        return b"".join([head, np.cumsum([len(f) for f in frames]).astype("<u8").tobytes(), *frames])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        import zstandard

        view = memoryview(data)
        magic, n, docs, symbols, bits, supers, count = struct.unpack_from(HEAD, view)
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        at = struct.calcsize(HEAD)
        ends = [0, *np.frombuffer(view, "<u8", count, at).tolist()]
        base = at + 8 * count

        def frame(k: int) -> bytes:
            return zstandard.ZstdDecompressor().decompress(view[base + ends[k] : base + ends[k + 1]])

        raw, at = frame(0), 0

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(raw, kind, count, at)
            at += got.nbytes
            return got

        alphabet, known, null, lengths = take("<u4", symbols), take("<i8", docs), take("u1", docs), take("<i8", docs)
        blocks = -(-n // (8 * BLOCK))
        load = lambda level: lambda k: np.frombuffer(frame(1 + level * blocks + k), np.uint8)
        planes = [Plane(n, take("<u4", supers), load=load(level)) for level in range(bits)]
        return cls(alphabet, [None if z else d for d, z in zip(known.tolist(), null.tolist(), strict=True)], lengths, WaveletMatrix(n, planes))

    def ids(self) -> np.ndarray:
        return self.alphabet.take(self.matrix.decode()) if self.matrix.n else np.zeros(0, np.uint32)

    def rank_of(self, token: int) -> int | None:
        at = np.flatnonzero(self.alphabet == token)
        return int(at[0]) if len(at) else None

    def token(self, i: int) -> int:
        return int(self.alphabet[self.matrix.access(i)])

    def count(self, token: int) -> int:
        r = self.rank_of(token)
        return 0 if r is None else self.matrix.count(r)

    def find(self, token: int) -> list[int]:
        r = self.rank_of(token)
        return [] if r is None else self.matrix.occurrences(r)


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 2, shard_tokens: int = 4 << 20) -> DataFrame:
    """Write the shards in ascending doc_id order; returns their table (part, shard, tokens)."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        sizes: list[int] = []
        held: list[bytes] = []
        names: list[int | None] = []
        total = 0

        def close() -> None:
            nonlocal total
            if names:
                lengths = np.array([len(h) // 4 for h in held], np.int64)
                data = Shard.of(np.frombuffer(b"".join(held), "<u4"), names, lengths).to_bytes()
                put(folder, f"{part:06d}-{len(sizes):06d}.wvm", data)
                sizes.append(int(lengths.sum()))
            held.clear()
            names.clear()
            total = 0

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held.append(enc.ids(text.as_py() or "") + end)
                names.append(doc_id)
                total += len(held[-1]) // 4
                if total >= shard_tokens:
                    close()
        close()
        k = len(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(sizes, pa.int64())], ["part", "shard", "tokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = own.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)
    return staged(ordered.mapInArrow(run, "part int, shard int, tokens long"), "shards")


def read(spark, folder: str) -> DataFrame:
    """(part, shard, doc_id, at, n_tokens, ids_crc32) of every document in the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                part, shard = map(int, path.rsplit("/", 1)[1].removesuffix(".wvm").split("-"))
                s = Shard.from_bytes(content.as_buffer())
                ids = s.ids().astype("<u4")
                ends = np.cumsum(s.lengths)
                starts = ends - s.lengths
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(s.doc_ids)
                arrays = [pa.array([part] * k, pa.int32()), pa.array([shard] * k, pa.int32()), pa.array(s.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(s.lengths, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder)
    return files.select("path", "content").mapInArrow(run, "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")


def bases(shards: DataFrame) -> DataFrame:
    """(part, shard, base): the tokens of all shards before. Summed in two levels, so no
    task orders more than a part's shards or the parts' totals."""
    totals = shards.groupBy("part").agg(F.sum("tokens").alias("t"))
    group = F.expr("part div 1024")
    coarse = totals.groupBy(group.alias("g")).agg(F.sum("t").alias("t"))
    before = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    coarse = coarse.select("g", zero(F.sum("t").over(before().orderBy("g"))).alias("g0"))
    parts = totals.withColumn("g", group).withColumn("p0", zero(F.sum("t").over(before("g").orderBy("part")))).join(coarse, "g")
    own = shards.withColumn("s0", zero(F.sum("tokens").over(before("part").orderBy("shard"))))
    return own.join(parts.select("part", "g0", "p0"), "part").select("part", "shard", F.expr("g0 + p0 + s0").alias("base"))


def encode_documents(docs: DataFrame, tokenizer: str, *, end_id: int = 2, shard_tokens: int = 4 << 20) -> DataFrame:
    """Write the shards, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = fresh_dir(spark, "wavelet")
    shards = write(docs, folder, tokenizer, end_id=end_id, shard_tokens=shard_tokens)
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read(spark, folder).join(bases(shards), ["part", "shard"])
    return rows.select("doc_id", F.expr("base + at").alias("start"), "n_tokens", "ids_crc32")
