"""Operator 1: best-fit packing by swap-based local search.

``token_pieces`` turns documents into pieces of at most ``capacity`` tokens. ``pack``
spreads the pieces over shards of bounded size, fills each shard's bins best-fit
decreasing, then improves them: pieces of the emptiest bin move to bins with room, or are
exchanged one-for-one or two-for-one for shorter pieces of fuller bins. Every step raises
the sum of squared fills, so the emptiest bin drains until it can be dropped.

Only (length, row number) pairs meet in a task; token ids never do. A shard holds about
``shard_pieces`` pieces whatever the corpus, so memory and time of a task are bounded, and
the price is at most about one part-filled bin a shard.

Edge cases: a null or empty text is the end token alone; repeated rows are packed as often
as they occur; a null ``doc_id`` stays null; an empty table gives no rows; further input
columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Per piece its place in the document, its length and the CRC-32 of its ids
    (little-endian unsigned 32-bit), and with ``with_ids`` the ids themselves."""
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, step = encoder(tokenizer), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.ids(text.as_py() or "") + end
                for n, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, n, at // 4, len(part) // 4, zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=False)]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(p, "<u4").astype("int32") for p in cols[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(room, (n, -1))
        if at == len(room):
            left, b = capacity, len(bins)
            bins.append([])
        else:
            left, b = room.pop(at)
        bins[b].append(i)
        if left > n:
            insort(room, (left - n, b))
    return bins


class _Table:
    """Pieces of the bins that may receive, by reach (a piece's length and the room of its
    bin: the largest size that can take its place), and the bins by room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.top = np.full(capacity + 1, capacity + 1)  # shortest piece of each reach
        self._heaps: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        self._stamp: dict[int, int] = {}  # of the bins inside
        self._held: dict[int, tuple[int, list[int]]] = {}
        self._room: list[tuple[int, int]] = []
        self._next = 0

    def put(self, b: int, items: list[int], lengths: list[int], room: int) -> None:
        self._next += 1
        self._stamp[b] = self._next
        at = []
        if room:
            insort(self._room, (room, b))
            for i in items:
                r = lengths[i] + room
                heappush(self._heaps[r], (lengths[i], self._next, b, i))
                self.top[r] = min(self.top[r], lengths[i])
                at.append(r)
        self._held[b] = (room, at)

    def take(self, b: int) -> None:
        del self._stamp[b]
        room, at = self._held.pop(b)
        if room:
            del self._room[bisect_left(self._room, (room, b))]
        for r in set(at):
            self.top[r] = self._first(r)[0]

    def _first(self, r: int) -> tuple[int, int, int, int]:
        heap = self._heaps[r]
        while heap and self._stamp.get(heap[0][2]) != heap[0][1]:
            heappop(heap)
        return heap[0] if heap else (self.capacity + 1, 0, -1, -1)

    def __contains__(self, b: int) -> bool:
        return b in self._stamp

    def fullest_with(self, n: int) -> int | None:
        at = bisect_left(self._room, (n, -1))
        return self._room[at][1] if at < len(self._room) else None

    def shortest(self) -> np.ndarray:
        """By size the shortest piece whose place can take it."""
        return np.minimum.accumulate(self.top[::-1])[::-1]

    def piece(self, size: int, length: int) -> tuple[int, int]:
        """(bin, piece) of that length that a size can replace."""
        r = size + int(np.argmax(self.top[size:] == length))
        return self._first(r)[2:]


def _sizes(items: list[int], lengths: list[int], capacity: int) -> tuple[int, int]:
    """Sizes that a bin could give away, as bits: single pieces, and these and pairs."""
    one = both = 0
    for k, i in enumerate(items):
        one |= 1 << lengths[i]
        for j in items[:k]:
            if lengths[i] + lengths[j] <= capacity:
                both |= 1 << (lengths[i] + lengths[j])
    return one, one | both


def _takes(items: list[int], lengths: list[int], room: int) -> tuple[int, int]:
    """Sizes that a bin could receive, as bits: for nothing, and for a shorter piece."""
    span, swap = (1 << room) - 1, 0
    for i in items:
        swap |= span << (lengths[i] + 1)
    return span << 1, swap


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Drain the emptiest bins by moves and by one-for-one and two-for-one exchanges.

    Each exchange puts more tokens into a bin that is at least as full as the one they
    leave, so the sum of squared fills rises with every step and the search ends: at the
    lower bound, or where no bin can be improved. A bin that can't be improved waits until
    one of the bins that changed since could receive a size it has to give; only the pieces
    of changed bins are looked at again.
    """
    size = lengths.tolist()
    least = -(-int(lengths.sum()) // capacity)
    held = {b: list(items) for b, items in enumerate(bins) if items}
    fill = {b: sum(size[i] for i in items) for b, items in held.items()}
    table = _Table(capacity)
    for b, items in held.items():
        table.put(b, items, size, capacity - fill[b])
    open_ = [(f, b) for b, f in fill.items()]
    heapify(open_)
    low = open_.copy()  # bins of the table by fill, and those too empty for it
    out: list[tuple[int, int]] = []
    waiting: dict[int, tuple[int, int]] = {}

    def align(f: int) -> None:
        """The table's bins are those of a fill of at least ``f``."""
        while low and low[0][0] < f:
            was, b = heappop(low)
            if b in table and fill.get(b) == was:
                table.take(b)
                heappush(out, (-was, b))
        while out and -out[0][0] >= f:
            was, b = heappop(out)
            if b not in table and fill.get(b) == -was:
                table.put(b, held[b], size, capacity - fill[b])
                heappush(low, (-was, b))

    while open_ and len(held) > least:
        was, src = heappop(open_)
        if fill.get(src) != was or src in waiting:
            continue
        align(was)
        if src in table:
            table.take(src)
        changed: set[int] = set()
        while held[src]:
            align(fill[src])
            found = _step(held[src], size, table, capacity)
            if found is None:
                break
            away, to, back = found
            table.take(to)
            for i in away:
                held[src].remove(i)
                held[to].append(i)
            if back is not None:
                held[to].remove(back)
                held[src].append(back)
            moved = sum(size[i] for i in away) - (size[back] if back is not None else 0)
            fill[src] -= moved
            fill[to] += moved
            table.put(to, held[to], size, capacity - fill[to])
            heappush(low, (fill[to], to))
            changed.add(to)
        if not held[src]:
            del held[src], fill[src]
        else:
            waiting[src] = _sizes(held[src], size, capacity)
            table.put(src, held[src], size, capacity - fill[src])
            heappush(low, (fill[src], src))
        for t in changed:  # other pieces to give, other sizes to take
            waiting.pop(t, None)
            heappush(open_, (fill[t], t))
        for t in changed | ({src} & held.keys() if changed else set()):
            free, swap = _takes(held[t], size, capacity - fill[t])
            for b in [b for b, (one, any_) in waiting.items() if b != t and fill[b] <= fill[t] and (one & free or any_ & swap)]:
                del waiting[b]
                heappush(open_, (fill[b], b))
    return list(held.values())


def _step(items: list[int], size: list[int], table: _Table, capacity: int) -> tuple[list[int], int, int | None] | None:
    """(pieces that leave, the bin they go to, the piece that comes back): a move of the longest
    piece that fits, into the fullest bin that takes it; else the exchange that moves most."""
    order = sorted(items, key=lambda i: -size[i])
    for i in order:
        to = table.fullest_with(size[i])
        if to is not None:
            return [i], to, None
    shortest = table.shortest()
    sizes = np.array([size[i] for i in order])
    gain = sizes - shortest[sizes]
    if gain.max() > 0:
        k = int(np.argmax(gain))
        away, n = [order[k]], int(sizes[k])
    else:
        i, j = np.triu_indices(len(order), 1)
        both = sizes[i] + sizes[j]
        gain = np.where(both <= capacity, both - shortest[np.minimum(both, capacity)], 0)
        if not len(gain) or gain.max() <= 0:
            return None
        k = int(np.argmax(gain))
        away, n = [order[i[k]], order[j[k]]], int(both[k])
    to, back = table.piece(n, int(shortest[n]))
    return away, to, back


def pack(pieces: DataFrame, *, capacity: int = 2048, shard_pieces: int = 16384) -> DataFrame:
    """``pieces`` (with ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Full pieces are sequences of their own; columns named ``_row``, ``_shard`` and ``_null`` are reserved. Rows are numbered after staging, so the shard
    of a row does not depend on its key and repeated keys spread like any others.
    """
    rows = staged(pieces, "pieces").withColumn("_row", F.monotonically_increasing_id())
    whole = rows.filter(F.col("length") >= capacity)
    whole = whole.withColumn("sequence_id", -1 - F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    part = rows.filter(F.col("length") < capacity)
    shards = max(1, round(part.count() / shard_pieces))
    part = part.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))

    def fill_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_row"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        seq, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        base = int(pdf["_shard"].iloc[0]) << 32
        for b, items in enumerate(bins):
            seq[items] = base + b
            offset[items] = np.concatenate(([0], np.cumsum(lengths[items])[:-1]))
        return pdf.assign(sequence_id=seq, offset=offset)

    kept = [f for f in pieces.schema.fields]
    names = [f.name for f in kept] + ["sequence_id", "offset"]
    schema = part.schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"
    # doc_id may be null: pandas would turn such a column into floats, so nulls ride in a flag
    flagged = part.withColumn("_null", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    packed = flagged.groupBy("_shard").applyInPandas(fill_shard, schema + ",_null:boolean")
    packed = packed.withColumn("doc_id", F.when(~F.col("_null"), F.col("doc_id")))
    return whole.select(names).unionByName(packed.select(names))


def pack_documents(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (doc_id, text)."""
    return pack(token_pieces(docs, tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its pieces' ids joined by offset (needs ``with_ids``)."""
    by = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    return by.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
