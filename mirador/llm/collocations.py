"""Operator 12: phrase collocations, counted by suffix-sigma.

Every word of a piece starts a suffix of at most ``max_n`` words. A task sums the equal
suffixes it meets; the sums are shuffled by language and first word and sorted in reverse
lexicographic order, so the suffixes of a prefix come together, and one stack of open
prefixes, as deep as a suffix is long, counts all of them in one pass. The scores come from
joins of a phrase with its parts afterwards.

A first pass counts words. Of words that make up a thousandth of all or more there are at
most a thousand: suffixes that start with such a word are also dealt by the second word,
and by the third where that is such a word too. What such a prefix has in each place is
summed afterwards; all other prefixes are whole in one place, and those under ``min_count``
end there. So no word or pair of words fills a task. Rows are sorted by suffix alone, and
each language that a task meets has a stack of its own.

Texts: A-Z are lower-cased, ``[.,;:!?\\x0A-\\x0D]`` part pieces, spaces and tabs words. Null
or empty texts have no words, a null language is ``und``, repeated rows count, ties go by
the phrase's bytes, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, staged

#: To lower case, tabs to spaces, what parts pieces to line feeds.
_PLAIN = bytes.maketrans(UPPER.encode() + b"\t.,;:!?\x0b\x0c\r", LOWER.encode() + b" " + b"\n" * 9)
#: Words that a task sums at a time; distinct words a time, so three fit a whole number.
WORDS, VOCABULARY = 4_000_000, 500_000
#: Rows, and bytes of text, that are parted into words at a time.
ROWS, BYTES = 1024, 1 << 21
#: Words as frequent as one in HOT are dealt finer, to SALTS places for each further word.
HOT, SALTS = 1000, 64
#: Suffixes of a language that a stack reads at a time; copies of a part that phrases meet.
READ, PARTS = 65_536, 4


class Vocabulary(dict):
    """Word to number; 0 is the end of a piece, -1 nothing."""

    def __init__(self):
        super().__init__({b"": -1, b"\n": 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self.words)
        self.words.append(word)
        return got

    def numbers(self, text: bytes) -> np.ndarray:
        tokens = text.translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
        return ids[ids >= 0]


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(language, text) of whole texts, those of some rows and one language joined by piece ends."""
    for b in (whole.slice(a, ROWS) for whole in batches for a in range(0, whole.num_rows, ROWS)):
        lang, text = b.column("lang").dictionary_encode(), b.column("text")
        numbers = lang.indices.to_numpy()
        for k, name in enumerate(lang.dictionary.to_pylist()):
            yield name, b"\n".join(text.filter(pa.array(numbers == k)).to_pylist())


def _cut(text: bytes, most: int) -> Iterator[bytes]:
    """A very long run of texts, cut at piece ends so that no part has too many words (where
    it has piece ends)."""
    while len(text) > most:
        at = max(text.rfind(c, 0, most) for c in (b"\n", b".", b",", b";", b":", b"!", b"?"))
        if at <= 0:
            break
        yield text[:at]
        text = text[at:]
    yield text


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, f), summed a task."""
    own: dict[str, dict[int, int] | np.ndarray] = {}
    vocabulary = Vocabulary()

    def out():
        words = pa.array(vocabulary.words, pa.binary())
        for lang, n in own.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), words.take(pa.array(at)), pa.array(n[at], pa.int64())], ["lang", "word", "f"])

    for lang, text in texts(batches):
        for part in _cut(text, BYTES):
            n = np.bincount(vocabulary.numbers(part), minlength=len(vocabulary.words))
            n[0] = 0
            had = own.get(lang, np.zeros(0, np.int64))
            n[: len(had)] += had
            own[lang] = n
            if len(vocabulary.words) > VOCABULARY or sum(map(len, own.values())) > 4 * VOCABULARY:
                yield from out()
                own, vocabulary = {}, Vocabulary()
    yield from out()


def combine(ids: np.ndarray, words: int, max_n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct suffixes, a column a place (0: none), and how often each comes."""
    at = np.flatnonzero(ids)
    line = np.concatenate([ids, np.zeros(max_n, ids.dtype)])
    columns = [line[at]]
    for k in range(1, max_n):
        columns.append(np.where(columns[-1] > 0, line[at + k], 0))
    if words**max_n < 1 << 63:
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key *= words
            key += c
        del columns, line, at
        key.sort()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
        n = np.diff(start, append=len(key))
        key, out = key[start], []
        for _ in range(max_n):
            out.append((key % words).astype(np.int32))
            key //= words
        return out[::-1], n
    rows, n = np.unique(np.column_stack(columns), axis=0, return_counts=True)
    return list(rows.T), n


def suffixes(max_n: int, hot: frozenset[bytes]):
    """A task's map: (lang, salt, suffix, n), the words of a suffix each ended by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        vocabulary, n = Vocabulary(), 0

        def out():
            ended = pa.array([b""] + [w + b" " for w in vocabulary.words[1:]], pa.binary())
            often = np.array([w in hot for w in vocabulary.words])
            sums = np.array([zlib.crc32(w) for w in vocabulary.words], np.int64)
            for lang in list(held):
                columns, times = combine(np.concatenate(held.pop(lang)), len(vocabulary.words), max_n)
                salt, fine = np.zeros(len(times), np.int64), np.ones(len(times), bool)
                for k in range(1, max_n):
                    fine &= often[columns[k - 1]]
                    salt = np.where(fine, (salt * 31 + sums[columns[k]]) % SALTS, salt)
                for a in range(0, len(times), 100_000):
                    some = slice(a, a + 100_000)
                    joined = pc.binary_join_element_wise(*[ended.take(pa.array(c[some])) for c in columns], pa.scalar(b"", pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(joined), pa.string()), pa.array(salt[some], pa.int32()), joined, pa.array(times[some], pa.int64())], ["lang", "salt", "suffix", "n"])

        for lang, text in texts(batches):
            for part in _cut(text, BYTES):
                ids = vocabulary.numbers(part)
                held.setdefault(lang, []).append(np.concatenate([ids, np.zeros(1, np.int32)]))
                n += len(ids)
                if n > WORDS or len(vocabulary.words) > VOCABULARY:
                    yield from out()
                    held, vocabulary, n = {}, Vocabulary(), 0
        yield from out()

    return run


class Stack:
    """The open prefixes of the last suffix read of a language, each with its count so far."""

    def __init__(self, lang: str, max_n: int, min_count: int, hot: frozenset[bytes]):
        self.lang, self.max_n, self.min_count = lang, max_n, min_count
        self.hot = pa.array(sorted(hot), pa.binary())
        self.words: list[bytes] = []
        self.counts: list[int] = []
        self._waiting: list[tuple[pa.Array, pa.Array]] = []

    def read(self, suffix: pa.Array, n: pa.Array) -> Iterator[pa.RecordBatch]:
        """Takes suffixes in order; gives prefixes that ended, once there are READ to go through."""
        self._waiting.append((suffix, n))
        if sum(len(s) for s, _ in self._waiting) >= READ:
            yield from self._through()

    def _through(self) -> Iterator[pa.RecordBatch]:
        if not self._waiting:
            return
        suffix, n = (pa.concat_arrays(list(c)) for c in zip(*self._waiting, strict=True))
        self._waiting = []
        parts = pc.split_pattern(suffix, b" ")
        flat, first = parts.flatten(), parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
        size = parts.value_lengths().to_numpy() - 1
        none = pa.scalar(b"", pa.binary())
        words = [pc.if_else(pa.array(size > k), flat.take(pa.array(np.where(size > k, first + k, 0))), none) for k in range(self.max_n)]
        counts = [n.to_numpy()] * self.max_n
        if self.words:
            words = [pa.concat_arrays([pa.array([w], pa.binary()), c]) for w, c in zip(self.words, words, strict=True)]
            counts = [np.concatenate([[had], c]) for had, c in zip(self.counts, counts, strict=True)]
        self.counts = []
        changed = np.zeros(len(words[0]), bool)
        for k in range(self.max_n):
            changed = changed | self._changes(words[k])
            start = np.flatnonzero(changed)
            total = np.add.reduceat(counts[k], start)
            self.counts.append(int(total[-1]))
            yield from self._closed(words[: k + 1], start[:-1], total[:-1])
        self.words = [w[-1].as_py() for w in words]

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._through()
        for k in range(len(self.words)):
            yield from self._closed([pa.array([w], pa.binary()) for w in self.words[: k + 1]], np.array([0]), np.array([self.counts[k]]))

    def _changes(self, column: pa.Array) -> np.ndarray:
        out = np.ones(len(column), bool)
        out[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return out

    def _closed(self, words: list[pa.Array], start: np.ndarray, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Prefixes often enough, and those of hot words, of which other places have a part.
        A prefix of the longest length is whole in any case."""
        at = pa.array(start)
        words = [w.take(at) for w in words]
        keep = total >= self.min_count
        if len(words) < self.max_n and len(self.hot):
            part = np.ones(len(start), bool)
            for w in words:
                part &= pc.is_in(w, self.hot).to_numpy(zero_copy_only=False)
            keep |= part
        keep &= pc.not_equal(words[-1], pa.scalar(b"", pa.binary())).to_numpy(zero_copy_only=False)
        if keep.any():
            mask = pa.array(keep)
            phrase = pc.binary_join_element_wise(*[w.filter(mask) for w in words], pa.scalar(b" ", pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(phrase), pa.string()), phrase, pa.array([len(words)] * len(phrase), pa.int32()), pa.array(total[keep], pa.int64())], ["lang", "phrase", "size", "f"])


def phrase_counts(docs: DataFrame, *, max_n: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of up to ``max_n`` words found ``min_count``
    times, and (lang, n) of the words of each language."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    words = staged(rows.mapInArrow(counted_words, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    everything = words.agg(F.sum("f")).first()[0] or 0
    hot = frozenset(bytes(r.word) for r in words.filter(F.col("f") * HOT >= everything).select("word").collect())  # at most HOT
    met = rows.mapInArrow(suffixes(max_n, hot), "lang string, salt int, suffix binary, n long")
    first = F.substring_index(F.col("suffix").cast("string"), " ", 1)
    ordered = met.repartition("lang", first, "salt").sortWithinPartitions(F.desc("suffix"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stacks: dict[str, Stack] = {}
        for b in batches:
            lang = b.column("lang").dictionary_encode()
            numbers = lang.indices.to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                own = pa.array(numbers == k)
                stack = stacks.get(name) or stacks.setdefault(name, Stack(name, max_n, min_count, hot))
                yield from stack.read(b.column("suffix").filter(own), b.column("n").filter(own))
        for stack in stacks.values():
            yield from stack.end()

    parts = ordered.select("lang", "suffix", "n").mapInArrow(count, "lang string, phrase binary, size int, f long")
    whole = parts.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "size").agg(F.sum("f").alias("f"))
    return staged(whole.filter(F.col("f") >= min_count), "phrases"), totals


def _salted(name: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(salts)).cast("int")


def collocations(docs: DataFrame, *, max_n: int = 3, min_count: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    a, l and r count the phrase and the two parts of its weakest cut; the score is
    floor(1000000 a a / (l r)). A phrase goes if a longer one that holds it is found at
    least ``inside`` in a hundred times as often. Parts that many phrases share meet them
    salted, each part once a salt.
    """
    counts, totals = phrase_counts(docs, max_n=max_n, min_count=min_count)
    found = counts.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    join = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", join(F.lit(1), F.col("k")).alias("left"), join(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"), _salted("phrase", PARTS).alias("salt"))
    part = lambda key, f: counts.select("lang", F.col("phrase").alias(key), F.col("f").alias(f), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("salt"))
    cuts = cuts.join(part("left", "l"), ["lang", "left", "salt"]).join(part("right", "r"), ["lang", "right", "salt"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"aa": wide("a") * wide("a"), "lr": wide("l") * wide("r")}).withColumn("score", F.expr("(1000000 * aa) div lr"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    longer = found.filter("size > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    inner = longer.select("lang", join(F.col("at"), F.col("n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = best.join(inner, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    left = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", _salted("phrase", 16).alias("salt"))
    some = left.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
