"""Operator 9: toxicity by a subsequence string kernel, Nystroem landmarks and a linear SVM.

The kernel compares strings by their common subsequences of three characters, gaps
discounted, so an insult with inserted or dropped characters stays close to it. A text is
cut to sentences, and a sentence to windows: its words between marks for their ends (runs of
single letters are joined, other signs inside a word dropped), and its pairs of short words
with the space between them, so that an insult in two words or with a space in it is seen.
Windows are mapped by their normalized kernel with
the landmarks, whitened (the Nystroem map), and a squared-hinge SVM is trained on labelled
sentences as bags of windows: a sentence's value is its highest window's; every sentence of
a clean document is clean, and of a toxic document the sentences with a telling window are
toxic, their witnesses chosen anew in each round. A document's probability is a logistic
curve of its highest value, of how many distinct windows stand out, of their share, and of
how many surely do.

Landmarks are character runs whose rate among the distinct words of toxic documents is
surely above that in clean ones, so words of a rarer language, or words that clean
documents have too but seldom, count.

A linear function of kernels with fixed landmarks is a weight for each subsequence of
three, so a worker scores a unit it has not met from that table, and remembers it. A long
unit is scored by overlapping windows of ``WINDOW`` characters.

Learning takes at most ``limit`` labelled rows of each label, and from these at most
``witnesses`` windows a toxic document, the windows of ``clean_units`` / 2 words of clean
ones (the commonest and others by a hash) and of the ``hard`` words a round that the machine
takes for most toxic (documented bounds of what is learned from); the counts from which
landmarks are chosen cover all words of those rows. Scoring is a map over
all whole texts.

Edge cases: a null or empty text has the score of a text without any unit; labels other than 0
and 1 and rows without label teach nothing; with one label only, the score is 0.5 for all;
a null doc_id is held out; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, combinations, combinations_with_replacement, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, labelled

DECAY, WINDOW = 0.5, 9
#: Lengths of the character runs that may become landmarks.
RUNS = (4, 5, 6, 7, 8, 9)
#: Units a worker remembers and their longest; characters scored together.
KEPT_UNITS, KEPT_CHARS, TOGETHER = 400_000, 64, 1 << 18
_SIGNS = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)\w(?:[^\w\n]+\w){2,}(?!\S)")
_ENDS = frozenset(".!?")


class _Words(dict):
    """A token to its letters and digits, worked out once."""

    def __missing__(self, token: str) -> str:
        got = self[token] = token if token.isalnum() else _SIGNS.sub("", token)
        return got


_words = _Words()


def parts(text: str | None) -> tuple[set[str], set[str]]:
    """A text's distinct words of three characters or more between marks for their two ends
    (with runs of three or more single letters as words), and its distinct pairs of words
    of a sentence that fit a window with their space."""
    if len(_words) > KEPT_UNITS:
        _words.clear()
    low = (text or "").lower()
    words: set[str] = set()
    pairs: set[str] = set()
    for line in low.split("\n"):
        tokens = line.split()
        own = list(map(_words.__getitem__, tokens))
        words.update(own)
        pairs.update([f"{a} {b}" for a, b, t in zip(own, own[1:], tokens, strict=False) if len(a) + len(b) < WINDOW and a and b and t[-1] not in _ENDS])
    words.update([_SIGNS.sub("", m.group()) for m in _SPELLED.finditer(low)])
    return {f"<{w}>" for w in words if len(w) >= 3}, pairs


def subsequences(s: str) -> dict[str, float]:
    """Weight of each subsequence of three: the sum of DECAY ** (its span) over its places."""
    out: dict[str, float] = {}
    for i, j, k in combinations(range(len(s)), 3):
        key = s[i] + s[j] + s[k]
        out[key] = out.get(key, 0.0) + DECAY ** (k - i + 1)
    return out


def normalized(s: str) -> dict[str, float]:
    phi = subsequences(s)
    norm = sum(v * v for v in phi.values()) ** 0.5
    return {k: v / norm for k, v in phi.items()} if norm else {}


def windows(unit: str) -> list[str]:
    return [unit[i : i + WINDOW] for i in range(max(1, len(unit) - WINDOW + 1))]


def kernel(a: list[dict[str, float]], b: list[dict[str, float]]) -> np.ndarray:
    """Normalized kernel values between two lists of feature maps."""
    return np.array([[sum(v * y.get(key, 0.0) for key, v in x.items()) for y in b] for x in a]).reshape(len(a), len(b))


def cut(units_: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the windows of all units, a row a window, short ones filled with
    zeros; and where each unit's windows begin."""
    joined = "".join(u if len(u) >= WINDOW else u.ljust(WINDOW, "\0") for u in units_)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([max(len(u), WINDOW) for u in units_], np.int64)
    count = sizes - WINDOW + 1
    first = np.cumsum(count) - count
    at = np.arange(int(count.sum())) + np.repeat(np.cumsum(sizes) - sizes - first, count)
    return np.lib.stride_tricks.sliding_window_view(codes, WINDOW)[at] if len(units_) else np.zeros((0, WINDOW), np.uint32), first


def norms(block: np.ndarray) -> np.ndarray:
    """Length of each window's feature vector: the root of its kernel with itself.

    ``ways[a][b]`` holds the weight of equal subsequences of the letters so far that end
    before places a and b, gaps up to there discounted; it grows a letter at a time.
    """
    span, n = block.shape[1], len(block)
    columns = np.ascontiguousarray(block.T)
    equal: list[list] = [[None] * span for _ in range(span)]
    for a, b in combinations_with_replacement(range(span), 2):
        equal[a][b] = equal[b][a] = ((columns[a] == columns[b]) & (columns[a] > 0)).astype(np.float32)
    ways = [[np.ones(n, np.float32)] * span for _ in range(span)]
    for _ in range(2):
        above = [np.zeros(n, np.float32)] * span
        longer = []
        for a in range(span):
            longer.append(above)
            along, row = np.zeros(n, np.float32), [np.zeros(n, np.float32)]
            for b in range(span - 1):
                along = DECAY * (along + DECAY * equal[a][b] * ways[a][b])
                row.append(DECAY * above[b + 1] + along)
            above = row
        ways = longer
    total = sum(equal[a][b] * ways[a][b] for a in range(span) for b in range(span))
    return DECAY * np.sqrt(total)


class Triples:
    """Row numbers of a set of three-letter keys, found for many windows at once: a table
    from two letters to a pair, and one from a pair and a letter to the row (0: no key)."""

    def __init__(self, keys: list[str]):
        self.letters = np.array(sorted({ord(c) for k in keys for c in k}), np.uint32)
        place = {chr(c): n + 1 for n, c in enumerate(self.letters.tolist())}
        size = len(place) + 1
        pairs = {ab: n + 1 for n, ab in enumerate(sorted({k[:2] for k in keys}))}
        self.pair = np.zeros((size, size), np.int32)
        for (a, b), n in pairs.items():
            self.pair[place[a], place[b]] = n
        self.row = np.zeros((len(pairs) + 1, size), np.int32)
        for n, k in enumerate(keys):
            self.row[pairs[k[:2]], place[k[2]]] = n + 1

    def mapped(self, block: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each window the weighted sum of ``values`` (a row for each entry of ``row``)
        over its subsequences, over its length; not a number where it has none."""
        near = np.minimum(np.searchsorted(self.letters, block), max(0, len(self.letters) - 1))
        x = np.where(self.letters[near] == block, near + 1, 0) if len(self.letters) else np.zeros(block.shape, np.int64)
        total = np.zeros((len(block), *values.shape[1:]))
        x = np.ascontiguousarray(x.T)
        for i, j in combinations(range(block.shape[1]), 2):
            pair = self.pair[x[i], x[j]] * self.row.shape[1]
            if not pair.any():
                continue
            for k in range(j + 1, block.shape[1]):
                total += DECAY ** (k - i + 1) * values[pair + x[k]]
        with np.errstate(invalid="ignore", divide="ignore"):
            length = norms(block)
            return total / length.reshape(-1, *[1] * (values.ndim - 1))


def in_blocks(triples: Triples, windows_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values``: a row for each key, and the first zero."""
    step, values = 2048 if values.ndim == 1 else 512, values[triples.row.ravel()]
    parts = [triples.mapped(windows_[n : n + step], values) for n in range(0, len(windows_), step)]
    return np.concatenate(parts) if parts else np.zeros((0, *values.shape[1:]))


def may_hold(unit: str, heads: set[str]) -> bool:
    """Whether a run that begins with one of ``heads`` can be in the unit."""
    n = RUNS[0]
    return not heads.isdisjoint([unit[i : i + n] for i in range(len(unit) - n + 1)])


def runs_of(bag: set[str]) -> set[str]:
    return {u[i : i + n] for u in bag for n in RUNS for i in range(len(u) - n + 1)}


def telling_runs(bags: list[set[str]], y: list[int], toxic: Counter, clean: Counter) -> dict[str, float]:
    """Character runs that at least three toxic documents and 1.5 % of them have, with the
    count times the log ratio of their rates in distinct units, where it is surely large.
    ``toxic`` and ``clean`` count the documents of each unit."""
    enough = max(3, 0.015 * sum(y))
    n1, n0 = max(1, sum(toxic.values())), max(1, sum(clean.values()))

    def ratio(k1: int, k0: int) -> float:
        # less two standard errors, or the many rare runs would bring in chance
        value = np.log(((k1 + 0.5) / n1) / ((k0 + 0.5) / n0))
        return value if value - 2 * (1 / (k1 + 0.5) + 1 / (k0 + 0.5)) ** 0.5 > 1.2 else 0.0

    def cuts(u: str, n: int) -> set[str]:
        return {u[i : i + n] for i in range(len(u) - n + 1)}

    values: dict[str, float] = {}
    frequent: dict[str, int] = {}
    for n in RUNS:
        most: dict[str, int] = {}
        for u, c in toxic.items():
            for r in cuts(u, n):
                if n == RUNS[0] or (r[1:] in frequent and r[:-1] in frequent):
                    most[r] = most.get(r, 0) + c
        frequent = {r: c for r, c in most.items() if c >= enough}
        others = dict.fromkeys(frequent, 0)
        for u, c in clean.items():
            for r in cuts(u, n):
                if r in others:
                    others[r] += c
        values |= {r: v for r, c in frequent.items() if (v := ratio(c, others[r]))}
    counts: Counter = Counter()
    for bag, label in zip(bags, y, strict=True):
        if label:
            counts.update({r for u in bag for r in runs_of({u}) if r in values})
    return {r: c * values[r] for r, c in counts.items() if c >= enough}


def landmarks(telling: dict[str, float], toxic: Counter, clean: Counter, count: int) -> list[str]:
    """The most telling runs, longest first of equals, for up to two thirds of the places;
    the commonest units of clean documents for the rest. A run whose units (weighted by
    documents) are mostly those of earlier runs is the same word again and is passed over."""
    holders: dict[str, list[str]] = {r: [] for r in telling}
    heads = {r[: RUNS[0]] for r in telling}
    for u in toxic:
        if may_hold(u, heads):
            for r in runs_of({u}):
                if r in holders:
                    holders[r].append(u)
    chosen: list[str] = []
    covered: set[str] = set()
    for r in sorted(telling, key=lambda r: (-telling[r], -len(r), r)):
        if len(chosen) >= 2 * count // 3:
            break
        if 2 * sum(toxic[u] for u in holders[r] if u in covered) < sum(toxic[u] for u in holders[r]):
            chosen.append(r)
            covered.update(holders[r])
    for u in sorted((u for u in clean if len(u) <= WINDOW and u not in telling), key=lambda u: (-clean[u], u))[: 2 * count]:
        if len(chosen) < count:
            chosen.append(u)
    return chosen


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Linear squared-hinge SVM by Newton's steps; the last weight is the shift."""
    x1, t = np.column_stack([x, np.ones(len(x))]), np.where(y == 1, 1.0, -1.0)
    w, ridge = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-6
    active = np.zeros(len(x), bool)
    for r in range(rounds):
        was, active = active, t * (x1 @ w) < 1
        if r and (was == active).all():
            break
        xa, ca = x1[active], (cost * weight[active])[:, None]
        w = np.linalg.solve(ridge + (xa * ca).T @ xa, (xa * ca).T @ t[active])
    return w


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (the last is the shift) by Newton's steps, softened a little."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    x1 = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w, ridge = np.zeros(x1.shape[1]), np.diag([0.1] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        w -= np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + ridge, x1.T @ (p - y) + ridge @ w)
    return centre, scale, w


class Model:
    """A weight for each subsequence of three, the shift, and the curve to a probability."""

    def __init__(self, table: dict[str, float], shift: float, marks: Iterable[str] = (), curve: tuple | None = None, prior: float = 0.5):
        keys = sorted(table)
        self.triples, self.values = Triples(keys), np.array([0.0, *(table[k] for k in keys)])
        self.shift, self.curve, self.prior = shift, curve, prior
        #: Four letters in a row of a landmark; a pair of words without any has nothing to tell.
        self.grams = {m[i : i + RUNS[0]] for m in (m.replace(" ", "") for m in marks) for i in range(len(m) - RUNS[0] + 1)}
        self._kept: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_kept": {}}

    def raw_units(self, units_: list[str]) -> np.ndarray:
        """Each unit's highest window's value."""
        if not units_:
            return np.zeros(0)
        block, first = cut(units_)
        best = np.fmax.reduceat(in_blocks(self.triples, block, self.values), first)
        return self.shift + np.where(np.isfinite(best), best, -1.0)

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text its highest value, the sum of its distinct windows' standing out, their
        share among its distinct words, and the sum of those that stand out surely."""
        found = [parts(t) for t in texts]
        bags = [words | pairs for words, pairs in found]
        if len(self._kept) > KEPT_UNITS:
            self._kept = {}
        kept = self._kept
        new = list(set().union(*bags).difference(kept))
        told = [u for u in new if u[0] == "<" or may_hold(u.replace(" ", ""), self.grams)]
        kept.update(dict.fromkeys(new, self.shift - 1.0))
        kept.update(zip(told, self.raw_units(told).tolist(), strict=True))
        out = np.zeros((len(texts), 4))
        for n, (bag, (own, _)) in enumerate(zip(bags, found, strict=True)):
            values = np.fromiter(map(kept.__getitem__, bag), float, len(bag))
            hot = float(np.clip(values + 0.5, 0, 1.5).sum())
            sure = float(np.clip(values - 1, 0, 2).sum())
            out[n] = max(self.shift - 1.0, values.max(initial=-9.0)), np.log1p(hot), np.log((hot + 0.2) / (len(own) + 20)), np.log1p(sure)
        for u in new:
            if len(u) > KEPT_CHARS:
                del kept[u]
        return out

    def raw(self, text: str | None) -> float:
        """A text's highest value."""
        return float(self.features([text])[0, 0])

    def probability(self, features: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(features), self.prior)
        centre, scale, w = self.curve
        return 1 / (1 + np.exp(-np.clip((features - centre) / scale @ w[:-1] + w[-1], -40, 40)))

    def probabilities(self, texts: Iterable[str | None]) -> np.ndarray:
        """Of many texts, about ``TOGETHER`` characters at a time."""
        out, held, size = [np.zeros((0, 4))], [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= TOGETHER:
                out.append(self.features(held))
                held, size = [], 0
        return self.probability(np.concatenate([*out, self.features(held)]))


def train(texts: list[str | None], y: list[int], *, places: int = 96, witnesses: int = 12, clean_units: int = 6000, hard: int = 1500, rounds: int = 3) -> Model:
    if len(set(y)) < 2:
        return Model({}, 0.0)
    prior = sum(y) / len(y)
    # a pair of words counts as a unit where enough toxic documents have it
    often = Counter(u for t, label in zip(texts, y, strict=True) if label for u in parts(t)[1])
    often = {u for u, c in often.items() if c >= max(3, 0.015 * sum(y))}
    bags, one = [], {}  # each distinct unit is held once
    for t in texts:
        words, pairs = parts(t)
        bags.append({one.setdefault(u, u) for u in words} | (pairs & often))
    del one
    clean = Counter(u for bag, label in zip(bags, y, strict=True) if not label for u in bag)
    toxic = Counter(u for bag, label in zip(bags, y, strict=True) if label for u in bag)
    telling = telling_runs(bags, y, toxic, clean)
    marks = landmarks(telling, toxic, clean, places)
    telling_marks = [m for m in marks if m in telling]
    maps = [normalized(u) for u in marks]
    values, vectors = np.linalg.eigh(kernel(maps, maps))
    good = values > 1e-6
    whiten = vectors[:, good] / np.sqrt(values[good])
    keys = sorted({k for phi in maps for k in phi})
    triples, of_marks = Triples(keys), np.zeros((len(keys) + 1, len(maps)))
    for j, phi in enumerate(maps):
        for n, k in enumerate(keys):
            of_marks[n + 1, j] = phi.get(k, 0.0)
    of_marks = of_marks @ whiten

    def mapped(windows_: list[str]) -> np.ndarray:
        return np.nan_to_num(in_blocks(triples, cut(windows_)[0], of_marks))

    # a toxic document's bags: its sentences with a telling window, and these windows' worth
    worth = lambda part: max((telling.get(r, 0.0) for r in runs_of({part})), default=0.0)
    heads = {r[: RUNS[0]] for r in telling}
    odd = []
    for bag, label in zip(bags, y, strict=True):
        if label:
            telling_ones = {p: worth(p) for u in bag if may_hold(u, heads) for p in windows(u)}
            best = max(telling_ones.values(), default=0.0)
            odd.append(sorted((p for p, v in telling_ones.items() if v > 0 and v >= best / 4), key=lambda p: (-telling_ones[p], p))[:witnesses])
    odd = [o for o in odd if o]
    if not odd:
        return Model({}, 0.0, prior=prior)
    common = {u for u, _ in clean.most_common(clean_units // 4)}
    others = heapq.nsmallest(clean_units // 4, (u for u in clean if u not in common), key=lambda u: (hash_of(u), u))
    seen = common.union(others)
    negatives = sorted({p for u in seen for p in windows(u)})
    del bags
    witness = [p for o in odd for p in o]
    for r in range(rounds):
        x = np.concatenate([mapped(witness), mapped(negatives)])
        t = np.concatenate([np.ones(len(witness)), np.zeros(len(negatives))])
        w = svm(x, t, np.where(t == 1, len(t) / (2 * len(witness)), len(t) / (2 * len(negatives))))
        table: dict[str, float] = {}
        for a, phi in zip((whiten @ w[:-1]).tolist(), maps, strict=True):
            for key, v in phi.items():
                table[key] = table.get(key, 0.0) + a * v
        model = Model(table, float(w[-1]), telling_marks, prior=prior)
        if r + 1 < rounds:
            # of each document its highest window stays a witness, and those on the toxic side;
            # the clean windows that the machine finds most toxic join the clean side
            values = np.split(mapped([p for o in odd for p in o]) @ w[:-1] + w[-1], np.cumsum([len(o) for o in odd])[:-1])
            witness = [p for o, v in zip(odd, values, strict=True) for p, z in zip(o, v.tolist(), strict=True) if z > 0 or z == v.max()]
            most: list[tuple[float, str]] = []
            rest = iter(u for u in clean if u not in seen)
            while part := list(islice(rest, 1 << 15)):
                most = heapq.nlargest(hard, chain(most, zip(model.raw_units(part).tolist(), part, strict=True)))
            found = [u for v, u in most if v > -1]
            negatives = negatives + sorted({p for u in found for p in windows(u)})
            seen.update(found)
    del clean, toxic
    features = np.concatenate([model.features(texts[n : n + 64]) for n in range(0, len(texts), 64)])
    model.curve = logistic(features, np.array(y, float))
    model._kept = {}
    return model


def hash_of(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode())


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1, limit: int = 2000) -> Model:
    """Learn from at most ``limit`` rows of each label outside the held-out fold."""
    rows = labelled(docs, labels, "toxic", fold(F.col("doc_id"), folds) != held, limit).select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return train([r.text for r in rows], [r.y for r in rows])


def score(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the landmarks' subsequences

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p = m.probabilities(t.as_py() for t in b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype("int32"), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def reject(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the documents predicted toxic; columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def toxic(parts_: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for text in parts_:
            yield pd.Series(m.probabilities(text))
        m._kept = {}  # the worker goes on to other stages
        _words.clear()

    toxic = F.pandas_udf(toxic, "double")
    return docs.filter(toxic(F.col("text").cast("string")) < threshold)
