"""The ring, the collocations and the hard negatives against brute force and edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mirador.llm import collocations, negatives, queries, ring
from tests.llm.test_llm import ODD, SF, documents, empty, frame
from tests.oracle import duck, same

# --- consistent-hash ring -----------------------------------------------------------------


def walk(rows, shards, points, slack):
    """Row by row: each row asks its own place, then in waves the next ones clockwise."""
    ring_ = ring.places(shards, points)
    room = ring.capacities(len(rows), shards, slack)
    waiting, used, out = [[] for _ in ring_], [0] * shards, []
    for row in sorted(rows, key=lambda r: (r[3], r[0] is not None, r[0] or 0, r[2], r[1])):
        waiting[sum(at < row[3] for at, _ in ring_) % len(ring_)].append(row)
    for step in range(len(ring_)):
        for arc, rest in enumerate(waiting):
            s = ring_[(arc + step) % len(ring_)][1]
            while rest and used[s] < room[s]:
                row = rest.pop(0)
                out.append((*row[:3], s, used[s], ring_[arc][1], step))
                used[s] += 1
    return out


def placed(spark, docs, **options):
    hashed = docs.select("doc_id", F.xxhash64(F.lit("ring"), "doc_id").alias("p"), F.coalesce("text", F.lit("")).alias("t")).collect()
    rows = [(r.doc_id, len(r.t.encode()) + 1, zlib.crc32(r.t.encode()), r.p) for r in hashed]
    got = [tuple(r) for r in ring.place(docs, **options).select("doc_id", "size", "text_crc32", "shard", "slot", "home_shard", "walked").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    return sorted(got, key=key), sorted(walk(rows, options["shards"], options["points"], options["slack"]), key=key)


@pytest.mark.parametrize("options", [{"shards": 16, "points": 64, "slack": 0.0}, {"shards": 5, "points": 3, "slack": 0.1}, {"shards": 1, "points": 1, "slack": 0.0}])
def test_ring_places_as_row_by_row(options, spark, monkeypatch):
    monkeypatch.setattr(ring, "CELL_ROWS", 7)
    got, expected = placed(spark, documents(spark), **options)
    assert got == expected


def test_ring_query_is_even_and_gapless(spark):
    rows = queries.op11_hash_ring(spark, SF).collect()
    shards = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(16)}
    assert all(slots == list(range(len(slots))) for slots in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {r.doc_id: (len(r.text.encode()) + 1, zlib.crc32(r.text.encode())) for r in documents(spark).collect()}
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_ring_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(ring, "COPIES", 3)
    options = {"shards": 4, "points": 8, "slack": 0.0}
    hot = spark.createDataFrame([(None, "a")] * 20 + [(7, None)] * 9 + [(i, "b") for i in range(11)], "doc_id long, text string")
    for docs in (frame(spark, ODD), hot):
        got, expected = placed(spark, docs, **options)
        assert got == expected
    assert ring.place(empty(spark), **options).count() == 0
    assert ring.stretches(empty(spark), **options).count() == 0


def test_ring_moves_little_with_slack(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    loose = ring.moved(docs, shards=16, slack=0.25).first()
    assert loose.rows == 20000 and loose.moved / loose.rows < 0.09
    tight = ring.moved(docs, shards=16, slack=0.0).first()
    assert loose.moved < tight.moved < 20000 * 0.13


def test_ring_writes_whole_shards(spark, tmp_path):
    folder = ring.write_shards(documents(spark), shards=4, folder=f"file://{tmp_path}/out")
    back = spark.read.parquet(folder)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in documents(spark).collect())
    assert back.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).filter("ok").count() == 4


# --- collocations -------------------------------------------------------------------------


def counted(docs, max_n):
    """Phrase counts by hand, (lang, words) to count."""
    import re

    out = Counter()
    for lang, text in docs:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            out.update((lang or "und", tuple(words[i : i + n])) for i in range(len(words)) for n in range(1, max_n + 1) if i + n <= len(words))
    return out


@pytest.mark.parametrize(("max_n", "hot"), [(3, 1000), (3, 20), (4, 1000)])
def test_collocation_query_and_counts(max_n, hot, spark, monkeypatch):
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "WORDS", 5000)
    counts, totals = collocations.phrase_counts(documents(spark), max_n=max_n, min_count=4)
    rows = counts.collect()
    got = {(r.lang, tuple(r.phrase.split(" "))): r.f for r in rows}
    by_hand = counted([(r.lang, r.text) for r in documents(spark).collect()], max_n)
    assert len(rows) == len(got)
    assert got == {k: n for k, n in by_hand.items() if n >= 4}
    sums = Counter()
    for (lang, words), n in by_hand.items():
        sums[lang] += n if len(words) == 1 else 0
    assert {r.lang: r.n for r in totals.collect()} == dict(sums)


def test_collocations_equal_sql(spark):
    same(queries.op12_collocations(spark, SF), duck(SF), queries.ORACLES["op12_collocations"])


def test_collocation_scores_by_hand(spark):
    # "new york" 12 times, 8 of them in "new york city"; "york city" 8 times
    texts = ["New\tYORK city. new york city; x"] * 4 + ["a new york\nnew  york"] * 2 + ["city"] * 2
    docs = spark.createDataFrame([(None if i else "und", t, 1) for i, t in enumerate(texts)], "lang string, text string, phrase int")
    rows = [tuple(r) for r in collocations.collocations(docs, min_count=4, inside=70).orderBy("rank").collect()]
    # york city (8 of york's 12 and city's 10) goes: new york city is as frequent; new york stays at 100 * 8 < 70 * 12
    assert rows == [("und", 1, "new york", 12, 12, 12, 40, 1000000), ("und", 2, "new york city", 8, 12, 10, 40, 533333)]


def test_collocation_edge_cases(spark):
    docs = spark.createDataFrame([(None, None, None, "")] * 3 + [("en", "", 1, "q"), ("en", " \t ..", 2, "q"), ("de", "Ä\x00b é " * 30, 3, "q"), ("en", "same " * 40, 4, "z")], "lang string, text string, n int, rank string")
    rows = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n) for r in collocations.collocations(docs).collect()}
    assert rows[("en", "same same same")] == (38, 40, 39, 40)
    assert ("en", "same same") not in rows and ("de", "Ä\x00b é Ä\x00b") in rows
    assert collocations.collocations(docs.filter("false")).count() == 0


def test_stack_over_batches(monkeypatch):
    monkeypatch.setattr(collocations, "READ", 1)
    rows = sorted([(b"a b c ", 2), (b"a b d ", 1), (b"a b ", 4), (b"a ", 1), (b"b c ", 5), (b"a\x01 x ", 3)], reverse=True)
    for size in (1, 2, 6):
        stack, out = collocations.Stack("en", 3, 1, frozenset()), {}
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            for b in stack.read(pa.array([s for s, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())):
                out |= dict(zip(b.column("phrase").to_pylist(), b.column("f").to_pylist(), strict=True))
        for b in stack.end():
            out |= dict(zip(b.column("phrase").to_pylist(), b.column("f").to_pylist(), strict=True))
        assert out == {b"a": 8, b"a b": 7, b"a b c": 2, b"a b d": 1, b"a\x01": 3, b"a\x01 x": 3, b"b": 5, b"b c": 5}


# --- hard negatives -----------------------------------------------------------------------


def mined(rows, every=5, k=5, m=3, low=50, high=95):
    """(anchor, positive, rank, negative, scores) by scoring all pairs."""
    out = []
    for i, (a, label, x) in enumerate(rows):
        if a % every:
            continue
        score = [(sum(int(p) * int(q) for p, q in zip(x, y, strict=False)), b, other == label) for j, (b, other, y) in enumerate(rows) if j != i and b != a]
        for p, positive, _ in sorted((s for s in score if s[2]), key=lambda s: (-s[0], s[1]))[:k]:
            found = sorted(((s, b) for s, b, same_ in score if not same_ and low * p <= 100 * s <= high * p), key=lambda s: (-s[0], s[1]))[:m]
            out += [(a, positive, r, b, p, s) for r, (s, b) in enumerate(found, 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(a, label, [v / 256 for v in x], 0) for a, label, x in rows], "vec_id long, label int, embedding array<double>, rank int")
    return sorted(tuple(r) for r in negatives.hard_negatives(df, anchor=F.col("vec_id") % 5 == 0, **options).collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_negatives_equal_all_pairs(seed, spark):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (6, 8))
    rows = [(int(i), int(rng.integers(0, 3)), (centres[rng.integers(0, 6)] + rng.integers(-30, 30, 8)).tolist()) for i in rng.permutation(400)]
    rows += [(1000 + i, i % 2, centres[0].tolist()) for i in range(150)] + rows[:7]  # a group of equal vectors, repeated rows
    assert found(spark, rows, block=90, chunk=40, pivots=5, sample=64) == mined(rows)


def test_negatives_query_equals_sql(spark):
    same(queries.op13_hard_negatives(spark, SF), duck(SF), queries.ORACLES["op13_hard_negatives"])


def test_negatives_edge_cases(spark):
    big = 2**29
    rows = [(0, 1, [big, 1]), (1, 1, [big, 0]), (2, 2, [big * 3 // 4, 5]), (3, 2, []), (4, 1, [0, 0]), (5, 3, [-big])]
    assert found(spark, rows) == mined(rows) and found(spark, rows)  # past the exact range of doubles
    odd = spark.createDataFrame([(None, 1, [1.0]), (5, None, [1.0]), (10, 1, None), (15, 1, [float("nan")]), (20, 1, [None, 1.0]), (25, 1, [float("inf")])], "vec_id long, label int, embedding array<double>")
    assert negatives.hard_negatives(odd, anchor=F.col("vec_id") % 5 == 0).count() == 0
    only = spark.createDataFrame([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])], "vec_id long, label int, embedding array<double>")
    assert [tuple(r) for r in negatives.hard_negatives(only, anchor=F.col("vec_id") % 5 == 0).collect()] == [(0, 1, 1, 2, 65536, 58880)]
    with pytest.raises(Exception, match="fit a long"):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e300])], "vec_id long, label int, embedding array<double>"), anchor=F.col("vec_id") % 5 == 0).count()


def test_brackets_hold_every_score():
    rng = np.random.default_rng(9)
    x, q = rng.integers(-256, 256, (300, 12)).astype(float), rng.integers(-300, 300, (20, 12)).astype(float)
    pivots = negatives.Pivots(x[:40], float((x * x).sum(1).max()), 6)
    far = pivots.of_rows(x)
    low, high = negatives.bracket((q * q).sum(1) + pivots.most, pivots.of_anchors(q), far, far)
    score, slack = q @ x.T, pivots.slack(q)[:, None]
    assert (low - slack <= score).all() and (score <= high + slack).all()
    assert (high < score.max(1)[:, None]).any()  # and they part some
