"""Episodes, newness and isolation against brute force."""

import itertools

import numpy as np
import pytest

from mirador.operators import episodes, isolation, novelty
from mirador.plans import catalog

SF = "/root/testdata/sf0.001"


def most(spans, gap):
    """The largest number of spans that can stand together."""
    for n in range(len(spans), 0, -1):
        for some in itertools.combinations(sorted(spans, key=lambda s: s[1]), n):
            if all(b[0] > a[1] + gap for a, b in itertools.pairwise(some)):
                return n
    return 0


@pytest.mark.parametrize("gap", [0, 2])
def test_as_many_episodes_as_can_be(spark, gap):
    rng = np.random.default_rng(4)
    spans = {g: [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 25, 9), rng.integers(0, 8, 9), strict=True)] for g in range(8)}
    df = spark.createDataFrame([(g, s, e) for g, rows in spans.items() for s, e in rows] + [(99, 3, None), (98, 5, 2), (0, *spans[0][0])], "g int, s int, e int")
    got = episodes.non_overlapping(df, ["g"], "s", "e", gap=gap).collect()
    for g, rows in spans.items():
        own = sorted((r.place, r.s, r.e) for r in got if r.g == g)
        assert [p for p, _, _ in own] == list(range(len(own))) and all((s, e) in rows for _, s, e in own)
        assert all(b[1] > a[2] + gap for a, b in itertools.pairwise(own)) and len(own) == most(rows, gap)
    assert not [r for r in got if r.g > 90]


def test_even_starts(spark):
    df = spark.createDataFrame([("a", k) for k in range(10)] + [("a", 3), ("b", 1), ("b", 2), ("a", None)], "split string, s int")
    got = sorted((r.split, r.place, r.s) for r in episodes.even_starts(df, ["split"], "s", 4).collect())
    assert got == [("a", i, i * 9 // 3) for i in range(4)]
    with pytest.raises(ValueError, match="two"):
        episodes.even_starts(df, ["split"], "s", 1)


@pytest.mark.parametrize("block", [3, 1000])
def test_novelty_equals_all_pairs(spark, block):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(160, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    rows = [(i, None if i == 7 else int(i % 3 == 0), None if i == 8 else int(rng.integers(-200, 400)), None if i == 9 else v[i].tolist()) for i in range(160)]  # symbol 0 has two thirds
    df = spark.createDataFrame(rows, "id long, symbol int, at long, v array<double>")
    got = {r.id: (r.novelty, r.seen) for r in novelty.novelty(df, window=90, block=block).collect()}
    assert len(got) == 160
    for i, symbol, at, x in rows:
        if symbol is None or at is None or x is None:
            assert got[i] == (None, 0)
            continue
        near = [np.dot(x, w) for _, s, t, w in rows if s == symbol and t is not None and w is not None and at - 90 <= t < at]
        want = min(1.0, max(0.0, 1 - max(near))) if near else 1.0
        assert abs(got[i][0] - want) < 1e-12 and got[i][1] == len(near)
    assert novelty.novelty(df.filter("false"), window=90).count() == 0


def walked(tree, x):
    """Depth of one row, step by step."""
    node = 0
    while tree.feature[node] >= 0:
        node = tree.below[node] + (1 if x[tree.feature[node]] > tree.cut[node] else 0)
    return tree.depth[node]


def test_isolation_equals_a_walk_of_each_row(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 2)), [[9.0, 9.0], [0.0, -8.0]], np.zeros((40, 2))]).round(3)
    df = spark.createDataFrame([(i, float(a), None if i == 5 else float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double")
    forest = isolation.fit(df, ["a", "b"], ["i"], trees=30, sample=64)
    got = {r.i: r.isolation for r in forest.score(df).collect()}
    x[5, 1] = 0
    c = 2 * (np.log(63) + np.euler_gamma) - 2 * 63 / 64
    assert all(abs(got[i] - 2 ** (-np.mean([walked(t, row) for t in forest.trees]) / c)) < 1e-12 for i, row in enumerate(x))
    assert {300, 301} <= set(sorted(got, key=got.get)[-10:]) and all(0 < s < 1 for s in got.values())
    again = isolation.fit(df.repartition(7), ["a", "b"], ["i"], trees=30, sample=64)
    assert all((t.cut == u.cut).all() for t, u in zip(forest.trees, again.trees, strict=True))  # the same whatever the partitions


def test_isolation_tree_grows_to_rows_or_depth():
    x = np.random.default_rng(1).normal(size=(64, 3))
    tree = isolation.grow(x, np.random.default_rng(2))
    inside = {tuple(r): walked(tree, r) for r in x}
    assert max(inside.values()) <= 6 + float(isolation.usual_depth(64)) and len(set(inside.values())) > 3
    assert isolation.usual_depth(1) == 0 and isolation.usual_depth(2) == 1
    flat = isolation.grow(np.ones((10, 2)), np.random.default_rng(2))
    assert len(flat.feature) == 1 and flat.depth[0] == float(isolation.usual_depth(10))


def test_isolation_of_nothing(spark):
    none = spark.createDataFrame([], "i int, a double")
    forest = isolation.fit(none, ["a"], ["i"])
    assert forest.trees == [] and [r.isolation for r in forest.score(spark.createDataFrame([(1, 2.0)], "i int, a double")).collect()] == [None]


def test_isolation_card_by_its_rows(spark):
    rows = catalog.QUERIES["isolation_scores"](spark, SF).collect()
    card = {r.score: r for r in catalog.QUERIES["isolation_card"](spark, SF).collect()}
    for name in ("isolation", "distance"):
        x, y = np.array([r[name] for r in rows]), np.array([r.fell for r in rows])
        pairs = (x[y == 1][:, None] > x[y == 0]).mean() + 0.5 * (x[y == 1][:, None] == x[y == 0]).mean()
        assert abs(card[name].auc - pairs) < 1e-6 and card[name].n == len(rows)
    assert card["isolation"].auc > 0.6  # rows set apart fall more often in this panel
