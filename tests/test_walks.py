"""Chains, boosting, walk-forward fits, running quantiles and calibrators against plain numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirador.operators import calibration, histboost, hmm, models, quantiles, walkforward
from mirador.plans import catalog, regime

SF = "/root/testdata/sf0.001"


# --- hidden Markov chains ------------------------------------------------------------------


def plain_em(x, share, steps, floor, least):
    """Expectation-maximisation in plain probabilities of a short series."""
    t, k = share.shape
    density = lambda m, v: np.exp(-0.5 * (((x[:, None, :] - m) ** 2) / v + np.log(2 * np.pi * v)).sum(2))
    def moments(w):
        n = (w.sum(0) + 1e-9)[:, None]
        m = w.T @ x / n
        return m, np.maximum(w.T @ x**2 / n - m**2, floor)
    mean, var = moments(share)
    pi, move = np.full(k, 1 / k), np.where(np.eye(k) > 0, 0.95, 0.05 / max(k - 1, 1))
    if k == 1:
        move = np.ones((1, 1))
    trace = []
    for _ in range(steps):
        d = density(mean, var)
        a = np.zeros((t, k))
        a[0] = pi * d[0]
        for i in range(1, t):
            a[i] = (a[i - 1] @ move) * d[i]
        b = np.ones((t, k))
        for i in range(t - 2, -1, -1):
            b[i] = move @ (d[i + 1] * b[i + 1])
        whole = a[-1].sum()
        gamma = a * b / whole
        xi = sum(np.outer(a[i], d[i + 1] * b[i + 1]) * move for i in range(t - 1))
        pi = gamma[0] + 1e-6
        pi /= pi.sum()
        move = xi / xi.sum(1, keepdims=True)
        mean, var = moments(gamma)
        trace.append(np.log(whole))
        if len(trace) > 1 and trace[-1] - trace[-2] < least * abs(trace[-1]):
            break
    return pi, move, mean, var, trace


def chain(spark, n=60, seed=4):
    rng = np.random.default_rng(seed)
    rows, state = [], 0
    for ix in range(n):
        state = state if rng.random() < 0.9 else 1 - state
        rows.append((1, ix, float(rng.normal(0, 1 + 3 * state)), float(rng.normal(2 * state, 0.5))))
    rows += [(2, ix, float(ix % 3), None if ix % 2 else float(ix % 5)) for ix in range(n)] + [(3, ix, 1.0, 1.0) for ix in range(5)]
    return rows, spark.createDataFrame(rows, "series int, ix long, a double, b double")


@pytest.mark.parametrize("states", [1, 2, 3])
def test_chain_equals_plain_em(spark, states):
    rows, series = chain(spark)
    fits = hmm.fit(series, ["a", "b"], by=["series"], order="ix", states=states, key="b", starts=3, min_rows=20).collect()
    assert {(r.series, r.start) for r in fits} == {(s, k) for s in (1, 2) for k in range(3)}  # series 3 is too short
    for r in fits:
        x = np.array([w[2:] for w in rows if w[0] == r.series and w[3] is not None])
        z = (x - x.mean(0)) / (x.std(0) + 1e-9)
        pi, move, mean, var, trace = plain_em(z, hmm.first_shares(z, states, r.start, 1, 0), 200, 1e-3, 1e-6)
        up = np.argsort(mean[:, 1], kind="stable")
        assert r.rows == len(x) and r.steps == len(trace)
        for got, want in ((r.trace, trace), (r.pi, pi[up]), (r.move, move[np.ix_(up, up)]), (r.mean, mean[up]), (r.var, var[up])):
            assert np.allclose(got, want, rtol=1e-6, atol=1e-6)
        assert all(b >= a - 1e-9 for a, b in itertools.pairwise(r.trace)) and (np.array(r.var) >= 1e-3).all()


def test_chain_filter_is_causal(spark):
    _, series = chain(spark)
    fits = hmm.best(hmm.fit(series, ["a", "b"], by=["series"], order="ix", states=2, key="b", min_rows=20), ["series"])
    p = {(r.series, r.ix): r.p for r in hmm.filtered(series, fits, ["a", "b"], by=["series"], order="ix").collect()}
    changed = series.withColumn("a", F.when(F.col("ix") > 40, 99.0).otherwise(F.col("a")))
    later = {(r.series, r.ix): r.p for r in hmm.filtered(changed, fits, ["a", "b"], by=["series"], order="ix").collect()}
    assert all(np.allclose(p[k], later[k]) for k in p if k[1] <= 40) and all(abs(sum(v) - 1) < 1e-9 for v in p.values())
    assert any(not np.allclose(p[k], later[k]) for k in p if k[1] > 40) and not any(k[0] == 3 for k in p)


def test_best_start_and_regime_rows(spark):
    fits = catalog.QUERIES["hmm_fit"](spark, SF).collect()
    assert sorted((r.states, r.state) for r in fits) == [(2, 0), (2, 1), (3, 0), (3, 1), (3, 2)] and all(r.rises for r in fits)
    by = {k: [r.vol for r in sorted(fits, key=lambda r: r.state) if r.states == k] for k in (2, 3)}
    assert all(v == sorted(v) for v in by.values())
    states = catalog.QUERIES["regime_states"](spark, SF).collect()
    assert states and all(abs(r.p_calm + r.p_usual + r.p_stressed - 1) < 1e-5 and r.ix >= 150 for r in states)


def test_event_card_equals_its_rows(spark):
    rows = [r for r in regime._event_probabilities(spark, SF, 2).collect() if r.y is not None]
    card = {r.target: r for r in catalog.QUERIES["regime_event_card"](spark, SF).filter("states = 2").collect()}
    assert {r.target for r in rows} == set(card)
    for target, got in card.items():
        p, y, base = (np.array([getattr(r, c) for r in rows if r.target == target]) for c in ("p", "y", "base"))
        brier = ((p - y) ** 2).mean()
        pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
        assert got.n == len(y) and abs(got.brier - brier) < 1e-6 and abs(got.skill_base - (1 - brier / ((base - y) ** 2).mean())) < 1e-6
        assert abs(got.auc - np.mean(pairs)) < 1e-6


def test_event_rates_know_only_what_was_over(spark, monkeypatch):
    real = regime.market
    later = lambda s, d: real(s, d).withColumns({n: F.when(F.col("ix") + h < 171, F.col(n)).otherwise(1 - F.col(n)) for n, (h, _) in regime.EVENTS.items()})
    before = {(r.ix, r.target): (r.p, r.base) for r in regime._event_probabilities(spark, SF, 2).collect()}
    monkeypatch.setattr(regime, "market", later)
    after = {(r.ix, r.target): (r.p, r.base) for r in regime._event_probabilities(spark, SF, 2).collect()}
    assert all(np.allclose(before[k], after[k]) for k in before if k[0] < 192) and any(not np.allclose(before[k], after[k]) for k in before)


# --- boosted trees -------------------------------------------------------------------------


def twin(x, y, new, *, loss, alpha, trees, depth, rate, bins, min_rows):
    """The same trees on arrays."""
    lowest = lambda v, p: np.sort(v)[max(0, int(np.ceil(p * len(v))) - 1)]
    edges = [sorted({float(lowest(c[~np.isnan(c)], k / bins)) for k in range(1, bins)}) for c in x.T]
    cut = lambda m: np.array([[0 if np.isnan(v) else 1 + int(np.sum(np.array(e) < v)) for v, e in zip(row, edges, strict=True)] for row in m])
    slope = {"l2": lambda r: r, "l1": np.sign, "quantile": lambda r: np.where(r >= 0, alpha, alpha - 1), "huber": lambda r: np.clip(r, -alpha, alpha)}[loss]

    def best(r):
        if loss == "l2":
            return r.mean()
        m = lowest(r, alpha if loss == "quantile" else 0.5)
        return m + np.clip(r - m, -alpha, alpha).mean() if loss == "huber" else m

    b, nb = cut(x), cut(new)
    start = best(y)
    rest, out = y - start, np.full(len(new), start)

    def grow(rows, news, level):
        g = slope(rest[rows])
        top = None
        if level < depth:
            for f in range(x.shape[1]):
                for v in sorted(set(b[rows, f]))[:-1]:
                    left = b[rows, f] <= v
                    if min(left.sum(), (~left).sum()) < min_rows:
                        continue
                    gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(g)
                    if gain > 1e-9 and (top is None or gain > top[0] * (1 + 1e-9)):
                        top = (gain, f, v)
        if top is None:
            return [(rows, news)]
        _, f, v = top
        return grow(rows[b[rows, f] <= v], news[nb[news, f] <= v], level + 1) + grow(rows[b[rows, f] > v], news[nb[news, f] > v], level + 1)

    for _ in range(trees):
        leaves = grow(np.arange(len(y)), np.arange(len(new)), 0)
        if len(leaves) == 1:
            break
        for rows, news in leaves:
            value = best(rest[rows])
            out[news] += rate * value
            rest[rows] -= rate * value
    return out


@pytest.mark.parametrize(("loss", "alpha"), [("l2", 0.5), ("l1", 0.5), ("huber", 0.7), ("quantile", 0.9)])
def test_boosting_equals_twin(spark, loss, alpha):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 2)).round(2)
    y = np.where(x[:, 0] > 0, 3.0, -1.0) + x[:, 1] ** 2 + rng.normal(size=300)
    x[::17, 1] = np.nan
    options = {"loss": loss, "alpha": alpha, "trees": 5, "depth": 2, "rate": 0.3, "bins": 8, "min_rows": 15}
    rows = spark.createDataFrame([(i, float(a), None if np.isnan(b) else float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))] + [(999, 0.0, 0.0, None)], "i int, a double, b double, y double")
    model = histboost.fit(rows, ["a", "b"], "y", **options, keep=2)
    got = {r.i: r.pred for r in model.predict(rows, keep=2).collect()}
    assert np.allclose([got[i] for i in range(300)], twin(x, y, x, **options), atol=1e-9) and 999 in got


def test_boosted_quantile_beats_the_line(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(-2, 2, 4000)
    y = np.abs(x) * rng.exponential(1, 4000)
    rows = spark.createDataFrame([(float(a), float(b), k % 2) for k, (a, b) in enumerate(zip(x, y, strict=True))], "x double, y double, half int")
    model = histboost.fit(rows.filter("half = 0"), ["x"], "y", loss="quantile", alpha=0.9, trees=12, depth=2, rate=0.4)
    test = model.predict(rows.filter("half = 1")).collect()
    loss = lambda e: np.maximum(0.9 * e, -0.1 * e).mean()
    xs, ys, p = (np.array([r[c] for r in test]) for c in ("x", "y", "pred"))
    line = min(loss(ys - a - b * xs) for a in np.linspace(0, 5, 101) for b in np.linspace(-1, 1, 41))  # the best of its kind, on the test rows themselves
    assert loss(ys - p) < 0.9 * line


def test_boosting_without_rows_or_cuts(spark):
    none = spark.createDataFrame([], "x double, y double")
    model = histboost.fit(none, ["x"], "y")
    some = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    assert [r.pred for r in model.predict(some).collect()] == [None] * 5
    assert [r.pred for r in histboost.fit(some, ["x"], "y", min_rows=1).predict(some).collect()] == [2.0] * 5
    with pytest.raises(ValueError, match="unknown loss"):
        histboost.fit(some, ["x"], "y", loss="cosine")


def test_forecast_losses_on_a_noisy_panel(spark):
    card = {r.loss: r for r in catalog.QUERIES["boosted_losses"](spark, SF).collect()}
    assert set(card) == {"l2", "l1", "huber", "quantile"} and len({r.n for r in card.values()}) == 1
    assert all(r.error < 1.05 * r.flat for r in card.values()) and 0.8 < card["quantile"].below < 1


def test_boosted_forecast_equals_twin(spark):
    """The registered query against the trees on arrays."""
    from mirador.plans import estimators

    rows = estimators._feats(spark, SF).collect()
    last = max(r.ix for r in rows)
    train, test = [r for r in rows if r.ix < last - 65], [r for r in rows if r.ix >= last - 60]
    array = lambda some: np.array([[r.x1, r.x2, r.x3] for r in some])
    got = {(r.symbol, r.ix): r for r in catalog.QUERIES["boosted_forecast"](spark, SF).collect()}
    assert set(got) == {(r.symbol, r.ix) for r in test}
    for name, y, loss in (("mean", [r.t for r in train], "l2"), ("robust", [r.t for r in train], "huber"), ("p_rise", [float(r.t > 0) for r in train], "l2")):
        want = twin(array(train), np.array(y), array(test), loss=loss, alpha=0.1, trees=6, depth=3, rate=0.25, bins=32, min_rows=20)
        want = np.clip(want, 0, 1) if name == "p_rise" else want
        assert np.allclose([got[r.symbol, r.ix][name] for r in test], want, atol=2e-6)


# --- walk-forward --------------------------------------------------------------------------


def panel(spark, n=120, symbols=6, seed=8):
    rng = np.random.default_rng(seed)
    rows = [(s, ix, float(a), float(b), float(2 * a - b + rng.normal(0, 0.1))) for ix in range(n) for s in range(symbols) for a, b in [rng.normal(size=2)]]
    return spark.createDataFrame(rows, "symbol int, ix long, a double, b double, y double")


class Mean:
    """An estimator that reads its rows."""

    def fit(self, train):
        return train.agg(F.avg("y")).first()[0]

    def predict(self, model, rows):
        return rows.withColumn("pred", F.lit(model))


ESTIMATORS = {"ridge": lambda: walkforward.Ridge(["a", "b"], "y", 0.1), "rates": lambda: walkforward.Rates(["symbol"], "y", 5), "blend": lambda: walkforward.Blend(["a", "b"], "y"), "mean": Mean, "boosted": lambda: walkforward.Boosted(["a", "b"], "y", trees=2, depth=2)}


@pytest.mark.parametrize("name", list(ESTIMATORS))
def test_embargo(spark, name):
    """Targets not yet known change no forecast; one that was just known changes one."""
    options = {"first": 50, "step": 30, "embargo": 5}
    rows = panel(spark)
    walk = lambda df: {(r.symbol, r.ix): (r.block, r.trained, r.pred) for r in walkforward.walk_forward(df, ESTIMATORS[name](), **options).collect()}
    base = walk(rows)
    assert {k[1] for k in base} == set(range(50, 120)) and len(base) == 70 * 6
    assert {(b, n) for b, n, _ in base.values()} == {(0, 45 * 6), (1, 75 * 6), (2, 105 * 6)}
    unknown = walk(rows.withColumn("y", F.when(F.col("ix") >= 45, 1000.0).otherwise(F.col("y"))))
    assert all(np.isclose(base[k][2], unknown[k][2]) for k in base if k[1] < 80)
    known = walk(rows.withColumn("y", F.when(F.col("ix") == 44, 1000.0 + 9000 * F.col("b")).otherwise(F.col("y"))))
    assert any(not np.isclose(base[k][2], known[k][2]) for k in base if k[1] < 80)


def test_ridge_equals_numpy(spark):
    rows = panel(spark)
    got = {(r.symbol, r.ix): r.pred for r in walkforward.walk_forward(rows, walkforward.Ridge(["a", "b"], "y", 3.0), first=50, step=30, embargo=5).collect()}
    data = np.array([tuple(r) for r in rows.collect()])
    for lo, hi, to in ((50, 80, 44), (80, 110, 74), (110, 120, 104)):
        train, test = data[data[:, 1] <= to], data[(data[:, 1] >= lo) & (data[:, 1] < hi)]
        m, t = train[:, 2:4].mean(0), train[:, 4].mean()
        c = train[:, 2:4] - m
        beta = np.linalg.solve(c.T @ c + 3 * np.eye(2), c.T @ (train[:, 4] - t))
        assert np.allclose([got[(int(r[0]), int(r[1]))] for r in test], t + (test[:, 2:4] - m) @ beta)


def shuffled(spark, run):
    """Records that stages wrote to shuffles meanwhile."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (lambda q: [q.apply(i) for i in range(q.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = stages()
    run()
    return sum(n for k, n in stages().items() if k not in before)


def test_walk_moves_rows_once(spark):
    rows = panel(spark, 400, 40)
    n = rows.count()
    options = {"first": 50, "step": 10, "embargo": 5}  # 35 blocks
    assert shuffled(spark, lambda: walkforward.walk_forward(rows, Mean(), **options).write.format("noop").mode("overwrite").save()) <= 2 * n
    assert shuffled(spark, lambda: walkforward.walk_forward(rows, walkforward.Ridge(["a", "b"], "y"), **options).write.format("noop").mode("overwrite").save()) <= 2 * n


def test_too_little_to_train_on(spark):
    rows = panel(spark, 60)
    for make in ESTIMATORS.values():
        assert walkforward.walk_forward(rows, make(), first=50, step=10, embargo=5, min_train=10_000).count() == 0
        assert walkforward.walk_forward(rows.filter("false"), make(), first=50, step=10, embargo=5).count() == 0


# --- blends --------------------------------------------------------------------------------


def test_simplex_equals_every_support():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 5):
        for _ in range(40):
            f = rng.normal(size=(30, k)) + rng.normal(size=(30, 1))
            y = f @ rng.normal(size=k) + rng.normal(size=30)
            a, b = f.T @ f, f.T @ y
            w = walkforward.simplex(a, b)
            assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
            best = np.inf
            for n in range(1, k + 1):
                for s in map(list, itertools.combinations(range(k), n)):
                    m = np.block([[2 * a[np.ix_(s, s)], np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
                    v = np.linalg.solve(m, np.append(2 * b[s], 1))[:n]
                    if (v >= -1e-9).all():
                        best = min(best, v @ a[np.ix_(s, s)] @ v - 2 * b[s] @ v)
            assert w @ a @ w - 2 * b @ w <= best + 1e-6 * max(1, abs(best))


def test_simplex_of_equal_forecasts():
    w = walkforward.simplex(np.full((3, 3), 4.0), np.full(3, 4.0))
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()


# --- running quantiles ---------------------------------------------------------------------


def values(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, 900), rng.normal(1e-9, 1e-10, 100), np.zeros(300), np.full(300, 2.5), -np.exp(rng.normal(0, 9, 200))])
    rows = [(int(i), float(x)) for i, x in zip(rng.integers(0, 100, len(v)), v, strict=True)] + [(3, None), (4, float("nan"))]
    df = spark.createDataFrame(rows, "ix long, v double")
    return rows, df, models.blocks(df.select("ix"), 0, 7, 2)


def test_exact_quantiles_equal_numpy(spark):
    rows, df, blocks = values(spark)
    got = {r.block: r for r in quantiles.exact(df, "v", "ix", blocks, [0.0, 0.1, 0.5, 0.937, 1.0]).collect()}
    for b in blocks.collect():
        own = [v for i, v in rows if i <= b.train_to and v is not None and not np.isnan(v)]
        assert (b.block in got) == bool(own)
        if own:
            assert got[b.block].n == len(own) and np.allclose([got[b.block][f"q{k}"] for k in range(5)], np.quantile(own, [0.0, 0.1, 0.5, 0.937, 1.0]), rtol=1e-12)


def test_sketched_quantiles_within_their_error(spark):
    rows, df, blocks = values(spark)
    probs = [0.1, 0.5, 0.9]
    for r in quantiles.sketched(df, "v", "ix", blocks, probs, k=200).collect():
        own = np.array([v for i, v in rows if i <= 7 * r.block - 3 and v is not None and not np.isnan(v)])
        assert r.n == len(own)
        for k, p in enumerate(probs):
            low, high = (own < r[f"q{k}"]).mean(), (own <= r[f"q{k}"]).mean()
            assert low - 2 * quantiles.rank_error(200) <= p <= high + 2 * quantiles.rank_error(200) + 1 / len(own)


# --- calibration ---------------------------------------------------------------------------


def rising(hits, n):
    """The nearest rising means by the max-min formula."""
    m = lambda a, b: sum(hits[a : b + 1]) / sum(n[a : b + 1])
    k = len(n)
    return [max(min(m(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]


def test_refits_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 2)), int(rng.integers(0, 60)), float(s), int(rng.random() < s**2)) for s in rng.random(800)] + [(0, 5, None, 1), (1, 5, 0.5, None)]
    df = spark.createDataFrame(rows, "grp int, ix long, s double, y int")
    blocks = models.blocks(df.select("ix"), 10, 9, 2)
    curves = calibration.refits(df, blocks, score="s", y="y", at="ix", by=["grp"], grid=16, min_rows=60)
    got = {(r.grp, r.block, r.score): (r.n, r.raw, r.iso) for r in curves.collect()}
    want = {}
    for b in blocks.collect():
        for g in (0, 1):
            own = [(int(np.floor(s * 16 + 0.5)), y) for q, i, s, y in rows if q == g and i <= b.train_to and s is not None and y is not None]
            keys = sorted({k for k, _ in own})
            if len(own) >= 60:
                hits, n = [sum(y for q, y in own if q == k) for k in keys], [sum(q == k for q, _ in own) for k in keys]
                want |= {(g, b.block, k / 16): (m, h / m, v) for k, h, m, v in zip(keys, hits, n, rising(hits, n), strict=True)}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    # a line between points, the ends beyond them
    curve = {s: v[2] for (g, b, s), v in got.items() if (g, b) == (0, 5)}
    ask = spark.createDataFrame([(0, 5, x) for x in (0.0, 0.03, 0.5, 0.51, 0.99, 1.0)] + [(0, 99, 0.5), (0, 5, None)], "grp int, block int, s double")
    for r in calibration.apply(ask, curves, score="s", by=["grp"]).collect():
        if r.block == 99 or r.s is None:
            assert r.calibrated is None
        else:
            assert abs(r.calibrated - np.interp(r.s, sorted(curve), [curve[s] for s in sorted(curve)])) < 1e-12


def test_recalibration_helps(spark):
    card = catalog.QUERIES["calibrator_card"](spark, SF).collect()
    assert card and sum(r.n * r.brier for r in card) < sum(r.n * r.brier_raw for r in card)


# --- clustered errors ----------------------------------------------------------------------


def test_clustered_errors_equal_the_sandwich(spark):
    rows = panel(spark, 60, 5)
    got = {r.x: r for r in models.clustered(rows.withColumn("c", F.col("a") * F.col("b")), ["a", "b", "c"], "y", "ix").collect()}
    data = np.array([tuple(r) for r in rows.collect()])
    x = np.column_stack([np.ones(len(data)), data[:, 2], data[:, 3], data[:, 2] * data[:, 3]])
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ data[:, 4]
    e = data[:, 4] - x @ beta
    scores = np.array([x[data[:, 1] == ix].T @ e[data[:, 1] == ix] for ix in np.unique(data[:, 1])])
    se = np.sqrt(np.diag(inverse @ scores.T @ scores @ inverse))
    for k, name in enumerate(("a", "b", "c"), 1):
        assert np.allclose([got[name].b, got[name].se, got[name].t], [beta[k], se[k], beta[k] / se[k]]) and (got[name].n, got[name].clusters) == (300, 60)
    assert models.clustered(rows.withColumn("c", 2 * F.col("a")), ["a", "c"], "y", "ix").count() == 0
    assert models.clustered(rows.filter("false"), ["a"], "y", "ix").count() == 0


def test_losses_are_fitted_on_a_table_written_once(spark, monkeypatch):
    from mirador.plans import walks

    read, fit = [], walks.B.fit
    monkeypatch.setattr(walks.B, "fit", lambda train, *a, **k: read.append(train.inputFiles()) or fit(train, *a, **k))
    catalog.QUERIES["boosted_losses"](spark, SF)
    assert len(read) == 4 and not any("lineitem" in f for files in read for f in files)
