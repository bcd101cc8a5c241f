"""Components, hedges and optimised weights against dense linear algebra and plain loops."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagos.operators import factors
from pelagos.operators import optimise as op

T, N = 30, 50
DAY0 = dt.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    r = rng.normal(size=(T, 3)) @ rng.normal(size=(3, N)) * 0.05 + rng.normal(size=(T, N)) * 0.02
    r[:, 7] = 0.01  # never varies
    return r, rng.normal(size=(T, N))


@pytest.fixture(scope="module")
def panel(spark, data):
    r, o = data
    rows = [(DAY0 + dt.timedelta(t), i, float(r[t, i]) if r[t, i] != 0.01 or t % 2 else 0.01, float(o[t, i])) for t in range(T) for i in range(N)]
    return spark.createDataFrame(rows, "ts timestamp, inst int, r double, o double").repartition(3).cache()


def matrix(df, column):
    made = np.full((T, N), np.nan)
    for row in df.select("ts", "inst", column).collect():
        made[(row.ts - DAY0).days, row.inst] = row[2]
    return made


def directions(x, k, scaled=False):
    x = x - x.mean(0)
    if scaled:
        s = x.std(0)
        x = np.where(s > 1e-8, x / np.where(s > 1e-8, s, 1), 0)
    _, s, v = np.linalg.svd(x, full_matrices=False)
    return v[:k], (s**2)[:k], (s**2).sum()


def test_residual_of_the_whole_panel(panel, data):
    r, o = data
    v, _, _ = directions(r, 2)
    got = matrix(factors.pca_residual(panel, "o", "r", 2), "residual")
    np.testing.assert_allclose(got, o - o @ v.T @ v, atol=1e-9)
    assert np.abs(got @ v.T).max() < 1e-9  # orthogonal to the components


@pytest.mark.parametrize(("window", "every", "lag"), [(12, 5, 1), (7, 1, 0), (10, 20, 2)])
def test_residual_in_windows(panel, data, window, every, lag, monkeypatch):
    monkeypatch.setattr(factors, "GROUP_VALUES", 64)  # many groups of instruments, summed in two rounds
    r, o = data
    want = o.copy()
    for t in range(T):
        if t - lag >= window - 1:
            e = window - 1 + (t - lag - window + 1) // every * every
            v, _, _ = directions(r[e - window + 1 : e + 1], 3)
            want[t] = o[t] - o[t] @ v.T @ v
    got = matrix(factors.pca_residual(panel, "o", "r", 3, window, every, lag), "residual")
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_hedge_is_the_dense_solution(panel, data):
    r, o = data
    o = np.where(np.arange(N) % 4 == 0, 0, o)
    window, every, lag, strength = 12, 6, 1, 2.0
    want = o.copy()
    for t in range(T):
        if t - lag >= window - 1:
            e = window - 1 + (t - lag - window + 1) // every * every
            v, s, total = directions(r[e - window + 1 : e + 1], 3, scaled=True)
            w = o[t].copy()
            a = w != 0
            w[a] = np.linalg.solve(np.eye(a.sum()) + strength * v[:, a].T @ np.diag(s / total) @ v[:, a], w[a])
            w[w * o[t] <= 0] = 0
            want[t] = w / np.abs(w).sum()
    zeroed = panel.withColumn("o", F.when(F.col("inst") % 4 == 0, 0.0).otherwise(F.col("o")))
    got = matrix(factors.hedged_weights(zeroed, "o", "r", 3, window, every, lag, strength), "hedged")
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_variances_of_planted_factors(spark, panel, data):
    r, _ = data
    _, s, total = directions(r, 5)
    got = sorted((row.k, row.variance, row.share) for row in factors.factor_variances(panel, "r", 5).collect())
    np.testing.assert_allclose(got, [(k + 1, s[k] / (T - 1), s[k] / total) for k in range(5)])
    line = spark.createDataFrame([(DAY0 + dt.timedelta(t), i, float(t % 5 * (i + 1))) for t in range(10) for i in range(4)], "ts timestamp, inst int, r double")
    assert [row.k for row in factors.factor_variances(line, "r", 3).collect()] == [1]  # one direction only


def test_missing_rows_short_panels_and_no_rows(spark, panel):
    few = panel.where("ts < '2020-01-04'")
    assert factors.pca_windows(few, "r", 5, 1).count() == 0
    kept = factors.pca_residual(few, "o", "r", 1, 5).collect()
    assert len(kept) == 3 * N and all(row.residual == row.o for row in kept)
    assert factors.pca_residual(panel.limit(0), "o", "r", 1, 5).count() == 0
    assert factors.pca_residual(panel.limit(0), "o", "r").count() == 0
    assert factors.hedged_weights(panel.limit(0), "o", "r").count() == 0
    holes = panel.withColumn("r", F.when(F.col("inst") != 3, F.col("r"))).withColumn("o", F.when(F.col("inst") != 4, F.col("o")))
    rows = {row.inst: row.residual for row in factors.pca_residual(holes, "o", "r").where("ts = '2020-01-05'").collect()}
    assert len(rows) == N and None not in rows.values()
    with pytest.raises(ValueError, match="window"):
        factors.pca_windows(panel, "r", 10_000, 1)


def conditions(w, mean, s, rules, previous):
    slope = mean - rules.aversion * s @ w
    more = slope - np.where(w >= previous - 1e-7, rules.cost, -rules.cost)
    less = slope - np.where(w > previous + 1e-7, rules.cost, -rules.cost)
    up, down = w < rules.high - 1e-7, w > rules.low + 1e-7
    return more[up].max() - less[down].min() if up.any() and down.any() else 0.0


def test_solutions_meet_their_conditions():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, length = int(rng.integers(2, 30)), int(rng.integers(5, 60))
        r = rng.normal(size=(length, n)) * 0.02 + rng.normal(size=n) * 0.002
        rules = op.Programme(
            aversion=float(rng.choice([1, 10, 50])), cost=float(rng.choice([0, 0.0005, 0.002])), shrink=0.3, ridge=1e-6,
            low=float(rng.choice([0, -0.2])), high=float(rng.choice([1, 0.4])) if n > 3 else 1.0,
        )
        previous = rng.dirichlet(np.ones(n))
        mean, diagonal, x = op.window_moments(r, rules)
        w, gap, _ = op.solve(mean, diagonal, x, rules, previous)
        assert gap < 1e-8 and abs(w.sum() - 1) < 1e-6
        assert conditions(w, mean, np.diag(diagonal) + x.T @ x, rules, previous) < 1e-6 * np.abs(mean).max()


def test_gross_turnover_and_neutrality_against_feasible_points():
    rng = np.random.default_rng(2)
    for _ in range(10):
        n = 12
        r = rng.normal(size=(8, n)) * 0.02  # fewer times than names: the short side is inverted
        rules = op.Programme(aversion=5.0, cost=0.001, total=0.0, low=-0.3, high=0.3, gross=1.0, turnover=0.8, shrink=0.9, ridge=1e-6, residual=1e-8)
        neutral = np.linalg.svd(r - r.mean(0))[2][:2]
        previous = np.zeros(n)
        mean, diagonal, x = op.window_moments(r, rules)
        w, gap, _ = op.solve(mean, diagonal, x, rules, previous, neutral)
        assert gap < 1e-7 and np.abs(w).sum() <= 0.8 + 1e-5 and abs(w.sum()) < 1e-5 and np.abs(neutral @ w).max() < 1e-5
        s = np.diag(diagonal) + x.T @ x
        value = lambda v: mean @ v - 2.5 * v @ s @ v - 0.001 * np.abs(v).sum()  # noqa: B023, E731
        e = np.vstack([np.ones(n), neutral])
        for _ in range(300):
            v = rng.normal(size=n)
            v -= np.linalg.pinv(e) @ (e @ v)
            v *= min(0.8 / np.abs(v).sum(), 0.3 / np.abs(v).max()) * rng.random()
            assert value(v) <= value(w) + 1e-7
            assert value(0.99 * w + 0.01 * v) <= value(w) + 1e-8


@pytest.mark.parametrize("chained", [False, True])
def test_rolling_weights_are_those_of_a_plain_loop(spark, chained):
    rng = np.random.default_rng(3)
    length, n, lookback, every = 41, 5, 10, 3
    r = rng.normal(size=(length, n)) * 0.02
    r[:20, 4] = np.nan  # begins late
    rows = [(b, DAY0 + dt.timedelta(t), f"a{i}", None if np.isnan(r[t, i]) else float(r[t, i] * (b + 1))) for b in range(2) for t in range(length) for i in range(n)]
    frame = spark.createDataFrame(rows, "book int, ts timestamp, alpha string, r double")
    rules = op.Programme(aversion=3.0, cost=0.001, shrink=0.5, ridge=1e-5)
    got = {(row.book, (row.ts - DAY0).days, row.alpha): row.w for row in op.rolling_weights(frame, lookback, every, rules, ("book",), chained).collect()}
    want = {}
    for b in range(2):
        before = None
        for t in range(lookback, length, every):
            own = r[t - lookback : t] * (b + 1)
            there = (~np.isnan(own)).sum(0) >= 2
            k = int(there.sum())
            previous = before[there] if chained and before is not None else np.full(k, 1 / k)
            w, _, _ = op.solve(*op.window_moments(np.nan_to_num(own[:, there]), rules), rules, previous)
            before = np.zeros(n)
            before[there] = w
            want |= {(b, t, f"a{i}"): before[i] for i in np.flatnonzero(there)}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-7)
    assert op.rolling_weights(frame.limit(0), lookback, every, rules, ("book",), chained).count() == 0
    assert op.rolling_weights(frame.where("ts < '2020-01-08'"), lookback, every, rules, ("book",)).count() == 0
