"""Regressions on random features against a plain loop over refits."""

import datetime as dt

import numpy as np
import pytest

from pelagos.operators import random_features as rf

T, N, K = 50, 12, 3
DAY0 = dt.datetime(2020, 1, 1)
FITS = [
    rf.Fit(features=4, horizon=1, window=21, every=5, warmup=25, ridge=2.0),
    rf.Fit(features=3, horizon=3, window=20, every=4, warmup=20, ridge=1.0, least_rows=10),
    rf.Fit(features=3, horizon=2, window=24, every=4, warmup=10, ridge=1.0, least_rows=150),
]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(T, N, K))
    x[rng.random((T, N, K)) < 0.1] = np.nan
    x[7, :, 1] = 3.0  # without spread
    x[9, 3:, 2] = np.nan  # too few
    return x, rng.normal(size=(T, N)) * 0.05


@pytest.fixture(scope="module")
def panel(spark, data):
    x, r = data
    rows = [(DAY0 + dt.timedelta(t), i, *(None if np.isnan(v) else float(v) for v in x[t, i]), float(r[t, i])) for t in range(T) for i in range(N)]
    return spark.createDataFrame(rows, "ts timestamp, inst int, a double, b double, c double, r double").repartition(3).cache()


def plain(x, r, fit):
    mean, spread = np.nanmean(x, 1, keepdims=True), np.nanstd(x, 1, keepdims=True)
    enough = ((~np.isnan(x)).sum(1, keepdims=True) >= 5) & (spread > 1e-10)
    z = np.nan_to_num(np.clip(np.where(enough, (x - mean) / np.where(enough, spread, 1), 0), -5, 5))
    z = rf.random_features(z.reshape(-1, K), rf.directions(K, fit.features, fit.seed)).reshape(T, N, -1)
    h, out, beta = fit.horizon, np.full((T, N), np.nan), None
    y = np.array([r[t + 1 : t + h + 1].sum(0) if t + h < T else np.full(N, np.nan) for t in range(T)])
    for t in range(T):
        if t >= fit.warmup and (t - fit.warmup) % fit.every == 0:
            own = slice(max(0, t - fit.window), t - h)
            a, b = z[own].reshape(-1, z.shape[2]), np.clip(y[own].ravel(), -fit.most * h, fit.most * h)
            if len(b) >= fit.least_rows:
                beta = np.linalg.solve(a.T @ a + fit.ridge * np.eye(a.shape[1]), a.T @ b)
        if beta is not None:
            out[t] = z[t] @ beta
    return out


@pytest.mark.parametrize("fit", FITS)
@pytest.mark.parametrize("small", [False, True])
def test_forecasts(panel, data, fit, small, monkeypatch):
    if small:  # many groups of rows and many spans of refits
        monkeypatch.setattr(rf, "GROUP_VALUES", 200)
        monkeypatch.setattr(rf, "SPAN_VALUES", 500)
    got = np.full((T, N), np.nan)
    for row in rf.rff_predict(panel, ["a", "b", "c"], "r", fit).collect():
        got[(row.ts - DAY0).days, row.inst] = np.nan if row.predicted is None else row.predicted
    np.testing.assert_allclose(got, plain(*data, fit), atol=1e-10)


def test_short_and_empty_panels(panel):
    fit = FITS[0]
    short = rf.rff_predict(panel.where("ts < '2020-01-06'"), ["a"], "r", fit).collect()
    assert len(short) == 5 * N and all(row.predicted is None for row in short)
    assert rf.rff_predict(panel.limit(0), ["a"], "r", fit).count() == 0
    with pytest.raises(ValueError, match="horizon"):
        rf.Fit(horizon=12, window=10)
