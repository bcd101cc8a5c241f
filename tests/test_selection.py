"""The choice of alphas inside folds against a run of each fold on its own."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from pelagos.plans import selection

DAY0 = dt.datetime(2024, 1, 1)
FOLDS = selection.Folds(train=30, val=20, step=10, warmup=10, closeness=20, most_corr=0.4, most=3, least_bars=8, least_names=6)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    t, n = 115, 14
    ret = rng.normal(size=(t, n)) * 0.02
    base = np.roll(ret, -1, 0) + rng.normal(size=(t, n)) * 0.05
    s = {f"a{k}": base * (k % 3 == 0) + rng.normal(size=(t, n)) * (0.02 + 0.02 * k) for k in range(7)}
    s["flat"] = np.ones((t, n))
    s["late"] = np.where(np.arange(t)[:, None] < 60, np.nan, base)
    return ret, s


@pytest.fixture(scope="module")
def signals(spark, data):
    ret, s = data
    rows = [(k, DAY0 + dt.timedelta(i), j, None if np.isnan(x[i, j]) else float(x[i, j]), float(ret[i, j])) for k, x in s.items() for i in range(len(ret)) for j in range(ret.shape[1])]
    return spark.createDataFrame(rows, "alpha string, ts timestamp, inst int, s double, ret double").repartition(3).cache()


def pnl(x, ret):
    x = pd.DataFrame(x)
    w = x.sub(x.mean(axis=1), axis=0)
    w = w.div(w.abs().sum(axis=1).replace(0, np.nan), axis=0)
    return (w.shift(1) * ret).sum(axis=1)


def one_fold(ret, s, at):
    """The choice at bar ``at`` from slices of the data alone."""
    f, scores = FOLDS, {}
    for k, x in s.items():
        parts = []
        for a, b in ((at - f.train - f.val, at - f.val), (at - f.val, at)):
            r = pnl(x[a:b], ret[a:b])
            parts.append(r.mean() / r.std() * math.sqrt(252) if r.std() > 1e-12 else np.nan)
        if parts[0] > 0 and parts[1] > 0:
            scores[k] = parts

    def close(a, b):
        made = []
        for i in range(at - f.closeness, at):
            ok = ~np.isnan(s[a][i]) & ~np.isnan(s[b][i])
            if ok.sum() >= f.least_names:
                c = np.corrcoef(s[a][i][ok], s[b][i][ok])[0, 1]
                made += [] if np.isnan(c) else [abs(c)]
        return np.mean(made) if made else 1.0

    chosen = []
    for k in sorted(scores, key=lambda k: (-sum(scores[k]) / 2, k)):
        if len(chosen) < f.most and all(close(k, c) <= f.most_corr for c in chosen):
            chosen.append(k)
    return [(k, *scores[k]) for k in chosen]


@pytest.mark.parametrize("cells", [1 << 22, 40])
def test_folds_equal_their_own_runs(signals, data, cells, monkeypatch):
    monkeypatch.setattr(selection, "GROUP_CELLS", cells)
    got = {}
    for r in selection.choose(signals, FOLDS).collect():
        got.setdefault((r.fold, (r.ts - DAY0).days), {})[r.place] = (r.alpha, r.train, r.val)
    ats = range(60, 115, 10)
    want = {(i, at): one_fold(*data, at) for i, at in enumerate(ats)}
    assert sum(len(v) > 1 for v in want.values()) > 2
    assert {k: [x[0] for _, x in sorted(v.items())] for k, v in got.items()} == {k: [x[0] for x in v] for k, v in want.items() if v}
    for k, v in got.items():
        np.testing.assert_allclose([x[1:] for _, x in sorted(v.items())], [x[1:] for x in want[k]], rtol=1e-9)


def test_returns_after_the_choice(signals, data):
    ret, s = data
    made = {(r.fold, (r.ts - DAY0).days): (r.r, r.names) for r in selection.fold_returns(selection.choose(signals, FOLDS), signals, FOLDS).collect()}
    for i, at in enumerate(range(60, 115, 10)):
        names = [k for k, *_ in one_fold(ret, s, at)]
        for t in range(at + 1, min(at + 10, len(ret))):
            if names:
                np.testing.assert_allclose(made[i, t][0], np.mean([pnl(s[k], ret)[t] for k in names]), atol=1e-12)
                assert made[i, t][1] == len(names)


def test_short_and_empty_input(signals):
    assert selection.choose(signals.where("ts < '2024-02-01'"), FOLDS).count() == 0
    assert selection.choose(signals.limit(0), FOLDS).count() == 0
