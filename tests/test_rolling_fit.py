"""Moving least squares against a fresh solution at every row."""

import datetime as dt

import numpy as np
import pytest

from pelagos.operators import rolling_fit as rf


def fresh(r, e, window, ridge):
    n, k = r.shape
    made = np.full((n, k), np.nan)
    for i in range(window - 1, n):
        x, y = r[i - window + 1 : i + 1], e[i - window + 1 : i + 1]
        mean, spread = x.mean(0), x.std(0, ddof=1)
        if not (spread > 1e-12).all():
            continue
        c = x - mean
        b = np.linalg.solve(c.T @ c + ridge * np.eye(k), c.T @ y)
        raw = (c[-1] @ b / spread - y[-1] / spread) / spread
        made[i] = raw / raw.sum()
    return made


@pytest.mark.parametrize(("k", "window", "n"), [(1, 5, 40), (3, 20, 200), (8, 30, 1200), (30, 80, 200)])
@pytest.mark.parametrize("ridge", [0.0, 1e-4])
def test_walk_equals_fresh_solutions(k, window, n, ridge):
    rng = np.random.default_rng(k)
    r, e = rng.normal(size=(n, k)) * 0.02, rng.normal(size=(n, k)) * 0.01
    got, want = rf.residual_walk(r, e, window, ridge), fresh(r, e, window, ridge)
    assert (np.isnan(got) == np.isnan(want)).all()
    size = np.nan_to_num(np.abs(want)) + 1
    np.testing.assert_allclose(np.nan_to_num(got) / size, np.nan_to_num(want) / size, atol=1e-8)


def test_flat_and_dependent_series_have_no_weights():
    rng = np.random.default_rng(0)
    r = rng.normal(size=(60, 3))
    r[20:45, 1] = 0.5
    got = rf.residual_walk(r, rng.normal(size=(60, 3)), 10, 0.0)
    assert np.isnan(got[29:45]).all() and not np.isnan(got[46:]).any()
    r[:, 2] = r[:, 0]
    assert np.isnan(rf.residual_walk(r, r, 10, 0.0)).all()


@pytest.mark.parametrize("span_rows", [7, 4096])
def test_spans(spark, span_rows):
    rng = np.random.default_rng(1)
    n, k = 40, 3
    r, e = rng.normal(size=(2, n, k)), rng.normal(size=(2, n, k))
    rows = [(b, dt.datetime(2024, 1, 1) + dt.timedelta(t), f"a{i}", float(r[b, t, i]), float(e[b, t, i])) for b in range(2) for t in range(n) for i in range(k)]
    frame = spark.createDataFrame(rows, "book int, ts timestamp, alpha string, r double, e double")
    found = rf.residual_weights(frame, 12, 0.1, ("book",), span_rows).collect()
    assert len(found) == 2 * (n - 11) * k
    for b in range(2):
        want = rf.residual_walk(r[b], e[b], 12, 0.1)
        got = [x for x in found if x.book == b]
        np.testing.assert_allclose([x.w for x in got], [want[(x.ts - dt.datetime(2024, 1, 1)).days, int(x.alpha[1])] for x in got], atol=1e-9)
    assert rf.residual_weights(frame.limit(0), 12, 0.1, ("book",)).count() == 0
    assert rf.residual_weights(frame.where("ts < '2024-01-05'"), 12).count() == 0
