"""Quantiles of moving and growing windows against a sort of every window, and causal cleaning against plain loops."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from pelagos.operators import order_stats as os_
from pelagos.plans import cleaning


def test_windows_are_those_of_a_sort():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, w = int(rng.integers(1, 80)), int(rng.integers(1, 20))
        x = rng.integers(0, 10, n).astype(float)
        x[rng.random(n) < 0.2] = np.nan
        q, least = float(rng.choice([0, 0.1, 0.5, 0.75, 1])), int(rng.integers(1, min(w, 4) + 1))
        s = pd.Series(x)
        np.testing.assert_allclose(os_.moving_quantile(x, w, q, least), s.rolling(w, min_periods=least).quantile(q))
        np.testing.assert_allclose(os_.growing_quantile(x, q, least), s.expanding(least).quantile(q))


@pytest.mark.parametrize("span_rows", [7, 1 << 16])
def test_frames_in_spans(spark, span_rows):
    rng = np.random.default_rng(1)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), None if rng.random() < 0.2 else float(rng.integers(0, 9)), "x") for k in ("a", None, "b") for i in range(40)]
    rows += [("c", dt.datetime(2024, 1, 1), None, "x")]
    frame = spark.createDataFrame(rows, "inst string, ts timestamp, v double, _own string").repartition(3)
    moving = os_.rolling_quantile(frame, "v", 10, 0.25, 3, span_rows=span_rows).toPandas()
    growing = os_.expanding_quantile(frame, "v", 0.25, 3).toPandas()
    assert len(moving) == len(growing) == len(rows)
    assert list(moving.columns) == ["inst", "ts", "v", "_own", "quantile"]
    for found, whole in ((moving, False), (growing, True)):
        for _, own in found.groupby("inst", dropna=False):
            own = own.sort_values("ts")
            s = own["v"].astype(float)
            want = s.expanding(3).quantile(0.25) if whole else s.rolling(10, min_periods=3).quantile(0.25)
            np.testing.assert_allclose(own["quantile"].astype(float), want)
    assert os_.rolling_quantile(frame.limit(0), "v", 5).count() == os_.expanding_quantile(frame.limit(0), "v").count() == 0


def bars(spark, closes, **columns):
    """One row per (inst, day) from lists of closes; high and low are a tenth away unless given."""
    rows = []
    for inst, series in closes.items():
        for i, c in enumerate(series):
            own = {k: v[inst][i] for k, v in columns.items() if inst in v}
            up = lambda d: None if c is None else c + d  # noqa: B023, E731
            rows.append((inst, dt.datetime(2024, 1, 1) + dt.timedelta(days=i), c, own.get("high", up(0.1)), own.get("low", up(-0.1)), c, own.get("volume", 10.0), own.get("dollars", 1000.0)))
    return spark.createDataFrame(rows, "inst string, ts timestamp, open double, high double, low double, close double, volume double, dollars double")


def test_exclusion_reasons(spark):
    n = 20
    closes = {
        "good": [10.0 + i for i in range(n)], "few": [1.0 + i for i in range(4)] + [None] * (n - 4), "holes": [None, 5.0 + 1] * 3 + [7.0 + i for i in range(n - 6)],
        "stale": [5.0, 5.0, 5.0, 5.0, 5.0, 5.0] + [6.0 + i for i in range(n - 6)], "zero": [0.0] + [1.0 + i for i in range(n - 1)], "poor": [3.0 + i for i in range(n)],
    }
    limits = cleaning.Limits(least_bars=10, most_missing=0.1)
    panel = bars(spark, closes, dollars={"poor": [1.0] * n})
    found = {r.inst: r.reason for r in cleaning.excluded_instruments(panel, limits).collect()}
    assert found == {"few": "few_bars", "holes": "missing", "stale": "stale", "zero": "not_positive", "poor": "illiquid"}
    still = cleaning.Limits(least_bars=10, most_stale=2.0, most_still=0.2)
    assert {r.inst: r.reason for r in cleaning.excluded_instruments(panel.where("inst IN ('stale', 'good')"), still).collect()} == {"stale": "coarse"}


def test_faults_of_bars(spark):
    closes = {"a": [1.0, 1.5, 1.5, 1.5, 1.6, None, 1.7, None, 9.0, 9.1], "b": [2.0 + i for i in range(10)]}
    panel = bars(
        spark, closes, volume={"b": [5.0, 0.0, 0.0, 0.0, 5.0, 0.0, 5.0, None, None, 5.0]},
        high={"b": [3.0, 4.0, 5.0, 6.0, 5.0, 8.0, 8.0, 9.0, 10.0, 11.0]}, low={"b": [1.0, 2.0, 3.0, 4.0, 6.5, 6.0, 8.0, 8.5, 9.0, 10.0]},
    )
    made = cleaning.bar_faults(panel, cleaning.Limits(stale_run=2, empty_run=3)).orderBy("inst", "ts").collect()
    faults = [r.fault for r in made]
    assert faults[:10] == [None, None, "stale", "stale", None, None, None, None, "jump", None]
    assert faults[10:] == [None, "empty", "empty", "empty", "broken", None, "flat", None, None, None]
    empty = {(r.inst, r.ts.day): r.close for r in cleaning.emptied(cleaning.bar_faults(panel, cleaning.Limits(stale_run=2))).collect()}
    assert empty["a", 3] is None and empty["a", 2] == 1.5 and empty["b", 7] is None


def test_caps_come_from_the_bars_before(spark):
    rng = np.random.default_rng(3)
    r = np.where(rng.random(60) < 0.1, rng.normal(size=60) * 3, rng.normal(size=60) * 0.01)
    dollars = np.where(rng.random(60) < 0.1, 1e6, rng.uniform(900, 1100, 60))
    dollars[40], r[40] = 1e6, 0.5  # a bad print
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), None if i % 13 == 5 else float(r[i]), float(dollars[i])) for i in range(60)]
    limits = cleaning.Limits(window=20, least_window=5)
    found = cleaning.capped_returns(spark.createDataFrame(rows, "inst string, ts timestamp, r double, dollars double"), "r", "dollars", limits)
    got = found.toPandas().sort_values("ts")["capped"].astype(float)
    x = pd.Series([np.nan if v[2] is None else v[2] for v in rows]).clip(-0.15, 0.15)
    cap = (x.abs().rolling(20, min_periods=5).median().shift(1) * 5).clip(lower=0.02)
    want = x.clip(lower=-cap, upper=cap)
    usual = pd.Series(dollars).rolling(20, min_periods=5).median().shift(1)
    want = want.where(~((pd.Series(dollars) > usual * 50) & (want.abs() > 0.02)))
    np.testing.assert_allclose(got, want)
    assert want.isna().sum() > 5 and (want != x).sum() > 6


def test_stages_together(spark):
    closes = {"a": [1.0 + 0.01 * i for i in range(12)], "b": [1.0] * 12}
    made = cleaning.cleaned(bars(spark, closes), cleaning.Limits(least_bars=5)).collect()
    assert {r.inst for r in made} == {"a"} and all(r.tradable for r in made)
    assert cleaning.cleaned(bars(spark, closes).limit(0)).count() == 0
