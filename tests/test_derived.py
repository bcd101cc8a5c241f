"""Derived fields, lagged regressions and sides simulated by themselves, on small frames."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pelagos.functions import timeseries as ts
from pelagos.functions.cross_section import rank
from pelagos.plans import backtest as bt
from pelagos.plans import evaluation as ev
from pelagos.sources import derived

BARS = "ts timestamp, inst string, open double, high double, low double, close double, volume double, dollars double, trades long, taker_volume double"


def day(t):
    return dt.datetime(2024, 1, 1) + dt.timedelta(int(t))


def bars(spark, closes):
    rows = [(day(t), "a", c, None if c is None else c + 1, None if c is None else c - 1, c, 10.0 * (t % 4), 100.0 * t, t, 5.0) for t, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def test_derived_fields(spark):
    closes = [10.0, 11.0, None, 12.0, 12.0, 15.0, 14.0, 13.0]
    made = derived.derived_fields(bars(spark, closes), 252, (4,), (4,), (4,), (2,), 4).orderBy("ts").toPandas()
    x = pd.Series(closes)
    r = x / x.shift(1) - 1
    np.testing.assert_allclose(made["returns"].astype(float), r)
    np.testing.assert_allclose(made["momentum_2"].astype(float), x / x.shift(2) - 1)
    np.testing.assert_allclose(made["volatility_4"].astype(float), r.rolling(4, min_periods=2).std() * math.sqrt(252))
    dollars = pd.Series([100.0 * t for t in range(8)])
    np.testing.assert_allclose(made["adv_4"].astype(float), dollars.rolling(4, min_periods=2).mean())
    assert made["vwap"].isna().tolist() == [True, False, False, False] * 2  # volume zero
    assert made["trades_per_volume"][1] == 0.1 and made["taker_buy_ratio"][1] == 0.5
    assert made["upper_shadow"][0] == 0.5 and made["high_low_range"][0] == 0.2
    assert derived.derived_fields(bars(spark, closes).limit(0)).count() == 0


def test_basis(spark):
    rows = [(day(t), "a", f, s) for t, (f, s) in enumerate([(1.1, 1.0), (1.2, 1.0), (1.0, 0.0), (1.3, 1.0), (None, 1.0)])]
    made = derived.basis(spark.createDataFrame(rows, "ts timestamp, inst string, f double, s double"), "f", "s", 4).orderBy("ts").collect()
    assert [None if r.basis is None else round(r.basis, 9) for r in made] == [0.1, 0.2, None, 0.3, None]
    assert made[0].basis_z is None and made[3].basis_z == pytest.approx(1.0)


@pytest.mark.parametrize("lag", [0, 2])
def test_lagged_regression(spark, lag):
    rng = np.random.default_rng(lag)
    y, x = rng.normal(size=30), rng.normal(size=30)
    x[7] = np.nan
    frame = spark.createDataFrame([(day(t), "a", float(y[t]), None if np.isnan(x[t]) else float(x[t])) for t in range(30)], "ts timestamp, inst string, y double, x double")
    got = {k: ts.with_lagged_regression(frame, "y", "x", 8, lag, k, k).orderBy("ts").toPandas()[k].astype(float) for k in ("slope", "intercept", "fitted", "residual")}
    z = np.concatenate([np.full(lag, np.nan), x[: 30 - lag]])
    for i in range(30):
        own = slice(i - 8, i)
        ok = ~np.isnan(z[own]) if i >= 8 else np.zeros(0, bool)
        if ok.sum() < 3:
            assert np.isnan(got["slope"][i])
            continue
        b, a = np.polyfit(z[own][ok], y[own][ok], 1)
        np.testing.assert_allclose([got["slope"][i], got["intercept"][i], got["fitted"][i]], [b, a, a + b * z[i]], atol=1e-9)


def test_sides_are_those_of_separate_runs(spark):
    rng = np.random.default_rng(2)
    rows = [(day(t), f"i{i}", g, *(float(v) for v in rng.uniform(9, 11, 2))) for t in range(40) for i, g in enumerate("xxyyy")]
    panel = spark.createDataFrame(rows, "ts timestamp, inst string, sector string, open double, close double").cache()
    add = lambda p: p.withColumn("signal", rank(-ts.delta(F.col("close"), 1)))
    rules = bt.Rules(max_weight=0.3, decay=2, neutralization="sector", fees_bps=5.0)
    sides = ev.walk_forward(ev.times_of(panel), 12, 6, 3)
    made = ev.simulate_apart(panel, add, "signal", rules, sides, ("fold", "sample")).toPandas()
    assert len(made) == 3 * 18
    for fold, sample in ((1, "in"), (2, "out"), (3, "in")):
        own = sides.where((F.col("fold") == fold) & (F.col("sample") == sample)).select("ts")
        alone = bt.simulate(add(panel.join(own, "ts")), "signal", rules).orderBy("ts").toPandas()
        got = made[(made["fold"] == fold) & (made["sample"] == sample)].sort_values("ts")
        for c in ("gross", "turnover", "pnl"):
            np.testing.assert_allclose(got[c], alone[c], atol=1e-9)
        assert got["pnl"].iloc[0] == 0  # nothing is held at first
    assert ev.simulate_apart(panel.limit(0), add, "signal", rules, sides, ("fold", "sample")).count() == 0
