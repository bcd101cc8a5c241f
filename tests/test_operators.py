"""Operators on small literal panels against pandas or hand-made results."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pelagos.functions import cross_section as xs
from pelagos.functions import elementwise as ew
from pelagos.functions import timeseries as ts
from pelagos.operators import aggregates, joins, portfolio, sequential
from pelagos.plans import backtest, catalog, quality, universe
from pelagos.sources import panel as src

DAYS = [dt.datetime(2023, 1, 2) + dt.timedelta(days=i) for i in range(40)]


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(5)
    made = pd.DataFrame(100 + rng.normal(size=(40, 5)).cumsum(0), index=DAYS, columns=list("ABCDE")).round(2)
    return made.mask(rng.random(made.shape) < 0.1)


@pytest.fixture(scope="module")
def panel(spark, wide):
    long = wide.reset_index(names="ts").melt("ts", var_name="inst", value_name="x")
    rows = [(r.ts.to_pydatetime(), r.inst, None if math.isnan(r.x) else r.x, {"A": "t", "B": "t", "C": "f"}.get(r.inst)) for r in long.itertuples()]
    return spark.createDataFrame(rows, "ts timestamp, inst string, x double, sector string").cache()


def back(df, column="v"):
    got = df.select("ts", "inst", F.col(column).cast("double").alias(column)).toPandas()
    return got.pivot(index="ts", columns="inst", values=column).astype(float)


def same(got, want):
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-8, atol=1e-9, equal_nan=True)


def x():
    return F.col("x")


@pytest.mark.parametrize(
    ("column", "frame"),
    [
        (lambda: ts.ts_sum(x(), 5), lambda d: d.rolling(5, min_periods=1).sum()),
        (lambda: ts.stddev(x(), 6), lambda d: d.rolling(6, min_periods=2).std()),
        (lambda: ts.skewness(x(), 8), lambda d: d.rolling(8, min_periods=3).skew()),
        (lambda: ts.kurtosis(x(), 8), lambda d: d.rolling(8, min_periods=4).kurt()),
        (lambda: ts.ts_rank(x(), 7), lambda d: d.rolling(7, min_periods=1).rank(pct=True)),
        (lambda: ts.delta(x(), 2), lambda d: d - d.shift(2)),
        (lambda: ts.backfill(x(), 3), lambda d: d.ffill(limit=3)),
        (lambda: ts.ts_zscore(x(), 6), lambda d: (d - d.shift(1).rolling(6, min_periods=2).mean()) / d.shift(1).rolling(6, min_periods=2).std(ddof=0)),
        (lambda: xs.rank(x()), lambda d: d.rank(axis=1, pct=True)),
        (lambda: xs.zscore(x()), lambda d: d.sub(d.mean(axis=1), axis=0).div(d.std(axis=1), axis=0)),
        (lambda: xs.scale(x()), lambda d: d.div(d.abs().sum(axis=1), axis=0)),
        (lambda: xs.winsorize(x(), 0.2, 0.8), lambda d: d.clip(d.quantile(0.2, axis=1), d.quantile(0.8, axis=1), axis=0)),
    ],
)
def test_against_pandas(panel, wide, column, frame):
    same(back(panel.withColumn("v", column())), frame(wide))


def test_decay_linear(panel, wide):
    want = wide.rolling(4, min_periods=1).apply(lambda a: (a * np.arange(1, len(a) + 1)).sum() / np.arange(1, len(a) + 1).sum(), raw=True)
    full = wide.isna().rolling(4, min_periods=1).sum() == 0
    same(back(panel.withColumn("v", ts.decay_linear(x(), 4))), want.where(full))


def test_groups_pass_through(panel, wide):
    got = back(panel.withColumn("v", xs.group_neutralize(x(), "sector")))
    pair = wide[["A", "B"]]
    want = wide.copy()
    want[["A", "B"]] = pair.sub(pair.mean(axis=1), axis=0)
    want["C"] = wide["C"] - wide["C"]
    same(got, want)
    same(back(panel.withColumn("v", xs.group_rank(x(), "sector")))[["C", "D"]], wide[["C", "D"]])


def test_ewm(panel, wide):
    same(back(sequential.ewm_mean(panel, "x", 0.3), "ewm"), wide.ewm(alpha=0.3, adjust=True, ignore_na=False).mean())


def test_division_kinds(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 2.0), (3.0, 2.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    rows = df.select(ew.divide(a, b), ew.over(a, b), ew.protected_div(a, b)).collect()
    assert [tuple(r) for r in rows] == [(math.inf, None, 0.0), (-math.inf, None, 0.0), (None, None, 0.0), (None, None, None), (1.5, 1.5, 1.5)]


def test_missing_is_true(spark):
    df = spark.createDataFrame([(None,), (0.0,), (2.0,)], "a double")
    rows = df.select(ew.if_else(F.col("a"), 1, 2), ew.compare(F.col("a"), "!=", 0), ew.compare(F.col("a"), "<", 1)).collect()
    assert [tuple(r) for r in rows] == [(1.0, 1.0, 0.0), (2.0, 0.0, 1.0), (1.0, 1.0, 0.0)]


def test_lookahead_is_refused():
    with pytest.raises(ValueError, match="ahead"):
        ts.delay(None, -1)


def test_asof(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 1.0), ("a", 5, None), ("b", 9, 4.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in joins.asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): None, ("b", 3): None}
    right = spark.createDataFrame([("a", 2, 1.0), ("b", 3, 4.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in joins.asof_backward(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): 1.0, ("b", 3): 4.0}


def test_interval_and_validity(spark):
    changes = joins.validity(spark.createDataFrame([("a", 1, "x"), ("a", 4, "y")], "k string, since int, v string"), ["k"], "since")
    rows = spark.createDataFrame([("a", 0), ("a", 3), ("a", 4)], "k string, t int")
    assert {(r.t, r.v) for r in joins.interval_join(rows, changes, ["k"], "t", "since", "until").collect()} == {(3, "x"), (4, "y")}


def test_wide_round_trip(spark, panel, wide):
    matrix = src.to_wide(panel.select("ts", "inst", "x"), "x", list("ABCDE"))
    again = src.from_wide(matrix, "x")
    assert again.count() == int(wide.notna().sum().sum())


def test_densify_and_upsert(spark):
    facts = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "ts int, inst string, x double")
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "inst string")
    timed = facts.withColumn("ts", F.timestamp_seconds(F.col("ts") * 86400))
    assert src.densify(timed, names, "1 day").count() == 6
    assert src.densify(timed.where("x > 5"), names, "1 day").count() == 0
    fresh = spark.createDataFrame([(2, "b", 9.0)], "ts int, inst string, x double")
    assert {(r.ts, r.x) for r in src.upsert(facts, fresh, ["ts", "inst"]).collect()} == {(1, 1.0), (2, 9.0)}


def test_dead_band_and_thresholds(spark):
    rows = [(i, "a", v) for i, v in enumerate([0.1, 0.6, 0.5, None, -0.2, 0.9])]
    df = spark.createDataFrame(rows, "ts int, inst string, s double")
    assert [r.held for r in sequential.dead_band(df, "s", 0.3).orderBy("ts").collect()] == [0.0, 0.6, 0.6, 0.6, -0.2, 0.9]
    assert [r.side for r in sequential.threshold_positions(df, "s", 0.55, 0.0).orderBy("ts").collect()] == [0.0, 1.0, 1.0, 1.0, 0.0, 1.0]


def test_universe_holds_between_rebalances(spark):
    rows = [(i, n, float(v)) for i in range(8) for n, v in (("a", 3), ("b", 2 + i), ("c", 1))]
    df = spark.createDataFrame(rows, "ts int, inst string, dollars double")
    got = universe.top_n(df, 1, window=2, least=1, every=4).where("member").orderBy("ts").collect()
    assert [(r.ts, r.inst) for r in got] == [(0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (6, "b"), (7, "b")]


def test_quality_rules(spark):
    rows = [(i, "a", v) for i, v in enumerate([1.0, 1.0, None, 9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "ts int, inst string, close double")
    assert [r.run for r in quality.stale_runs(df).orderBy("ts").collect()] == [1, 2, None, 1, 2, 3]
    assert [(r.ts, r.jump) for r in quality.resumption_jumps(df).collect()] == [(3, 8.0)]


def test_portfolio_solvers():
    cov = np.array([[0.04, 0.0], [0.0, 0.01]])
    np.testing.assert_allclose(portfolio.min_variance(cov), [0.2, 0.8], rtol=1e-3)
    np.testing.assert_allclose(portfolio.risk_parity(cov), [1 / 3, 2 / 3], rtol=1e-6)
    np.testing.assert_allclose(portfolio.project_simplex(np.array([0.9, 0.5])), [0.7, 0.3])
    w = portfolio.mean_variance(np.array([0.1, 0.1]), cov, 10.0)
    np.testing.assert_allclose(w, [0.2, 0.8], atol=0.02)
    assert portfolio.select_orthogonal({"a": 3, "b": 2, "c": 1}, {("a", "b"): 0.9, ("a", "c"): 0.1}, 0.5, 2) == ["a", "c"]
    assert portfolio.probabilistic_sharpe(0.1, 10) == 0.5
    assert 0.97 < portfolio.probabilistic_sharpe(0.2, 100) < 0.99


def test_catalog_correlation(spark):
    stored = spark.createDataFrame([(1, [float(i) for i in range(30)]), (2, [1.0] * 30), (3, [1.0])], "id int, pnl array<double>")
    got = catalog.pnl_correlation(stored, [float(-i) for i in range(25)]).collect()
    assert [(r.id, round(r["corr"], 9)) for r in got] == [(1, -1.0)]


def test_bootstrap_is_repeatable(spark):
    values = np.sin(np.arange(50.0))
    a, b = (aggregates.block_bootstrap(values, spark, 20).orderBy("id").collect() for _ in "ab")
    assert a == b and len(a) == 20


def test_empty_panel(spark):
    empty = spark.createDataFrame([], "ts timestamp, inst string, open double, close double, s double, sector string")
    rules = backtest.Rules(neutralization="sector")
    assert backtest.simulate(empty, "s", rules).count() == 0
    assert backtest.metrics(backtest.simulate(empty, "s", rules), rules, ("ts",)).count() == 0


def test_newey_west_of_an_empty_series(spark):
    empty = spark.createDataFrame([], "ts timestamp, slope double")
    assert aggregates.newey_west(empty).collect() == [(None, None, None, 0)]


def test_aggregates_of_an_empty_panel(spark):
    empty = spark.createDataFrame([], "ts timestamp, inst string, s double, ret double, open double, high double, low double, close double, volume double")
    assert aggregates.spearman_ic(empty, "s", "ret").count() == 0
    assert aggregates.batch_ic(empty, ["s"], "ret").count() == 0
    assert aggregates.quantile_spread(empty, "s", "ret").count() == 0
    assert aggregates.section_regression(empty, "ret", "s").count() == 0
    assert {r.n for r in quality.cross_checks(empty).collect()} == {0}


def test_change_runs_and_moments(spark):
    values = [1.0, 1.0, None, 2.0, 2.0, 2.0, 3.0]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(values)], "ts int, inst string, x double")
    made = ts.with_days_from_last_change(ts.with_change_run(df, "x"), "x").orderBy("ts").collect()
    assert [r.run for r in made] == [1, 1, 2, 3, 3, 3, 4]
    assert [r.days for r in made] == [0, 1, 0, 0, 1, 2, 0]
    moment = [r.moment for r in ts.with_moment(df, "x", 3).orderBy("ts").collect()]
    wide = pd.Series(values)
    gap = wide - wide.rolling(3, min_periods=2).mean()
    want = (gap**2).rolling(3, min_periods=2).mean()
    assert [m is None for m in moment] == want.isna().tolist()
    np.testing.assert_allclose([m for m in moment if m is not None], want.dropna())


def test_tiered_costs(spark):
    row = spark.createDataFrame([(100.0, 50.0, 0.0), (10.0, 1.0, 0.0), (1000.0, 20.0, 4e8), (0.0, 5.0, 0.0)], "n double, p double, m double")
    got = [r.c for r in row.select(backtest.tiered_commission(F.col("n"), F.col("p"), F.col("m")).alias("c")).collect()]
    np.testing.assert_allclose(got, [0.35, 0.35, 0.5, 0.0])
    fees = [r.c for r in row.select(backtest.regulatory_fees(F.col("n"), F.col("p"), F.lit(True)).alias("c")).collect()]
    np.testing.assert_allclose(fees, [0.03 + 5000 * 2.78e-5 + 0.0145, 0.003 + 10 * 2.78e-5 + 0.00145, 0.3 + 2e4 * 2.78e-5 + 0.145, 0.0])


def test_long_only_weights_by_a_plain_loop():
    """Minimum variance and risk parity against a search over a fine grid of weights."""
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    grid = np.linspace(0, 1, 20001)
    weights = np.stack([grid, 1 - grid], 1)
    variance = np.einsum("ni,ij,nj->n", weights, cov, weights)
    np.testing.assert_allclose(portfolio.min_variance(cov), weights[variance.argmin()], atol=1e-3)
    shares = weights * (weights @ cov)
    np.testing.assert_allclose(portfolio.risk_parity(cov), weights[np.abs(shares[:, 0] - shares[:, 1]).argmin()], atol=1e-3)
