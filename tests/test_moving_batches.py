"""Moving quantiles in batches that cut series, and with infinities, against a walk of each series."""

import datetime as dt
import math

import numpy as np
import pytest

from pelagos.operators import order_stats as os_
from pelagos.plans import cleaning


@pytest.mark.parametrize("batch", [5, 10_000])
@pytest.mark.parametrize("span_rows", [None, 13])
@pytest.mark.parametrize("infinite", [False, True])
@pytest.mark.parametrize("window", [1, 6])
def test_batches_that_cut_series(spark, batch, span_rows, infinite, window):
    rng = np.random.default_rng(4)
    values = [1.0, 2.0, 3.0, 4.0, None] + [math.inf] * infinite
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), values[rng.integers(len(values))], float(rng.integers(9))) for k in range(6) for i in range((40, 1, 3, 26, 0, 14)[k])]
    frame = spark.createDataFrame(rows, "inst int, ts timestamp, v double, w double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = os_.rolling_quantiles(frame, {"a": "v", "b": "w", "c": "v"}, window, 0.5, 2 if window > 1 else 1, span_rows=span_rows).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len(rows)
    for _, own in found.groupby("inst"):
        own = own.sort_values("ts")
        for out, field in (("a", "v"), ("b", "w"), ("c", "v")):
            want = os_.moving_quantile(own[field].to_numpy(float), window, 0.5, 2 if window > 1 else 1)
            np.testing.assert_array_equal(own[out].to_numpy(float), want)


def test_caps_need_no_group_for_each_series(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 0.01 * d, 1000.0) for i in range(4) for d in range(8)]
    frame = spark.createDataFrame(rows, "inst int, ts timestamp, r double, dollars double")
    made = cleaning.capped_returns(frame, "r", "dollars", cleaning.Limits(window=4, least_window=2))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 0 and plan.count("MapInArrow") == 1
    assert plan.count("Exchange hashpartitioning") == 1  # series meet once


def test_all_stages_need_no_group_for_each_series(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=d), 2.0, 1.0, 1.5 + 0.01 * d, 5.0, 1000.0) for i in range(4) for d in range(8)]
    frame = spark.createDataFrame(rows, "inst int, ts timestamp, high double, low double, close double, volume double, dollars double")
    made = cleaning.cleaned(frame, cleaning.Limits(least_bars=4, window=4, least_window=2))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 0 and plan.count("MapInArrow") == 1
    assert made.where("tradable").count() == len(rows)
