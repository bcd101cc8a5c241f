"""Named expressions: windows as long as the series run from its beginning, and each aggregate is made once."""

import datetime as dt
import re

import numpy as np

from pelagos.plans import signal_queries as sq


def test_whole_windows_are_the_moving_ones(spark):
    rng = np.random.default_rng(5)
    rows = []
    for inst in range(3):
        for i in range(50):
            o, c = rng.uniform(5, 9, 2)
            known = rng.random() > 0.15
            rows.append((inst, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), *(float(v) if known else None for v in (o, max(o, c) + 1, min(o, c) - 1, c, rng.integers(1, 9)))))
    panel = spark.createDataFrame(rows, "inst int, ts timestamp, open double, high double, low double, close double, volume double")
    moving, whole = sq.named_expressions(panel), sq.named_expressions(panel, 50)
    assert moving.columns == whole.columns == [*panel.columns, "r", *sq.NAMED]
    a, b = (df.orderBy("inst", "ts").toPandas().drop(columns="ts").astype(float).to_numpy() for df in (moving, whole))
    np.testing.assert_allclose(b, a, rtol=1e-9, atol=1e-12)

    spark.conf.set("spark.sql.debug.maxToStringFields", 9999)
    try:
        plan = sq.named_expressions(panel, 50)._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    frames = {int(n) + 1 for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow", plan)}
    assert frames and max(frames) < 50  # longer ones are kept up from row to row
    assert plan.count("windowspecdefinition") < 100  # 136 with an aggregate for each use
