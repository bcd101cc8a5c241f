"""Least squares along a moving window with an inverse that follows it.

The inverse of a window's products takes up the row that enters and gives off the row that leaves in one correction of
rank two, at the cost of the square of the number of regressors a row; a fresh solution costs the window's length times
that.  Rounding is kept in check by a fresh inverse every ``REFRESH`` rows, and whenever a correction is not safe.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.scratch import written

REFRESH = 512
#: Rows of a span beyond its window.
SPAN_ROWS = 4096


class MovingInverse:
    """Inverse of the sum of outer products of a window's rows, plus ``ridge`` on the diagonal; None while singular."""

    def __init__(self, ridge: float):
        self.ridge, self.inverse, self.age = ridge, None, 0

    def fresh(self, rows: np.ndarray) -> None:
        total = rows.T @ rows + self.ridge * np.eye(rows.shape[1])
        self.inverse, self.age = None, 0
        values, vectors = np.linalg.eigh(total)
        if values[0] > 1e-13 * values[-1]:
            self.inverse = (vectors / values) @ vectors.T

    def move(self, rows: np.ndarray, gone: np.ndarray) -> None:
        """``rows`` is the window with the row that has entered last; ``gone`` has left it."""
        self.age += 1
        if self.inverse is None or self.age >= REFRESH:
            return self.fresh(rows)
        both = np.stack([rows[-1], gone])
        part = self.inverse @ both.T
        small = np.diag([1.0, -1.0]) + both @ part
        if abs(np.linalg.det(small)) < 1e-6:
            return self.fresh(rows)
        self.inverse = self.inverse - part @ np.linalg.solve(small, part.T)
        return None


def residual_walk(r: np.ndarray, e: np.ndarray, window: int, ridge: float) -> np.ndarray:
    """Weights at every row from ``window`` - 1 on, NaN before: what the window's returns leave of the last expectations.

    Expectations over deviations are regressed on all centred returns over deviations; the last row's residuals, over
    deviations again, are the weights, scaled to a sum of one.
    """
    n, k = r.shape
    made = np.full((n, k), np.nan)
    moving = MovingInverse(ridge)
    for i in range(window - 1, n):
        own = slice(i - window + 1, i + 1)
        if i == window - 1 or moving.age + 1 >= REFRESH:
            moving.fresh(r[own])  # and the sums with it
            total, wanted, mixed, squares = r[own].sum(0), e[own].sum(0), r[own].T @ e[own], (r[own] ** 2).sum(0)
        else:
            old, gone = r[i - window], e[i - window]
            moving.move(r[own], old)
            total = total + r[i] - old
            wanted = wanted + e[i] - gone
            mixed = mixed + np.outer(r[i], e[i]) - np.outer(old, gone)
            squares = squares + r[i] ** 2 - old**2
        mean = total / window
        spread = np.sqrt(np.maximum(squares - window * mean**2, 0) / (window - 1))
        if moving.inverse is None or not (spread > 1e-12).all():
            continue
        # the centred products are those of the rows less a product of the mean with itself
        x = r[i] - mean
        a, b = moving.inverse @ x, moving.inverse @ mean
        bend = 1 - window * (mean @ b)
        if bend <= 1e-12:
            continue
        z = a + b * (window * (mean @ a) / bend)
        told = z @ (mixed - np.outer(mean, wanted)) / spread
        raw = (told - e[i] / spread) / spread
        if abs(raw.sum()) > 1e-12 * np.abs(raw).sum():
            made[i] = raw / raw.sum()
    return made


def residual_weights(returns: DataFrame, window: int, ridge: float = 0.0, keys: Sequence[str] = (), span_rows: int = SPAN_ROWS) -> DataFrame:
    """keys, ts, alpha and w: combination weights from the residuals of expectations, refitted at every time.

    ``returns`` has keys, alpha, ts, r and e, the return and the expectation known at the time; missing ones are zero.
    A window that has an alpha without variance, or weights without a sum, has no rows.  A key's times are cut into spans
    that are walked in parallel, each from a full window on.
    """
    times = returns.select(*keys, "ts").distinct().withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1)
    times = written(times, "times")
    rows = returns.join(times, [*keys, "ts"])
    rows = rows.join(times.groupBy(*keys).agg(F.count("*").alias("n")), list(keys)) if keys else rows.withColumn("n", F.lit(times.count()))
    last = F.least(F.floor((F.col("t") + window - 1) / span_rows), F.floor((F.col("n") - 1) / span_rows))
    spans = F.explode(F.sequence(F.floor(F.col("t") / span_rows), last))
    dealt = rows.select(*keys, "n", "t", "alpha", F.col("r").cast("double").alias("r"), F.col("e").cast("double").alias("e"), spans.alias("span"))

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        span, n = int(pdf["span"].iloc[0]), int(pdf["n"].iloc[0])
        begin = max(0, span * span_rows - window + 1)
        end = min((span + 1) * span_rows, n)
        names = sorted(pdf["alpha"].unique())
        place = {a: i for i, a in enumerate(names)}
        r, e = np.zeros((end - begin, len(names))), np.zeros((end - begin, len(names)))
        at = pdf["t"].to_numpy(int) - begin, pdf["alpha"].map(place).to_numpy(int)
        r[at], e[at] = np.nan_to_num(pdf["r"].to_numpy(float)), np.nan_to_num(pdf["e"].to_numpy(float))
        w = residual_walk(r, e, window, ridge)
        made = [(begin + i, a, float(w[i, j])) for i in range(span * span_rows - begin, end - begin) for j, a in enumerate(names) if not np.isnan(w[i, j])]
        return pd.DataFrame(made, columns=["t", "alpha", "w"]).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "t", "alpha", "w"]]

    kinds = "".join(f"{k} {returns.schema[k].dataType.simpleString()}, " for k in keys)
    found = dealt.groupBy(*keys, "span").applyInPandas(walked, f"{kinds}t int, alpha {returns.schema['alpha'].dataType.simpleString()}, w double")
    return found.join(times, [*keys, "t"]).select(*keys, "ts", "alpha", "w")
