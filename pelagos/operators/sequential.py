"""Recursions that windows cannot express: one pandas group per key, walked in time order.

A group is one instrument's (or one configuration's) series, whose length is the calendar's, so it stays small however
many instruments there are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _extended(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])


def ewm_mean(panel: DataFrame, field: str, alpha: float, out: str = "ewm", keys: tuple[str, ...] = ("inst",)) -> DataFrame:
    """Exponentially weighted mean with full normalisation; ages count rows, missing rows included.

    The last mean carries over missing rows; it is missing until the first value.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        made = pdf[field].astype(float).ewm(alpha=alpha, adjust=True, ignore_na=False).mean()
        return pdf.assign(**{out: made.astype(object).where(made.notna(), None)})

    return panel.groupBy(*keys).applyInPandas(run, _extended(panel, out))


def decay_exp(panel: DataFrame, field: str, a: float = 0.99, out: str = "decayed") -> DataFrame:
    """``ewm_mean`` with the given smoothing; one beyond 1 in size counts as 0.99."""
    return ewm_mean(panel, field, 0.99 if abs(a) > 1 else a, out)


def dead_band(panel: DataFrame, target: str, band: float, out: str = "held") -> DataFrame:
    """Holds the last position until the target is more than ``band`` away from it; missing targets hold."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        held, made = 0.0, []
        for x in pdf[target].astype(float):
            if not math.isnan(x) and abs(x - held) > band:
                held = x
            made.append(held)
        return pdf.assign(**{out: made})

    return panel.groupBy("inst").applyInPandas(run, _extended(panel, out))


def threshold_positions(
    panel: DataFrame, signal: str, enter: float, leave: float, min_hold: int = 1, out: str = "side", keys: tuple[str, ...] = ("inst",)
) -> DataFrame:
    """-1, 0 or 1: entered beyond ``enter``, left inside ``leave`` once held for ``min_hold`` rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        side, age, made = 0.0, 0, []
        for x in pdf[signal].astype(float):
            age += 1
            if side and age > min_hold and not math.isnan(x) and side * x < leave:
                side = 0.0
            if not side and not math.isnan(x) and abs(x) > enter:
                side, age = math.copysign(1.0, x), 0
            made.append(side)
        return pdf.assign(**{out: made})

    return panel.groupBy(*keys).applyInPandas(run, _extended(panel, out))


def rolling_ridge(panel: DataFrame, y: str, xs: list[str], window: int, penalty: float, out: str = "predicted") -> DataFrame:
    """Prediction of ``y`` at each row by a ridge regression over the ``window`` rows before it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        x, t = pdf[xs].to_numpy(float), pdf[y].to_numpy(float)
        made = [None] * len(pdf)
        for i in range(window, len(pdf)):
            a, b = x[i - window : i], t[i - window : i]
            ok = ~np.isnan(a).any(1) & ~np.isnan(b)
            if ok.sum() > len(xs) and not np.isnan(x[i]).any():
                a, b = a[ok], b[ok]
                w = np.linalg.solve(a.T @ a + penalty * np.eye(len(xs)), a.T @ b)
                made[i] = float(x[i] @ w)
        return pdf.assign(**{out: made})

    return panel.groupBy("inst").applyInPandas(run, _extended(panel, out))


def risk_residuals(panel: DataFrame, signal: str, factors: list[str], least: int = 10, out: str = "residual") -> DataFrame:
    """Per time, the residual of the signal after least squares on the factors; unchanged below ``least`` rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.column_stack([np.ones(len(pdf)), pdf[factors].to_numpy(float)])
        b = pdf[signal].to_numpy(float)
        ok = ~np.isnan(a).any(1) & ~np.isnan(b)
        made = b.copy()
        if ok.sum() >= least:
            w, *_ = np.linalg.lstsq(a[ok], b[ok], rcond=None)
            made[ok] = b[ok] - a[ok] @ w
        return pdf.assign(**{out: [None if math.isnan(v) else v for v in made]})

    return panel.groupBy("ts").applyInPandas(run, _extended(panel, out))
