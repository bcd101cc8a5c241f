"""Exact quantiles of moving and growing windows, at a cost near-linear in the rows.

Moving windows run over batches of many series at once, one exchange of a value per row; the last window of a batch is
carried into the next, so a task holds a batch and a window.  Series may be cut into spans of rows that overlap by a
window, so a long one is many tasks.  A growing window keeps its values in two heaps that meet at the quantile; it walks
a series from its beginning in one group.

Quantiles lie between neighbours in proportion, missing values are no values, and a row with fewer than ``least`` of
them in its window has none.  Rows of equal time follow each other by ``ties`` if any are named.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a span beyond its window.
SPAN_ROWS = 1 << 16


def _between(low: float, high: float, share: float) -> float:
    return low if share == 0 else low + (high - low) * share


def moving_quantile(x: np.ndarray, window: int, q: float, least: int = 1) -> np.ndarray:
    """Quantile of the last ``window`` rows at every row; NaN is missing."""
    ordered: list[float] = []
    made = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        if i >= window and not math.isnan(gone := x[i - window]):
            del ordered[bisect_left(ordered, gone)]
        if not math.isnan(v):
            insort(ordered, v)
        if len(ordered) >= max(least, 1):
            at = q * (len(ordered) - 1)
            k = int(at)
            made[i] = _between(ordered[k], ordered[min(k + 1, len(ordered) - 1)], at - k)
    return made


def growing_quantile(x: np.ndarray, q: float, least: int = 1) -> np.ndarray:
    """Quantile of all rows so far at every row; NaN is missing."""
    low: list[float] = []  # negated: the values up to the quantile, the greatest first
    high: list[float] = []
    made = np.full(len(x), np.nan)
    for i, v in enumerate(x):
        if not math.isnan(v):
            if low and v < -low[0]:
                heapq.heappush(low, -v)
            else:
                heapq.heappush(high, v)
        n = len(low) + len(high)
        if not n:
            continue
        at = q * (n - 1)
        k = int(at) + 1  # values that belong below
        while len(low) < k:
            heapq.heappush(low, -heapq.heappop(high))
        while len(low) > k:
            heapq.heappush(high, -heapq.heappop(low))
        while high and -low[0] > high[0]:
            heapq.heappush(low, -heapq.heapreplace(high, -heapq.heappop(low)))
        if n >= least:
            made[i] = _between(-low[0], high[0] if high else -low[0], at - (k - 1))
    return made


def _order(ties: Sequence[str]) -> list[str]:
    return ["ts", *ties]


def _filled(pdf: pd.DataFrame, out: str, made: np.ndarray, columns: list[str]) -> pd.DataFrame:
    return pdf.assign(**{out: pd.Series(made, pdf.index).astype(object).where(~np.isnan(made), None)})[[*columns, out]]


class _Bounds(BaseIndexer):
    """Windows that begin at given rows and end with the row itself."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.begin, np.arange(1, num_values + 1, dtype=np.int64)


def moving_quantiles(x: np.ndarray, begin: np.ndarray, window: int, q: float, least: int = 1) -> np.ndarray:
    """Quantile of the rows from ``begin`` to each row, where ``begin`` is the window's first row or the series'."""
    if not np.isinf(x).any():
        return pd.Series(x).rolling(_Bounds(begin=begin), min_periods=max(least, 1)).quantile(q).to_numpy()
    # pandas takes infinities for missing values
    starts = np.flatnonzero(begin == np.arange(len(x)))
    return np.concatenate([moving_quantile(own, window, q, least) for own in np.split(x, starts[1:] if window > 1 else np.arange(1, len(x)))])


def rolling_quantile(
    panel: DataFrame, field: str, window: int, q: float = 0.5, least: int = 1, keys: Sequence[str] = ("inst",), out: str = "quantile",
    ties: Sequence[str] = (), span_rows: int | None = SPAN_ROWS,
) -> DataFrame:
    """``panel`` with the quantile of ``field`` over the last ``window`` rows of each key."""
    return rolling_quantiles(panel, {out: field}, window, q, least, keys, ties, span_rows)


def rolling_quantiles(
    panel: DataFrame, fields: Mapping[str, str], window: int, q: float = 0.5, least: int = 1, keys: Sequence[str] = ("inst",),
    ties: Sequence[str] = (), span_rows: int | None = SPAN_ROWS,
) -> DataFrame:
    """``panel`` with a quantile under each name of ``fields``, of the field named there, in one pass.

    Without ``span_rows`` each series stays where the windows along it are, in one task and without another shuffle.
    """
    line = Window.partitionBy(*keys).orderBy(*_order(ties))
    dealt = panel.withColumn("_at", F.row_number().over(line) - 1)
    if span_rows is None:
        # the window has brought each key into one task; its order is stated again and costs nothing where it still holds
        dealt = dealt.withColumn("_span", F.lit(0).cast("long")).sortWithinPartitions(*keys, *_order(ties), "_at")
    else:
        first = F.floor(F.col("_at") / span_rows)
        last = F.floor((F.col("_at") + window - 1) / span_rows)
        end = F.floor((F.count("*").over(Window.partitionBy(*keys)) - 1) / span_rows)
        dealt = dealt.withColumn("_end", end).withColumn("_span", F.explode(F.sequence(first, F.least(last, F.col("_end"))))).drop("_end")
        dealt = dealt.repartition(*keys, "_span").sortWithinPartitions(*keys, "_span", "_at")
    columns, rows = panel.columns, span_rows or 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {out: np.empty(0) for out in fields}  # rows of the last series that later windows may hold
        for batch in batches:
            at, span = batch["_at"].to_numpy(zero_copy_only=False).astype(np.int64), batch["_span"].to_numpy(zero_copy_only=False).astype(np.int64)
            n, before = len(at), len(next(iter(kept.values())))
            if not n:
                continue
            new = at == np.maximum(span * rows - (window - 1), 0)  # first row of a series or span
            place = np.arange(before + n, dtype=np.int64)
            series = np.maximum.accumulate(np.where(np.concatenate([np.zeros(before, bool), new]), place, 0))
            begin = np.maximum(place - (window - 1), series)
            made = []
            for out, field in fields.items():
                x = np.concatenate([kept[out], batch[field].to_numpy(zero_copy_only=False).astype(float)])
                values = moving_quantiles(x, begin, window, q, least)[before:]
                made.append(pa.array(values, pa.float64(), mask=np.isnan(values)))
                kept[out] = x[max(series[-1], len(x) - (window - 1)) :] if window > 1 else x[:0]
            done = pa.RecordBatch.from_arrays([*(batch[c] for c in columns), *made], names=[*columns, *fields])
            yield done if span_rows is None else done.filter(pa.array(at // rows == span))

    schema = T.StructType([*panel.schema.fields, *(T.StructField(out, T.DoubleType()) for out in fields)])
    return dealt.mapInArrow(run, schema)


def expanding_quantile(
    panel: DataFrame, field: str, q: float = 0.5, least: int = 1, keys: Sequence[str] = ("inst",), out: str = "quantile", ties: Sequence[str] = ()
) -> DataFrame:
    """``panel`` with the quantile of ``field`` over all rows of each key so far."""
    columns = panel.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(_order(ties), kind="stable")
        return _filled(pdf, out, growing_quantile(pdf[field].to_numpy(float), q, least), columns)

    schema = T.StructType([*panel.schema.fields, T.StructField(out, T.DoubleType())])
    return panel.groupBy(*keys).applyInPandas(run, schema)
