"""Cleaning of bars in stages: instruments that are left out, bars that are emptied, returns that are capped.

``panel`` is dense: inst, ts, open, high, low, close, volume and dollars, missing where there was no bar.  Caps at a bar
are made from the bars before it alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import timeseries as ts
from pelagos.functions.elementwise import clip, over
from pelagos.operators.order_stats import rolling_quantiles


@dataclass(frozen=True)
class Limits:
    """Fixed values of five-minute bars; pass others for other bars."""

    least_bars: int = 100
    most_missing: float = 0.3
    most_stale: float = 0.2
    most_still: float = 0.4
    least_dollars: float = 500.0
    stale_run: int = 6
    empty_run: int = 6
    most_jump: float = 0.5
    most_return: float = 0.15
    cap_multiple: float = 5.0
    least_cap: float = 0.02
    window: int = 288
    least_window: int = 50
    spike_multiple: float = 50.0
    spike_return: float = 0.02


def excluded_instruments(panel: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """inst and reason of the instruments to leave out; of several reasons the first in this order.

    few_bars, missing, stale (share of bars with an unchanged price), not_positive, constant, illiquid (median dollars)
    and coarse (share of unchanged prices, for limits below the stale one).
    """
    still = (F.col("close") == F.lag("close").over(ts.series())).cast("int")
    made = panel.select("inst", "ts", "close", "dollars", F.coalesce(still, F.lit(0)).alias("still"))
    stats = made.groupBy("inst").agg(
        F.count("close").alias("bars"), F.avg(F.col("close").isNull().cast("double")).alias("missing"), F.avg("still").alias("still"),
        F.coalesce(F.max(F.col("close") <= 0), F.lit(False)).alias("low"), F.stddev_samp("close").alias("spread"), F.median("dollars").alias("dollars"),
    )
    reasons = {
        "few_bars": F.col("bars") < limits.least_bars, "missing": F.col("missing") > limits.most_missing, "stale": F.col("still") > limits.most_stale,
        "not_positive": F.col("low"), "constant": F.col("spread") < 1e-10, "illiquid": F.col("dollars") < limits.least_dollars,
        "coarse": F.col("still") > limits.most_still,
    }
    named = F.coalesce(*(F.when(c, F.lit(n)) for n, c in reasons.items()))
    return stats.select("inst", named.alias("reason")).where("reason IS NOT NULL")


def _runs(panel: DataFrame, flag: Column, out: str) -> DataFrame:
    """``panel`` with the length of the run of flagged rows that a flagged row is in, else zero."""
    made = panel.withColumn("_on", F.coalesce(flag, F.lit(False)))
    made = made.withColumn("_island", F.sum((~F.col("_on")).cast("int")).over(ts.so_far()))
    length = F.sum(F.col("_on").cast("int")).over(Window.partitionBy("inst", "_island"))
    return made.withColumn(out, F.when(F.col("_on"), length).otherwise(0)).drop("_on", "_island")


def bar_faults(panel: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``panel`` with ``fault``, the first of: stale, empty, broken, flat, jump; null for bars in order.

    stale, empty: in a run of ``stale_run`` unchanged prices, ``empty_run`` bars of volume zero; broken: high below low, a
    price that is not positive or a close outside the bar; flat: high, low and close are one; jump: the first bar after a
    gap, more than ``most_jump`` away from the price before it.
    """
    close, line = F.col("close"), ts.series()
    made = _runs(panel, close == F.lag("close").over(line), "_stale")
    made = _runs(made, (F.col("volume") == 0) & close.isNotNull(), "_empty")
    broken = (F.col("high") < F.col("low")) | (close <= 0) | (close < F.col("low")) | (close > F.col("high"))
    flat = (F.col("high") == F.col("low")) & (F.col("high") == close)
    prior = F.last("close", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    resumed = close.isNotNull() & F.lag(close.isNull(), 1).over(line)
    jump = resumed & (F.abs(over(close - prior, F.abs(prior))) > limits.most_jump)
    faults = {"stale": F.col("_stale") >= limits.stale_run, "empty": F.col("_empty") >= limits.empty_run, "broken": broken, "flat": flat, "jump": jump}
    return made.withColumn("fault", F.coalesce(*(F.when(c, F.lit(n)) for n, c in faults.items()))).drop("_stale", "_empty")


def emptied(faulty: DataFrame) -> DataFrame:
    """Prices of faulty bars become missing."""
    return faulty.withColumns({c: F.when(F.col("fault").isNull(), F.col(c)) for c in ("close", "high", "low")})


def capped_returns(panel: DataFrame, ret: str, dollars: str | None = None, limits: Limits = Limits(), out: str = "capped") -> DataFrame:
    """``panel`` with the return clipped to the hard limit and to a multiple of its median size over the bars before.

    Where dollars are beyond ``spike_multiple`` of their median before and the return beyond ``spike_return``, the bar is
    a bad print and its return missing.  Before there are ``least_window`` values only the hard limit holds.
    """
    columns, line = panel.columns, ts.series()
    made = panel.withColumn("_r", clip(F.col(ret).cast("double"), -limits.most_return, limits.most_return))
    # quantiles of the values one bar late are those of the bars before: no window has to follow them
    before = {"_size": F.lag(F.abs("_r")).over(line), **({"_traded": F.lag(dollars).over(line)} if dollars else {})}
    names = {"_mid": "_size", **({"_usual": "_traded"} if dollars else {})}
    made = rolling_quantiles(made.withColumns(before), names, limits.window, 0.5, limits.least_window, span_rows=None)
    cap = F.greatest(F.col("_mid") * limits.cap_multiple, F.lit(limits.least_cap))
    made = made.withColumn("_cap", F.when(F.col("_mid").isNotNull(), cap))
    made = made.withColumn(out, F.when(F.col("_cap").isNull(), F.col("_r")).otherwise(clip(F.col("_r"), -F.col("_cap"), F.col("_cap"))))
    if dollars:
        spike = (F.col(dollars) > F.col("_usual") * limits.spike_multiple) & (F.abs(out) > limits.spike_return)
        made = made.withColumn(out, F.when(~F.coalesce(spike, F.lit(False)), F.col(out)))
    return made.select(*columns, out)


def cleaned(panel: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All stages: remaining instruments with emptied bars, ``ret`` capped, and ``tradable``, false on emptied bars."""
    left = panel.join(excluded_instruments(panel, limits).select("inst"), "inst", "left_anti")
    made = emptied(bar_faults(left, limits))
    made = made.withColumn("_raw", over(F.col("close"), F.lag("close").over(ts.series())) - 1)
    return capped_returns(made, "_raw", "dollars", limits, "ret").withColumn("tradable", F.col("close").isNotNull()).drop("_raw")
