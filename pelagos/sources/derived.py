"""Fields derived from bars, all by windows along an instrument: one exchange whatever their number.

A window of n rows gives a value from half as many values on; a zero volume, range or price divides to missing.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import timeseries as ts
from pelagos.functions.elementwise import log, over


def _rolling(aggregate, x: Column, n: int) -> Column:
    w = Window.partitionBy("inst").orderBy("ts").rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(w) >= max(n // 2, 1), aggregate(x).over(w))


def derived_fields(
    panel: DataFrame,
    bars_per_year: int = 252,
    adv: Sequence[int] = (20, 60),
    volatility: Sequence[int] = (10, 20, 60, 120),
    parkinson: Sequence[int] = (10, 20, 60),
    momentum: Sequence[int] = (5, 20, 60),
    ratio: int = 20,
) -> DataFrame:
    """``panel`` (open, high, low, close, volume and dollars) with the usual derived fields.

    returns, log_returns, vwap, vwap_deviation, adv_n, volume_ratio, volatility_n (yearly), parkinson_n (yearly),
    high_low_range, open_close_range, momentum_n, overnight_gap, upper_shadow and lower_shadow; with columns ``trades`` or
    ``taker_volume`` also trades_per_volume and taker_buy_ratio.
    """
    close, high, low, volume, dollars = (F.col(c) for c in ("close", "high", "low", "volume", "dollars"))
    line, year = ts.series(), math.sqrt(bars_per_year)
    before = F.lag("close").over(line)
    vwap, span = over(dollars, volume), high - low
    made = {
        "returns": over(close, before) - 1,
        "log_returns": log(over(close, before)),
        "vwap": vwap,
        "vwap_deviation": over(close - vwap, vwap),
        "volume_ratio": over(dollars, _rolling(F.avg, dollars, ratio)),
        "high_low_range": over(span, close),
        "open_close_range": over(F.abs(close - F.col("open")), close),
        "overnight_gap": over(F.col("open"), before) - 1,
        "upper_shadow": over(high - F.greatest("open", "close"), span),
        "lower_shadow": over(F.least("open", "close") - low, span),
    }
    made |= {f"adv_{n}": _rolling(F.avg, dollars, n) for n in adv}
    made |= {f"momentum_{n}": over(close, F.lag("close", n).over(line)) - 1 for n in momentum}
    if "trades" in panel.columns:
        made["trades_per_volume"] = over(F.col("trades"), volume)
    if "taker_volume" in panel.columns:
        made["taker_buy_ratio"] = over(F.col("taker_volume"), volume)
    square = F.pow(log(over(high, low)), 2) / (4 * math.log(2))
    made |= {f"parkinson_{n}": F.sqrt(_rolling(F.avg, square, n)) * year for n in parkinson}
    first = panel.withColumns(made)
    # deviations of a derived field: a second pass over the same order
    return first.withColumns({f"volatility_{n}": _rolling(F.stddev_samp, F.col("returns"), n) * year for n in volatility})


def basis(panel: DataFrame, future: str, spot: str, n: int = 20) -> DataFrame:
    """``panel`` with basis, the future's price over the spot price less one, and basis_z, its deviation from the last n."""
    made = panel.withColumn("basis", over(F.col(future), F.col(spot)) - 1)
    x = F.col("basis")
    z = over(x - _rolling(F.avg, x, n), _rolling(F.stddev_samp, x, n))
    return made.withColumn("basis_z", z)
