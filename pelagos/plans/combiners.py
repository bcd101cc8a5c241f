"""Weights of alphas from their past returns, market regimes, and selections within a section.

Series of alphas have one row per alpha and time; each function makes one exchange by alpha and one by time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import timeseries as ts
from pelagos.functions.cross_section import corr_of
from pelagos.functions.elementwise import clip, over
from pelagos.operators import order_stats, sequential


def _share(x: Column) -> Column:
    """``x`` as a share of its time's total; zero where the total is zero."""
    return F.coalesce(over(x, F.sum(x).over(Window.partitionBy("ts"))), F.lit(0.0))


def rolling_weights(returns: DataFrame, lookback: int = 60, least: int = 20, top: int = 5, shrink: float = 0.5) -> DataFrame:
    """alpha, ts and five weights from (alpha, ts, r): adaptive, momentum, top, shrunk and parity.

    All look at the last ``lookback`` returns, the present one included, and need ``least`` of them.  Adaptive: positive
    means.  Momentum: positive sums.  Top: equal weights of the ``top`` best means that are positive, ties to the
    smaller name.  Shrunk: ``shrink`` of the way from adaptive to equal.  Parity: inverse deviations where the mean is
    positive.  A time without any eligible alpha has zero weights.  Means and sums below 1e-12 count as zero, as sums
    that cancel leave noise.
    """
    past = Window.partitionBy("alpha").orderBy("ts").rowsBetween(1 - lookback, 0)
    each = Window.partitionBy("ts")
    seen = lambda make: F.when(F.count("r").over(past) >= least, make("r").over(past))
    scored = returns.select("alpha", "ts", F.round(seen(F.avg), 12).alias("m"), F.round(seen(F.sum), 12).alias("total"), seen(F.stddev_samp).alias("v"))
    place = F.row_number().over(each.orderBy(F.col("m").desc_nulls_last(), "alpha"))
    scored = scored.withColumns({
        "up": F.greatest("m", F.lit(0.0)), "rise": F.greatest("total", F.lit(0.0)),
        "chosen": F.when((place <= top) & (F.col("m") > 0), F.lit(1.0)).otherwise(0.0),
        "calm": F.when(F.col("m") > 0, F.coalesce(over(F.lit(1.0), F.col("v")), F.lit(0.0))).otherwise(0.0),
    })
    adaptive = _share(F.col("up"))
    equal = 1 / F.count("*").over(each)
    return scored.select("alpha", "ts", adaptive.alias("adaptive"), _share(F.col("rise")).alias("momentum"), _share(F.col("chosen")).alias("top"),
                         (adaptive * (1 - shrink) + equal * shrink).alias("shrunk"), _share(F.col("calm")).alias("parity"))


def smoothed_weights(weights: DataFrame, weight: str, halflife: float = 30.0) -> DataFrame:
    """(alpha, ts, w): weights averaged with exponential decay along each alpha and scaled to one again."""
    slow = sequential.ewm_mean(weights.select("alpha", "ts", weight), weight, 1 - 0.5 ** (1 / halflife), "slow", ("alpha",))
    return slow.select("alpha", "ts", _share(F.col("slow")).alias("w"))


def ic_series(signals: DataFrame, least: int = 5) -> DataFrame:
    """(alpha, ts, r): rank correlation of the previous signal with the present return over instruments with both."""
    line = Window.partitionBy("alpha", "inst").orderBy("ts")
    held = signals.withColumn("h", F.lag("s").over(line)).where("h IS NOT NULL AND ret IS NOT NULL")
    each = Window.partitionBy("alpha", "ts")
    mean_rank = lambda x: F.rank().over(each.orderBy(x)) + (F.count("*").over(Window.partitionBy("alpha", "ts", x)) - 1) / 2
    ranked = held.select("alpha", "ts", mean_rank("h").alias("a"), mean_rank("ret").alias("b"))
    made = ranked.groupBy("alpha", "ts").agg(corr_of("a", "b").alias("r"), F.count("*").alias("n"))
    return made.where(F.col("n") >= least).select("alpha", "ts", "r")


def shut_off(returns: DataFrame, n: int = 20) -> DataFrame:
    """``returns`` with ``live``: zero where the mean of the ``n`` returns before is not positive."""
    past = Window.partitionBy("alpha").orderBy("ts").rowsBetween(-n, -1)
    return returns.withColumn("live", F.when(F.avg("r").over(past) > 0, F.col("r")).otherwise(0.0))


def market_series(panel: DataFrame, value: str, n: int) -> DataFrame:
    """One row per time: the section's mean ``x``, its rolling mean and deviation over ``n`` times.

    The series is short, one row per time, so its windows have one partition.
    """
    w = Window.orderBy("ts").rowsBetween(1 - n, 0)
    made = panel.groupBy("ts").agg(F.avg(value).alias("x"))
    return made.select("ts", "x", F.avg("x").over(w).alias("mean"), F.when(F.count("x").over(w) >= 2, F.stddev_samp("x").over(w)).alias("deviation"))


def regime_scale(panel: DataFrame, ret: str, n: int = 84, slow: float = 42.0, smooth: float = 30.0) -> DataFrame:
    """(ts, scale): how much to lever when the market's volatility leaves its median so far; between 0.2 and 2.5."""
    one = market_series(panel, ret, n).select(F.lit("market").alias("alpha"), "ts", F.col("deviation").alias("v"))
    vol = sequential.ewm_mean(one, "v", 1 - 0.5 ** (1 / slow), "vol", ("alpha",))
    vol = order_stats.expanding_quantile(vol, "vol", keys=("alpha",), out="middle")
    raw = vol.withColumn("middle", F.greatest("middle", F.lit(1e-4))).withColumn("raw", clip(over(F.col("middle"), F.col("vol")), 0.2, 2.5))
    made = sequential.ewm_mean(raw.select("alpha", "ts", "raw"), "raw", 1 - 0.5 ** (1 / smooth), "scale", ("alpha",))
    return made.select("ts", "scale")


def top_bottom(signal: Column, x: int) -> Column:
    """1/x on the ``x`` greatest signals of a time, -1/x on the ``x`` least, else zero; ties to the smaller instrument.

    A section of fewer than 2x signals may hold one instrument on both sides, which then cancel.
    """
    each = Window.partitionBy("ts")
    high = F.row_number().over(each.orderBy(signal.desc_nulls_last(), "inst")) <= x
    low = F.row_number().over(each.orderBy(signal.asc_nulls_last(), "inst")) <= x
    side = high.cast("int") - low.cast("int")
    return F.when(signal.isNull(), F.lit(0.0)).otherwise(side / x)


def capped_positions(signal: Column, most: int) -> Column:
    """The ``most`` signals of a time that are greatest in size; the others are zero; ties to the smaller instrument."""
    place = F.row_number().over(Window.partitionBy("ts").orderBy(F.abs(signal).desc_nulls_last(), "inst"))
    return F.when(signal.isNull(), F.lit(None)).when(place <= most, signal).otherwise(0.0)


def volatility_hedge(panel: DataFrame, ret: str, n: int = 20, out: str = "hedge") -> DataFrame:
    """``out``: rolling deviation of absolute returns, as a multiple of its deviation across the section."""
    made = panel.withColumn("moves", ts.stddev(F.abs(F.col(ret)), n))
    return made.withColumn(out, over(F.col("moves"), F.stddev_samp("moves").over(Window.partitionBy("ts")))).drop("moves")
