"""Panel aggregates: information coefficients, quantile spreads, per-date regressions, resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.cross_section import corr_of, rank
from pelagos.functions.elementwise import over


def spearman_ic(panel: DataFrame, signal: str, ret: str, least: int = 10) -> DataFrame:
    """ts, ic and n: rank correlation of signal and return over instruments that have both."""
    both = panel.where(F.col(signal).isNotNull() & F.col(ret).isNotNull()).select("ts", "inst", signal, ret)
    ranked = both.select("ts", rank(F.col(signal)).alias("a"), rank(F.col(ret)).alias("b"))
    return ranked.groupBy("ts").agg(corr_of("a", "b").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def batch_ic(panel: DataFrame, signals: list[str], ret: str, least: int = 10) -> DataFrame:
    """alpha, ts, ic and n of many signals: one shuffle by time, then ranks inside each time's section.

    A section has one row per instrument.  Each signal is ranked over the rows where it and the return are present.
    """

    def section(pdf: pd.DataFrame) -> pd.DataFrame:
        y, rows = pdf[ret].astype(float), []
        for name in signals:
            x = pdf[name].astype(float)
            ok = x.notna() & y.notna()
            n = int(ok.sum())
            if n >= least:
                a, b = x[ok].rank(), y[ok].rank()
                spread = a.std() * b.std()
                rows.append((name, pdf["ts"].iloc[0], float(a.cov(b) / spread) if spread > 0 else None, n))
        return pd.DataFrame(rows, columns=["alpha", "ts", "ic", "n"])

    return panel.select("ts", ret, *signals).groupBy("ts").applyInPandas(section, "alpha string, ts timestamp, ic double, n long")


def quantile_spread(panel: DataFrame, signal: str, ret: str, bins: int = 5, least: int = 20) -> DataFrame:
    """ts, long, short, spread: mean return at or above the top and at or below the bottom quantile of the signal."""
    both = panel.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())
    edges = both.groupBy("ts").agg(F.percentile(signal, F.lit(1 / bins)).alias("lo"), F.percentile(signal, F.lit(1 - 1 / bins)).alias("hi"), F.count("*").alias("n"))
    sides = both.join(edges.where(F.col("n") >= least), "ts").groupBy("ts").agg(
        F.avg(F.when(F.col(signal) >= F.col("hi"), F.col(ret))).alias("long"),
        F.avg(F.when(F.col(signal) <= F.col("lo"), F.col(ret))).alias("short"),
        F.sum((F.col(signal) >= F.col("hi")).cast("int")).alias("n_long"),
        F.sum((F.col(signal) <= F.col("lo")).cast("int")).alias("n_short"),
    )
    return sides.where("n_long >= 3 AND n_short >= 3").select("ts", "long", "short", (F.col("long") - F.col("short")).alias("spread"))


def section_regression(panel: DataFrame, y: str, x: str, least: int = 15) -> DataFrame:
    """First pass of Fama-MacBeth: ts, slope, intercept, r2 and n of y on x over each time's instruments."""
    both = panel.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    made = both.groupBy("ts").agg(
        F.covar_samp(y, x).alias("c"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"),
        F.avg(y).alias("my"), F.avg(x).alias("mx"), F.count("*").alias("n"),
    ).where(F.col("n") >= least)
    slope = over(F.col("c"), F.col("vx"))
    r2 = over(F.col("c") * F.col("c"), F.col("vx") * F.col("vy"))
    return made.select("ts", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), r2.alias("r2"), "n")


def newey_west(premia: DataFrame, value: str = "slope", lags: int = 6) -> DataFrame:
    """Second pass: one row with mean, Newey-West standard error (Bartlett weights), t statistic and n of a series.

    The series has one row per time, so one ordered window over it is small.  An empty series has n zero and no mean.
    """
    mean = premia.agg(F.avg(value).alias("mean"))
    series = premia.where(F.col(value).isNotNull()).select("ts", F.col(value).alias("x")).join(F.broadcast(mean))
    order = Window.orderBy("ts")
    e = F.col("x") - F.col("mean")
    lagged = series.select("mean", e.alias("e"), *(F.lag(e, k).over(order).alias(f"l{k}") for k in range(1, lags + 1)))
    total = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lags + 1):
        total = total + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0))
    made = lagged.agg(F.first("mean").alias("mean"), total.alias("v"), F.count("*").alias("n"))
    se = F.sqrt(over(F.greatest(over(F.col("v"), F.col("n")), F.lit(0.0)), F.col("n")))
    return made.select("mean", se.alias("se"), over(F.col("mean"), se).alias("t"), "n")


def ohlc_resample(bars: DataFrame, every: str, keys: list[str], time: str = "ts") -> DataFrame:
    """Open, high, low, close and volume of each window of length ``every``; empty windows are absent."""
    w = F.window(time, every)
    return bars.groupBy(*keys, w.alias("w")).agg(
        F.min_by("open", time).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", time).alias("close"), F.sum("volume").alias("volume"),
    ).select(*keys, F.col("w.start").alias(time), "open", "high", "low", "close", "volume")


def block_sum(series: DataFrame, value: str, rows: int, keys: list[str], time: str = "ts") -> DataFrame:
    """Sums of consecutive blocks of ``rows`` rows."""
    numbered = series.withColumn("block", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1) / rows))
    return numbered.groupBy(*keys, "block").agg(F.sum(value).alias(value), F.min(time).alias(time))


def pair_correlations(returns: DataFrame, name: str = "alpha", value: str = "r", least: int = 20) -> DataFrame:
    """Correlation of each pair of named series over their common times."""
    a = returns.select("ts", F.col(name).alias("a"), F.col(value).alias("x"))
    b = returns.select("ts", F.col(name).alias("b"), F.col(value).alias("y"))
    both = a.join(b, "ts").where("a < b AND x IS NOT NULL AND y IS NOT NULL")
    return both.groupBy("a", "b").agg(corr_of("x", "y").alias("corr"), F.count("*").alias("n")).where(F.col("n") >= least)


def block_bootstrap(values: np.ndarray, spark, n_boot: int = 2000, block: int = 5, seed: int = 42) -> DataFrame:
    """Mean and Sharpe of ``n_boot`` circular block resamples of one short series; one row per resample."""

    def draw(batches):
        for batch in batches:
            rows = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                begin = rng.integers(0, len(values), math.ceil(len(values) / block))
                own = values[((begin[:, None] + np.arange(block)) % len(values)).ravel()[: len(values)]]
                spread = own.std(ddof=1)
                rows.append((int(i), float(own.mean()), float(own.mean() / spread * math.sqrt(252)) if spread > 0 else None))
            yield pd.DataFrame(rows, columns=["id", "mean", "sharpe"])

    return spark.range(n_boot).mapInPandas(draw, "id long, mean double, sharpe double")


def coverage(panel: DataFrame, field: str) -> DataFrame:
    """Per instrument: share of present values, mean, median, deviation."""
    return panel.groupBy("inst").agg(
        F.avg(F.col(field).isNotNull().cast("double")).alias("coverage"), F.avg(field).alias("mean"),
        F.median(field).alias("median"), F.stddev_samp(field).alias("deviation"),
    )


