"""Operators across instruments at one time, and inside groups at one time."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from pelagos.functions.elementwise import clip, over
from pelagos.functions.timeseries import TIME


def section(*groups: str):
    return Window.partitionBy(TIME, *groups)


def rank(x: Column, *groups: str) -> Column:
    """Mean-tie rank over the number of present values; missing stays missing."""
    present = Window.partitionBy(TIME, *groups, x.isNull())
    ties = F.count(F.lit(1)).over(Window.partitionBy(TIME, *groups, x))
    low = F.rank().over(present.orderBy(x))
    return F.when(x.isNotNull(), (low + (ties - 1) / 2) / F.count(x).over(section(*groups)))


def scale(x: Column, k: float = 1.0) -> Column:
    return over(x * k, F.sum(F.abs(x)).over(section()))


def zscore(x: Column) -> Column:
    w = section()
    return over(x - F.avg(x).over(w), F.when(F.count(x).over(w) >= 2, F.stddev_samp(x).over(w)))


def winsorize(x: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """Clipped to interpolated quantiles of the section."""
    w = section()
    return clip(x, F.percentile(x, F.lit(low)).over(w), F.percentile(x, F.lit(high)).over(w))


def normalize(x: Column, limit: float = 0.0) -> Column:
    """To [-1, 1] by the section's extremes; no spread gives missing."""
    low, high = F.min(x).over(section()), F.max(x).over(section())
    made = 2 * over(x - low, high - low) - 1
    return clip(made, -limit, limit) if limit else made


def market_neutralize(x: Column) -> Column:
    return x - F.avg(x).over(section())


def vec_avg(x: Column) -> Column:
    return F.avg(x).over(section())


def vec_sum(x: Column) -> Column:
    return F.coalesce(F.sum(x).over(section()), F.lit(0.0))


def hump(x: Column, h: float = 0.01) -> Column:
    """Clipped to the section's mean and ``h`` deviations around it."""
    w = section()
    mean, spread = F.avg(x).over(w), F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0))
    return clip(x, mean - h * spread, mean + h * spread)


def bucket(x: Column, b: int = 10) -> Column:
    """Quantile bins 1..b with equal edges dropped; one present value or none passes through."""
    w = section()
    edges = F.array_distinct(F.percentile(x, F.array(*(F.lit(i / b) for i in range(b + 1)))).over(w))
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    place = (F.size(F.filter(inner, lambda e: e < x)) + 1).cast("double")
    return F.when(F.count(x).over(w) < 2, x).when(x.isNotNull(), place)


def group_neutralize(x: Column, level: str) -> Column:
    """Less the group's mean; without a group the value passes through."""
    return F.when(F.col(level).isNotNull(), x - F.avg(x).over(section(level))).otherwise(x)


def _alone(level: str) -> Column:
    return F.count(F.lit(1)).over(section(level)) == 1


def group_rank(x: Column, level: str) -> Column:
    """Rank inside the group; a group of one instrument passes through."""
    return F.when(F.col(level).isNull() | _alone(level), x).otherwise(rank(x, level))


def group_zscore(x: Column, level: str) -> Column:
    w = section(level)
    score = over(x - F.avg(x).over(w), F.when(F.count(x).over(w) >= 2, F.stddev_samp(x).over(w)))
    return F.when(F.col(level).isNull() | _alone(level), x).otherwise(score)


def group_scale(x: Column, level: str) -> Column:
    return over(x, F.sum(F.abs(x)).over(section(level)))


def group_mean(x: Column, weight: Column, level: str) -> Column:
    """Weighted mean for all of the group; weights of missing values still count in the denominator."""
    w = section(level)
    return F.when(F.col(level).isNotNull(), over(F.sum(x * weight).over(w), F.sum(weight).over(w)))


def corr_of(x: str, y: str) -> Column:
    """Grouped Pearson correlation that gives missing where a side is constant."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return over(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
