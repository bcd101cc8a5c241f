"""Universe construction: rolling liquidity, periodic rebalances, top-N membership held to the next rebalance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import timeseries as ts


def top_n(panel: DataFrame, n: int, value: str = "dollars", window: int = 20, least: int = 10, every: int = 20, seasoning: int = 0) -> DataFrame:
    """``panel`` with ``member``: among the ``n`` largest by rolling mean at the last rebalance.

    Rebalances fall on every ``every``-th row of the shared calendar; an instrument needs ``seasoning`` earlier present
    values.  Ties go to the smaller instrument.  Both windows over (inst, ts) share one shuffle.
    """
    line = ts.series()
    made = panel.withColumn("bar", F.row_number().over(line) - 1)
    made = made.withColumn("adv", ts.at_least(least, F.col(value), ts.trailing(window), F.avg(value).over(ts.trailing(window))))
    made = made.withColumn("age", F.count(value).over(ts.so_far()))
    eligible = F.when((F.col("age") > seasoning) & (F.col("bar") % every == 0), F.col("adv"))
    made = made.withColumn("eligible", eligible)
    order = Window.partitionBy("ts", F.col("eligible").isNull()).orderBy(F.col("eligible").desc(), F.col("inst"))
    place = F.when(F.col("eligible").isNotNull(), F.row_number().over(order))
    made = made.withColumn("chosen", F.when(F.col("bar") % every == 0, F.coalesce(place <= n, F.lit(False))))
    held = F.last("chosen", ignorenulls=True).over(ts.so_far())
    return made.withColumn("member", F.coalesce(held, F.lit(False))).drop("bar", "age", "eligible", "chosen")


def band(high: DataFrame, low: DataFrame) -> DataFrame:
    """(ts, inst) that are members of the wide universe and not of the narrow one."""
    wide, narrow = (d.where("member").select("ts", "inst") for d in (high, low))
    return wide.exceptAll(narrow)


def coverage_filter(panel: DataFrame, member: str, cutoff: float) -> DataFrame:
    """Rows of instruments whose share of member rows exceeds ``cutoff``."""
    share = panel.groupBy("inst").agg(F.avg(F.col(member).cast("double")).alias("share")).where(F.col("share") > cutoff)
    return panel.join(share.select("inst"), "inst", "left_semi")
