"""Out-of-sample evaluation of (alpha, ts, r) series: splits, folds, ratings, gates and tests."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagos.functions.elementwise import over
from pelagos.plans import backtest as bt


def _sharpe(r: str, bars_per_year: int) -> Column:
    return over(F.avg(r), F.stddev_samp(r)) * math.sqrt(bars_per_year)


def fixed_split(returns: DataFrame, ratio: float = 0.7, least: int = 60) -> DataFrame:
    """``returns`` with ``sample``, 'in' for the first ``ratio`` of each alpha's rows, else 'out'.

    Alphas with fewer than ``least`` rows on either side have no rows.  Returns carry on over the split.
    """
    line, whole = Window.partitionBy("alpha").orderBy("ts"), Window.partitionBy("alpha")
    made = returns.withColumn("place", F.row_number().over(line)).withColumn("n", F.count("*").over(whole))
    cut = F.floor(F.col("n") * ratio)
    made = made.where((cut >= least) & (F.col("n") - cut >= least))
    return made.withColumn("sample", F.when(F.col("place") <= cut, "in").otherwise("out")).drop("place", "n")


def walk_forward(returns: DataFrame, inside: int, outside: int, folds: int) -> DataFrame:
    """``returns`` once per fold and sample: ``outside`` rows after ``inside`` rows, laid from the end backward.

    Folds are numbered from the earliest, 1; there are as many as fit, at most ``folds``.  A row belongs to at most
    one 'out' and ``inside / outside`` 'in' samples, so nothing grows but by that factor.
    """
    line, whole = Window.partitionBy("alpha").orderBy("ts"), Window.partitionBy("alpha")
    made = returns.withColumn("place", F.row_number().over(line) - 1).withColumn("n", F.count("*").over(whole))
    made = made.withColumn("fit", F.least(F.floor((F.col("n") - inside) / outside), F.lit(folds)))
    each = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda i: i < F.col("fit"))
    made = made.withColumn("i", F.explode(each)).withColumn("begin", F.col("n") - (F.col("i") + 1) * outside)
    place = F.col("place")
    sample = F.when((place >= F.col("begin")) & (place < F.col("begin") + outside), "out").when((place < F.col("begin")) & (place >= F.col("begin") - inside), "in")
    made = made.withColumn("fold", (F.col("fit") - F.col("i")).cast("int")).withColumn("sample", sample)
    return made.where("sample IS NOT NULL").drop("place", "n", "fit", "i", "begin")


def simulate_apart(panel: DataFrame, prepare: Callable[[DataFrame], DataFrame] | None, signal: str, rules: bt.Rules, sides: DataFrame, keys: tuple[str, ...] = ("sample",)) -> DataFrame:
    """keys, ts and the per-time PnL of a signal that is simulated for each side by itself.

    ``prepare`` adds the signal to a panel, from each side's own rows; None if the panel has it already.

    ``sides`` says which times belong to which side: ts and the keys, from ``fixed_split`` or ``walk_forward`` over the
    times.  No side sees another: positions, delays and changes begin anew, so the first rows of a side hold nothing.
    """
    own = panel.join(sides.select("ts", *keys), "ts")
    # with the side inside both of its keys, every window of the simulation stays within one side
    own = own.withColumn("inst", F.struct(*keys, "inst")).withColumn("ts", F.struct("ts", *keys))
    made = bt.simulate(prepare(own) if prepare else own, signal, rules)
    return made.select(*(F.col("ts")[k].alias(k) for k in keys), F.col("ts.ts").alias("at"), *made.columns[1:]).withColumnRenamed("at", "ts")


def times_of(panel: DataFrame) -> DataFrame:
    """The different times of a panel as one series, for ``fixed_split`` and ``walk_forward``."""
    return panel.select(F.lit("all").alias("alpha"), "ts").distinct()


def decay(samples: DataFrame, keys: list[str], bars_per_year: int = 252) -> DataFrame:
    """Per key: Sharpe and mean inside and outside, their ratios, and whether a positive Sharpe stayed positive."""
    each = samples.groupBy(*keys).pivot("sample", ["in", "out"]).agg(_sharpe("r", bars_per_year).alias("sharpe"), F.avg("r").alias("mean"), F.count(F.lit(1)).alias("n"))
    ratio = lambda x: F.coalesce(over(F.col(f"out_{x}"), F.col(f"in_{x}")), F.lit(0.0))
    steady = F.when(F.col("in_sharpe") > 0, F.coalesce(F.col("out_sharpe") > 0, F.lit(False))).otherwise(True)
    return each.select("*", ratio("sharpe").alias("sharpe_decay"), ratio("mean").alias("mean_decay"), steady.alias("steady"))


#: The Sharpe ratio above which a rating holds, without and with a delay.
RATINGS = ["Spectacular", "Excellent", "Good", "Average"]
BOUNDS = {0: [6.0, 5.25, 4.5, 3.95], 1: [4.5, 3.5, 3.0, 2.5]}


def rating(sharpe: Column, delay: int = 1) -> Column:
    made = F.when(sharpe >= 1.0, "Inferior").otherwise("Poor")
    for name, bound in reversed(list(zip(RATINGS, BOUNDS[min(delay, 1)], strict=True))):
        made = F.when(sharpe > bound, name).otherwise(made)
    return made


def passed_gates(sharpe: Column, fitness: Column, turnover: Column, drawdown: Column, annual: Column, margin_bps: Column,
                 least_sharpe: float = 1.25, least_fitness: float = 1.0) -> Column:
    """How many of eight gates a result passes; none without Sharpe and fitness.  A missing figure fails its gate."""
    gates = [sharpe >= least_sharpe, sharpe >= 0.5, fitness >= least_fitness, fitness >= 0.5, (turnover > 0.01) & (turnover < 0.7),
             drawdown > -0.3, annual > 0, F.abs(margin_bps) > 0.1]
    total = sum((F.coalesce(g.cast("int"), F.lit(0)) for g in gates), F.lit(0))
    return F.when(sharpe.isNull() | fitness.isNull(), F.lit(0)).otherwise(total)


def equity(returns: DataFrame, start: float = 1.0) -> DataFrame:
    """``returns`` with ``equity``, the compounded value along each alpha; a missing return keeps it."""
    so_far = Window.partitionBy("alpha").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", F.product(1 + F.coalesce("r", F.lit(0.0))).over(so_far) * start)


def directional_pnl(panel: DataFrame, signal: str, ret: str, fee_bps: float) -> DataFrame:
    """``pnl``: sign of the signal times the return, less the fee on every change of the sign."""
    line = Window.partitionBy("inst").orderBy("ts")
    made = panel.withColumn("side", F.coalesce(F.signum(signal), F.lit(0.0)))
    change = F.abs(F.col("side") - F.coalesce(F.lag("side").over(line), F.lit(0.0)))
    return made.withColumn("pnl", F.col("side") * F.coalesce(F.col(ret), F.lit(0.0)) - change * fee_bps / 1e4)


def correlation_with(panel: DataFrame, a: str, b: str, least: int = 3) -> DataFrame:
    """inst, corr and n of two columns over the rows that have both."""
    both = panel.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy("inst")
    made = both.agg(F.covar_samp(a, b).alias("c"), F.stddev_samp(a).alias("sa"), F.stddev_samp(b).alias("sb"), F.count("*").alias("n"))
    return made.where(F.col("n") >= least).select("inst", over(F.col("c"), F.col("sa") * F.col("sb")).alias("corr"), "n")


def log_fit(points: DataFrame, y: str, n: str) -> DataFrame:
    """slope, intercept and r2 of ``y`` on the logarithm of ``n``."""
    x = F.log(n)
    return points.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def granger(pairs: DataFrame, y: str, x: str, keys: list[str]) -> DataFrame:
    """Per key: n, f and p of the test that the previous ``x`` helps to tell ``y`` beyond the previous ``y``.

    One lag.  The statistic follows from three correlations, so one aggregate does for any number of keys.  A constant
    column gives no statistic.
    """
    line = Window.partitionBy(*keys).orderBy("ts")
    rows = pairs.select(*keys, F.col(y).alias("y"), F.lag(y).over(line).alias("z"), F.lag(x).over(line).alias("x"))
    rows = rows.where("y IS NOT NULL AND z IS NOT NULL AND x IS NOT NULL")
    corr = lambda a, b: over(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    made = rows.groupBy(*keys).agg(corr("y", "x").alias("yx"), corr("y", "z").alias("yz"), corr("x", "z").alias("xz"), F.count("*").alias("n"))
    left = F.col("yx") - F.col("yz") * F.col("xz")
    square = over(left * left, (1 - F.col("yz") ** 2) * (1 - F.col("xz") ** 2))
    made = made.withColumn("f", F.when(F.col("n") > 3, over(square, 1 - square) * (F.col("n") - 3)))
    return made.select(*keys, "n", "f", _tail(F.col("f"), F.col("n") - 3).alias("p"))


def f_tail(f: float, d: float, d1: float = 1) -> float:
    """P(F > f) with ``d1`` and ``d`` degrees of freedom: a regularised incomplete beta function by its continued fraction."""
    if f <= 0:
        return 1.0
    a, b, x = d / 2, d1 / 2, d / (d + d1 * f)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float, steps: int = 300) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 0.0
    for m in range(steps, 0, -1):  # the fraction 1 / (1 + d1 / (1 + d2 / ...)), from its end
        k = m // 2
        d = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)) if m % 2 == 0 else -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        value = d / (1 + value)
    return front / (1 + value)


@F.pandas_udf(T.DoubleType())
def _tail(f: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f_tail(float(v), float(n)) for v, n in zip(f, d, strict=True)], dtype="float64")
