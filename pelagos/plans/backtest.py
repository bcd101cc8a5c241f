"""From signal to portfolio to metrics: delay, decay, mask, neutralise, normalise, clip, PnL, evaluation.

Everything up to the positions is one chain of windows over two keys, (inst, ts) and (ts); the PnL is one aggregate per
time, and the metrics work on that small series.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import cross_section as xs
from pelagos.functions import timeseries as ts
from pelagos.functions.elementwise import INF, clip, over, price_filter


@dataclass(frozen=True)
class Rules:
    booksize: float = 2e7
    max_weight: float = 0.01
    decay: int = 0
    delay: int = 1
    neutralization: str = "none"  # none, market, or a group column
    fees_bps: float = 0.0
    min_price: float | None = None
    max_price: float | None = None
    bars_per_year: int = 252
    turnover_floor: float = 0.125


def delayed_decay(signal: Column, delay: int, decay: int) -> Column:
    """The signal ``delay`` rows back, then the weighted mean of its last ``decay`` values, one on the newest."""
    if decay <= 1:
        return F.lag(signal, delay).over(ts.series())
    total = decay * (decay + 1) / 2
    parts = [F.coalesce(F.lag(signal, delay + i).over(ts.series()), F.lit(0.0)) * ((i + 1) / total) for i in range(decay)]
    return sum(parts[1:], parts[0])


def positions(panel: DataFrame, signal: str, rules: Rules, universe: str | None = None) -> DataFrame:
    """``panel`` with ``weight``, each instrument's share of the book."""
    clean = F.when(F.abs(F.col(signal)) == INF, F.lit(0.0)).otherwise(F.col(signal))
    made = panel.withColumn("clean", clean).withColumn("a", delayed_decay(F.col("clean"), rules.delay, rules.decay))
    made = made.withColumn("a", price_filter(F.col("a"), F.col("close"), rules.min_price, rules.max_price))
    if universe:
        made = made.withColumn("a", F.when(F.coalesce(F.col(universe), F.lit(False)), F.col("a")))
    if rules.neutralization == "market":
        made = made.withColumn("a", xs.market_neutralize(F.col("a")))
    elif rules.neutralization != "none":
        made = made.withColumn("a", xs.group_neutralize(F.col("a"), rules.neutralization))
    made = made.withColumn("a", xs.scale(F.col("a")))
    return made.withColumn("weight", clip(F.col("a"), -rules.max_weight, rules.max_weight)).drop("a", "clean")


def with_returns(panel: DataFrame, delay: int) -> DataFrame:
    """``ret``: the open-to-open return that a position of this row earns; close-to-close without delay."""
    price = F.col("open") if delay >= 1 else F.col("close")
    return panel.withColumn("ret", over(F.lead(price).over(ts.series()), price) - 1)


def daily_pnl(held: DataFrame, rules: Rules) -> DataFrame:
    """ts, gross, turnover, cost, pnl, longs, shorts: entries from missing are free, as both sides of a change must exist."""
    book = held.withColumn("position", F.col("weight") * rules.booksize)
    book = book.withColumn("change", F.abs(F.col("position") - F.lag("position").over(ts.series())))
    made = book.groupBy("ts").agg(
        F.coalesce(F.sum(F.col("position") * F.col("ret")), F.lit(0.0)).alias("gross"),
        F.coalesce(F.sum("change"), F.lit(0.0)).alias("traded"),
        F.sum((F.col("weight") > 0).cast("int")).alias("longs"),
        F.sum((F.col("weight") < 0).cast("int")).alias("shorts"),
    )
    cost = F.col("traded") * rules.fees_bps / 1e4
    return made.select("ts", "gross", (F.col("traded") / rules.booksize).alias("turnover"), cost.alias("cost"),
                       (F.col("gross") - cost).alias("pnl"), "longs", "shorts")


def metrics(pnl: DataFrame, rules: Rules, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: return, Sharpe, turnover, fitness, drawdown and share of winning bars.

    ``pnl`` has one row per key and time; the cumulative sum walks each key's series.
    """
    order = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    path = pnl.withColumn("total", F.sum("pnl").over(order))
    path = path.withColumn("below", F.col("total") - F.max("total").over(order))
    base = rules.booksize / 2
    made = path.groupBy(*keys).agg(
        F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"), F.sum("pnl").alias("pnl"), F.avg("turnover").alias("turnover"),
        F.min("below").alias("d"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_share"), F.count("*").alias("bars"),
    )
    year = rules.bars_per_year
    sharpe = over(F.col("m"), F.col("s")) * math.sqrt(year)
    annual = F.col("m") * year / base
    fitness = sharpe * F.sqrt(F.abs(annual) / F.greatest(F.col("turnover"), F.lit(rules.turnover_floor)))
    return made.select(
        *keys, "bars", "pnl", annual.alias("annual_return"), sharpe.alias("sharpe"), "turnover",
        F.when(F.col("turnover") > 0.001, fitness).otherwise(0.0).alias("fitness"),
        (F.col("d") / rules.booksize).alias("max_drawdown"), "win_share",
    )


def simulate(panel: DataFrame, signal: str, rules: Rules, universe: str | None = None) -> DataFrame:
    """The per-time PnL of a signal."""
    return daily_pnl(positions(with_returns(panel, rules.delay), signal, rules, universe), rules)


def fee_grid(pnl: DataFrame, fees_bps: list[float], rules: Rules) -> DataFrame:
    """Metrics of one PnL series under several fees."""
    grid = pnl.withColumn("fee", F.explode(F.array(*(F.lit(float(f)) for f in fees_bps))))
    grid = grid.withColumn("pnl", F.col("gross") - F.col("turnover") * rules.booksize * F.col("fee") / 1e4)
    return metrics(grid, rules, ("fee",))


def factor_returns(signals: DataFrame, fee_bps: float = 0.0) -> DataFrame:
    """alpha, ts, r: yesterday's signal, scaled to one unit of gross weight, times today's return, less fees on trades.

    ``signals`` has alpha, ts, inst, s and ret.
    """
    line = Window.partitionBy("alpha", "inst").orderBy("ts")
    scaled = signals.withColumn("w", over(F.col("s"), F.sum(F.abs("s")).over(Window.partitionBy("alpha", "ts"))))
    held = scaled.withColumn("h", F.lag("w").over(line)).withColumn("t", F.abs(F.col("w") - F.lag("w").over(line)))
    made = held.groupBy("alpha", "ts").agg(F.sum(F.col("h") * F.col("ret")).alias("g"), F.sum("t").alias("t"))
    return made.select("alpha", "ts", (F.col("g") - F.coalesce("t", F.lit(0.0)) * fee_bps / 1e4).alias("r"))


def combine(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """(ts, inst, s): signals of several alphas summed under per-time weights (alpha, ts, w)."""
    return signals.join(weights, ["alpha", "ts"]).groupBy("ts", "inst").agg(F.sum(F.col("s") * F.col("w")).alias("s"))


def adaptive_weights(returns: DataFrame, lookback: int = 20) -> DataFrame:
    """(alpha, ts, w): positive rolling mean returns of the bars before, scaled to one; equal where none is positive."""
    past = Window.partitionBy("alpha").orderBy("ts").rowsBetween(-lookback, -1)
    made = returns.withColumn("m", F.greatest(F.coalesce(F.avg("r").over(past), F.lit(0.0)), F.lit(0.0)))
    each = Window.partitionBy("ts")
    total = F.sum("m").over(each)
    return made.select("alpha", "ts", F.when(total > 0, F.col("m") / F.when(total > 0, total)).otherwise(1 / F.count("*").over(each)).alias("w"))


def inverse_vol_weights(returns: DataFrame, lookback: int = 20) -> DataFrame:
    """(alpha, ts, w): inverse rolling deviation of the bars before, scaled to one."""
    past = Window.partitionBy("alpha").orderBy("ts").rowsBetween(-lookback, -1)
    made = returns.withColumn("v", F.when(F.count("r").over(past) >= 2, F.stddev_samp("r").over(past)))
    made = made.withColumn("i", over(F.lit(1.0), F.col("v")))
    return made.select("alpha", "ts", over(F.col("i"), F.sum("i").over(Window.partitionBy("ts"))).alias("w"))


def target_trades(target: DataFrame, current: DataFrame, price: str = "close") -> DataFrame:
    """inst, shares: whole-share trades from current to target dollars, zero trades left out; halves go to even."""
    want = target.select("inst", F.bround(F.col("dollars") / F.col(price), 0).cast("long").alias("want"))
    both = want.join(current.select("inst", "held"), "inst", "full")
    shares = F.coalesce("want", F.lit(0)) - F.coalesce("held", F.lit(0))
    return both.select("inst", shares.alias("shares")).where(F.col("shares") != 0)


def commission(shares: Column, price: Column, per_share: float = 0.0035, least: float = 0.35, most: float = 0.01) -> Column:
    """Per-share commission of an order, at least ``least`` and at most the share ``most`` of its value."""
    value = F.abs(shares) * price
    return F.least(F.greatest(F.abs(shares) * per_share, F.lit(least)), value * most)


#: Monthly shares up to which a rate per share holds, and the fees on exchange volume and on sales.
TIERS = [(300_000, 0.0035), (3_000_000, 0.0020), (20_000_000, 0.0015), (100_000_000, 0.0010)]
LAST_TIER_RATE = 0.0005
EXCHANGE_FEE, SALE_FEE, SHARE_SALE_FEE, SHARE_SALE_CAP = 0.0003, 0.0000278, 0.000145, 7.27


def tiered_commission(shares: Column, price: Column, monthly: Column, least: float = 0.35, most: float = 0.01) -> Column:
    """Commission at the rate of the month's volume so far: at most a share of the value, but never below ``least``."""
    rate = F.lit(LAST_TIER_RATE)
    for volume, own in reversed(TIERS):
        rate = F.when(monthly <= volume, F.lit(own)).otherwise(rate)
    fee = F.greatest(F.lit(least), F.least(shares * rate, most * (shares * price)))
    return F.when((shares > 0) & (price > 0), fee).otherwise(0.0)


def regulatory_fees(shares: Column, price: Column, sells: Column) -> Column:
    """Exchange fee on both sides; on sales also a fee on the value and a capped one on the shares."""
    sale = shares * price * SALE_FEE + F.least(shares * SHARE_SALE_FEE, F.lit(SHARE_SALE_CAP))
    return F.when((shares > 0) & (price > 0), shares * EXCHANGE_FEE + F.when(sells, sale).otherwise(0.0)).otherwise(0.0)
