"""Choice of alphas inside walk-forward folds.

A fold chooses at bar ``t`` from the bars before it: Sharpe ratios over a training and a validation part, then the best
first, each only if its signal is not too close to those already chosen.  Time is cut into blocks that divide all parts;
moments are summed once per block and added up to every fold, so bars are read once however many folds overlap.  The
choice itself is one small group per fold, of the alphas that pass and their pairs.

``signals`` has alpha, ts, inst, s and ret, the return of the bar.  A missing signal or return counts for nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.elementwise import over
from pelagos.plans import backtest as bt
from pelagos.scratch import written

#: Cells of one group of instruments while pairs of signals are summed.
GROUP_CELLS = 1 << 22


@dataclass(frozen=True)
class Folds:
    """Lengths in bars.  The first fold chooses at bar ``warmup + train + val``, the next ones every ``step`` bars."""

    train: int
    val: int
    step: int
    warmup: int = 0
    closeness: int = 48  # bars before the choice over which signals are compared
    most_corr: float = 0.7
    most: int = 10
    min_train: float = 0.0
    min_val: float = 0.0
    train_weight: float = 0.5
    val_weight: float = 0.5
    bars_per_year: int = 252
    least_bars: int = 30
    least_names: int = 10

    @property
    def block(self) -> int:
        """Longest block that divides every part."""
        return math.gcd(self.train, self.val, self.step, self.warmup, self.closeness)


def neutral_returns(signals: DataFrame) -> DataFrame:
    """(alpha, ts, r): returns of yesterday's signals, without their mean over instruments and scaled to one."""
    mean = F.avg("s").over(Window.partitionBy("alpha", "ts"))
    return bt.factor_returns(signals.select("alpha", "ts", "inst", (F.col("s") - mean).alias("s"), "ret"))


def signal_correlations(signals: DataFrame, least: int = 10) -> DataFrame:
    """(ts, a, b, corr) for a < b: correlation over the instruments that have both signals, at least ``least`` of them.

    The instruments of a time are dealt over groups of bounded size, each of which sums its products once for all pairs.
    """
    rows = signals.where(F.col("s").isNotNull()).select("ts", "inst", "alpha", F.col("s").cast("double").alias("s"))
    names = [r[0] for r in rows.select("alpha").distinct().limit(2001).collect()]
    if len(names) > 2000:
        raise ValueError("more than 2000 alphas; choose before")
    names.sort()
    buckets = max(1, rows.select("inst").distinct().count() * len(names) // GROUP_CELLS)
    pairs = list(combinations(range(len(names)), 2))
    left, right = (np.array([p[i] for p in pairs], int) for i in (0, 1))

    def products(key: tuple, table: pa.Table) -> pa.Table:
        inst = table["inst"].combine_chunks().dictionary_encode()
        x = np.full((len(inst.dictionary), len(names)), np.nan)
        at = {n: i for i, n in enumerate(names)}
        x[np.asarray(inst.indices), [at[a] for a in table["alpha"].to_pylist()]] = table["s"].to_numpy()
        there = (~np.isnan(x)).astype(float)
        x = np.nan_to_num(x)
        sums = {"n": there.T @ there, "x": x.T @ there, "y": there.T @ x, "xx": (x * x).T @ there, "yy": there.T @ (x * x), "xy": x.T @ x}
        ts = pa.array([key[0].as_py()] * len(pairs), table.schema.field("ts").type)
        made = {"ts": ts, "a": pa.array([names[i] for i in left]), "b": pa.array([names[i] for i in right])}
        return pa.table(made | {k: v[left, right] for k, v in sums.items()})

    kind, name = rows.schema["ts"].dataType.simpleString(), rows.schema["alpha"].dataType.simpleString()
    dealt = rows.groupBy("ts", F.pmod(F.xxhash64("inst"), F.lit(buckets)).alias("bucket"))
    sums = ["n", "x", "y", "xx", "yy", "xy"]
    made = dealt.applyInArrow(products, f"ts {kind}, a {name}, b {name}, " + ", ".join(f"{s} double" for s in sums))
    made = made.groupBy("ts", "a", "b").agg(*(F.sum(s).alias(s) for s in sums)).where(F.col("n") >= least)
    c = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / F.col("n")
    vx, vy = c("x", "x", "xx"), c("y", "y", "yy")
    flat = lambda v, square: F.when(v > 1e-12 * F.col(square), v)  # noqa: E731  a constant signal has no correlation
    return made.select("ts", "a", "b", over(c("x", "y", "xy"), F.sqrt(flat(vx, "xx") * flat(vy, "yy"))).alias("corr"))


def _in_folds(blocks: DataFrame, folds: Folds, last_bar: int, before: int) -> DataFrame:
    """``blocks`` once per fold whose choice comes within ``before`` bars after the block, with age, bars to the choice."""
    first, size = folds.warmup + folds.train + folds.val, folds.block
    begin = F.col("block") * size
    low = F.greatest(F.ceil((begin + size - first) / folds.step), F.lit(0))
    high = F.least(F.floor((begin + before - first) / folds.step), F.lit((last_bar - first) // folds.step))
    made = blocks.where(low <= high).withColumn("fold", F.explode(F.sequence(low, high)))
    return made.withColumn("age", F.lit(first) + F.col("fold") * folds.step - begin)


def _times(signals: DataFrame) -> DataFrame:
    return signals.select("ts").distinct().select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("t"))


def fold_scores(returns: DataFrame, times: DataFrame, folds: Folds, last_bar: int) -> DataFrame:
    """fold, alpha, train and val (Sharpe ratios) of every alpha in every fold.

    The first bar of a part earns nothing there, as the part begins without a position.
    """
    rows = returns.join(times, "ts").withColumn("block", F.floor(F.col("t") / folds.block)).withColumn("r", F.coalesce("r", F.lit(0.0)))
    begins = F.col("t") % folds.block == 0
    blocks = rows.groupBy("alpha", "block").agg(
        F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.count("*").alias("n"), F.max(F.when(begins, F.col("r"))).alias("first")
    )
    each = _in_folds(blocks, folds, last_bar, folds.train + folds.val)

    def sharpe(inside: Column, begin: int) -> Column:
        lost = F.coalesce(F.sum(F.when(F.col("age") == begin, F.col("first"))), F.lit(0.0))
        lost2 = F.coalesce(F.sum(F.when(F.col("age") == begin, F.col("first") * F.col("first"))), F.lit(0.0))
        n = F.sum(F.when(inside, F.col("n")))
        mean = (F.sum(F.when(inside, F.col("s"))) - lost) / n
        deviation = F.sqrt(F.greatest(F.sum(F.when(inside, F.col("q"))) - lost2 - n * mean * mean, F.lit(0.0)) / F.when(n > 1, n - 1))
        enough = (n >= folds.least_bars) & (deviation > 1e-12)
        return F.when(enough, mean / deviation * math.sqrt(folds.bars_per_year))

    return each.groupBy("fold", "alpha").agg(
        sharpe(F.col("age") > folds.val, folds.train + folds.val).alias("train"), sharpe(F.col("age") <= folds.val, folds.val).alias("val")
    )


def choose(signals: DataFrame, folds: Folds) -> DataFrame:
    """fold, ts (of the choice), place (from 1), alpha, train, val: the alphas that each fold chooses, in its order.

    An alpha passes with both Sharpe ratios above their least values; ties go by name.  Closeness is the mean size of the
    correlation of two signals; pairs that were never measured count as equal.
    """
    signals = signals.select("alpha", "ts", "inst", "s", "ret")
    times = written(_times(signals), "times")
    last_bar = times.count() - 1
    passed = fold_scores(neutral_returns(signals), times, folds, last_bar).where((F.col("train") > folds.min_train) & (F.col("val") > folds.min_val))
    score = F.col("train") * folds.train_weight + F.col("val") * folds.val_weight
    passed = written(passed.withColumn("score", score), "passed")
    corr = signal_correlations(signals, folds.least_names).join(times, "ts").withColumn("block", F.floor(F.col("t") / folds.block))
    blocks = corr.groupBy("a", "b", "block").agg(F.sum(F.abs("corr")).alias("s"), F.count("corr").alias("n"))
    pairs = _in_folds(blocks, folds, last_bar, folds.closeness).groupBy("fold", "a", "b").agg(over(F.sum("s"), F.sum("n")).alias("corr"))
    for side in ("a", "b"):  # only pairs of alphas that pass
        pairs = pairs.join(passed.select("fold", F.col("alpha").alias(side)), ["fold", side], "left_semi")

    def greedy(own: pd.DataFrame, close: pd.DataFrame) -> pd.DataFrame:
        corr = {(a, b): c for a, b, c in zip(close["a"], close["b"], close["corr"], strict=True)}
        chosen = []
        for r in own.sort_values(["score", "alpha"], ascending=[False, True]).itertuples():
            if len(chosen) < folds.most and all(abs(corr.get((min(r.alpha, c.alpha), max(r.alpha, c.alpha)), 1.0)) <= folds.most_corr for c in chosen):
                chosen.append(r)
        rows = [(c.fold, i + 1, c.alpha, c.train, c.val) for i, c in enumerate(chosen)]
        return pd.DataFrame(rows, columns=["fold", "place", "alpha", "train", "val"])

    kind = signals.schema["alpha"].dataType.simpleString()
    made = passed.groupBy("fold").cogroup(pairs.groupBy("fold")).applyInPandas(greedy, f"fold long, place int, alpha {kind}, train double, val double")
    at = F.col("t") - (folds.warmup + folds.train + folds.val)
    begins = times.where((at >= 0) & (at % folds.step == 0)).select((at / folds.step).cast("long").alias("fold"), "ts")
    return made.join(begins, "fold").select("fold", "ts", "place", "alpha", "train", "val")


def fold_returns(chosen: DataFrame, signals: DataFrame, folds: Folds) -> DataFrame:
    """fold, ts, r and names: the mean return of a fold's alphas over the ``step`` bars that follow its choice.

    Positions begin with the bar of the choice, so no bar before it is held.
    """
    times = _times(signals)
    at = F.col("t") - (folds.warmup + folds.train + folds.val)
    rows = neutral_returns(signals).join(times.where(at >= 0).select("ts", F.floor(at / folds.step).alias("fold"), (at % folds.step).alias("bar")), "ts")
    held = rows.where("bar > 0").join(chosen.select("fold", "alpha"), ["fold", "alpha"])
    return held.groupBy("fold", "ts").agg(F.avg(F.coalesce("r", F.lit(0.0))).alias("r"), F.count("*").alias("names"))
