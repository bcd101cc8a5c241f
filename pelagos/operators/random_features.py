"""Ridge regressions of forward returns on random features of a panel, refitted along time.

A row's characteristics, standardised within its time, are projected on fixed random directions; sines and cosines of
the projections are its features.  The normal equations are sums over rows, so they are made block of time by block of
time in groups of bounded size and added up; a refit is a difference of running sums over the blocks of its window.
Refits are solved in parallel by spans of time, and predictions are made where the rows are, with the weights in force.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.operators.factors import time_index
from pelagos.scratch import written

#: Values of one group of rows, features included.
GROUP_VALUES = 1 << 24
#: Values of the blocks that one task of solving holds.
SPAN_VALUES = 1 << 24


@dataclass(frozen=True)
class Fit:
    """features: directions, twice as many features; horizon: bars ahead; a refit at bar t uses the bars from t - window
    to t - horizon - 1 as far as there are any, and comes every ``every`` bars from ``warmup`` on.  ``most`` clips the target, per bar ahead."""

    features: int = 50
    horizon: int = 1
    window: int = 360
    every: int = 42
    warmup: int = 360
    ridge: float = 500.0
    most: float = 0.05
    least_rows: int = 100
    least_names: int = 5
    seed: int = 42

    def __post_init__(self):
        if min(self.warmup, self.window) <= self.horizon:
            raise ValueError("window and warm-up are longer than the horizon")

    @property
    def block(self) -> int:
        """Bars of a block: refits begin and end at block borders."""
        return math.gcd(self.every, self.window - self.horizon)


def directions(fields: int, features: int, seed: int) -> np.ndarray:
    """Normal directions of variance 1 / fields, one per row; the same for the same arguments."""
    return np.random.default_rng(seed).normal(0, 1 / math.sqrt(fields), (features, fields))


def random_features(x: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    at = x @ gamma.T
    return np.hstack([np.sin(at), np.cos(at)]) / math.sqrt(len(gamma))


def standardised(panel: DataFrame, fields: list[str], least: int = 5) -> DataFrame:
    """``panel`` with s0, s1, ...: fields in deviations of their time, at most 5 in size; zero where missing, without
    spread or with fewer than ``least`` values."""
    each = Window.partitionBy("ts")
    made = panel
    for i, f in enumerate(fields):
        x, spread = F.col(f).cast("double"), F.stddev_pop(F.col(f)).over(each)
        z = F.when((spread >= 1e-10) & (F.count(f).over(each) >= least), (x - F.avg(f).over(each)) / spread)
        made = made.withColumn(f"s{i}", F.coalesce(F.least(F.greatest(z, F.when(z.isNotNull(), -5.0)), F.when(z.isNotNull(), F.lit(5.0))), F.lit(0.0)))
    return made


def _target(ret: str, horizon: int):
    """Sum of the next ``horizon`` returns, a missing one being zero; missing where they are not all there yet."""
    line = Window.partitionBy("inst").orderBy("ts")
    later = [F.lead(F.coalesce(F.col(ret).cast("double"), F.lit(0.0)), k).over(line) for k in range(1, horizon + 1)]
    return sum(later[1:], later[0])


def rff_weights(panel: DataFrame, fields: list[str], ret: str, fit: Fit) -> DataFrame:
    """e (bar of the refit), rows and beta of every refit; ``panel`` has t, s0, s1, ... besides inst, ts and ret.

    A refit with fewer than ``least_rows`` rows has no weights.
    """
    gamma, width = directions(len(fields), fit.features, fit.seed), 2 * fit.features
    most = fit.most * fit.horizon
    last = panel.agg(F.max("t")).first()[0]
    if last is None or last < fit.warmup:
        return panel.sparkSession.createDataFrame([], "e int, rows double, beta array<double>")
    names = [f"s{i}" for i in range(len(fields))]
    shift = (fit.warmup - fit.horizon) % fit.block  # block borders fall on the last bars of refits
    rows = panel.withColumn("y", _target(ret, fit.horizon)).where("y IS NOT NULL")
    rows = rows.select("inst", F.floor((F.col("t") - shift) / fit.block).alias("block"), "y", *names)
    most_rows = max(1, GROUP_VALUES // (width + len(fields)))
    per_time = panel.groupBy("t").count().agg(F.max("count")).first()[0]
    buckets = max(1, math.ceil(per_time * fit.block / most_rows))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("inst"), F.lit(buckets)).cast("int"))

    def equations(key: tuple, table: pa.Table) -> pa.Table:
        x = np.column_stack([table[n].to_numpy() for n in names])
        z = random_features(x, gamma)
        y = np.clip(table["y"].to_numpy(), -most, most)
        sums = np.concatenate([[len(y)], z.T @ y, (z.T @ z).ravel()])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([sums], pa.list_(pa.float64()))})

    blocks = written(dealt.groupBy("block", "bucket").applyInArrow(equations, "block long, sums array<double>"), "equations")
    long = (fit.window - fit.horizon) // fit.block  # blocks of a window
    step = fit.every // fit.block
    first = (fit.warmup - fit.horizon - shift) // fit.block  # the first refit uses the blocks before this one
    refits = (last - fit.warmup) // fit.every + 1
    spread = max(1, SPAN_VALUES // (width * width) // max(1, step) - long // step)
    low = F.greatest(F.floor((F.col("block") - first) / step) + 1, F.lit(0))
    high = F.least(F.floor((F.col("block") - first + long) / step), F.lit(refits - 1))
    spans = blocks.where(low <= high).withColumn("span", F.explode(F.sequence(F.floor(low / spread), F.floor(high / spread))))

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.groupby("block")["sums"].apply(lambda s: np.sum(np.stack(s.to_list()), axis=0))
        begin, made = int(own.index.min()), []
        so_far = {begin: np.zeros(1 + width + width * width)}
        for b in range(begin, int(own.index.max()) + 1):
            so_far[b + 1] = so_far[b] + own[b] if b in own.index else so_far[b]
        end, span = int(own.index.max()) + 1, int(pdf["span"].iloc[0])
        for j in range(span * spread, min((span + 1) * spread, refits)):
            upto = first + j * step
            sums = so_far[max(min(upto, end), begin)] - so_far[max(min(upto - long, end), begin)]
            if sums[0] >= fit.least_rows:
                a = sums[1 + width :].reshape(width, width) + fit.ridge * np.eye(width)
                made.append((fit.warmup + j * fit.every, float(sums[0]), np.linalg.solve(a, sums[1 : 1 + width])))
        return pd.DataFrame(made, columns=["e", "rows", "beta"])

    return written(spans.groupBy("span").applyInPandas(solved, "e int, rows double, beta array<double>"), "betas")


def rff_predict(panel: DataFrame, fields: list[str], ret: str, fit: Fit = Fit(), out: str = "predicted") -> DataFrame:
    """``panel`` with the forecast of the next ``horizon`` returns by the last refit up to the row's bar.

    Missing before the first refit; a refit without enough rows leaves the weights of the one before in force.
    """
    gamma = directions(len(fields), fit.features, fit.seed)
    names = [f"s{i}" for i in range(len(fields))]
    times = time_index(panel)
    rows = written(standardised(panel, fields, fit.least_names).join(times, "ts"), "features")
    betas = rff_weights(rows, fields, ret, fit)
    # the refit in force at each bar, one row per bar
    in_force = F.last(F.when(F.col("beta").isNotNull(), F.col("e")), ignorenulls=True).over(Window.orderBy("t"))
    at = times.join(betas, times["t"] == betas["e"], "left").select("t", in_force.alias("e"))
    rows = rows.join(at, "t")
    per_refit = rows.groupBy("e").count().agg(F.max("count")).first()[0] or 1
    buckets = max(1, math.ceil(per_refit * (len(fields) + 2 * fit.features) / GROUP_VALUES))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("inst"), F.lit(buckets)).cast("int"))
    weights = betas.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    columns = [*panel.columns]

    def predict(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows and left.num_rows:
            z = random_features(np.column_stack([left[n].to_numpy() for n in names]), gamma)
            made = pa.array(z @ np.asarray(right["beta"][0].as_py()))
        else:
            made = pa.nulls(left.num_rows, pa.float64())
        return left.select(columns).append_column(out, made)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in panel.schema.fields)
    return rows.groupBy("e", "bucket").cogroup(weights.groupBy("e", "bucket")).applyInArrow(predict, f"{schema}, `{out}` double")
