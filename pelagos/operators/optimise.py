"""Weights by quadratic programmes with trading cost, one programme per rebalance.

    minimise  aversion / 2 w'Sw - mean'w + cost |w - previous|   with  total of w, bounds and further limits

Moments come from a rolling window of returns; the covariance is a diagonal and a product of the window's rows with
themselves, so a step of the solver inverts the shorter side only.  The solver splits the smooth part from the limits
and alternates until what the two parts disagree about is below a stated residual; then the limits that hold are kept
fixed and the rest is solved exactly.

Rebalances are independent of each other while ``previous`` is given, and are dealt over tasks by spans of time.  Where a
rebalance starts from the one before, one task walks the rebalances of a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pelagos.scratch import written

#: Names of one programme; more of them need a choice before.
MOST_NAMES = 5000


@dataclass(frozen=True)
class Programme:
    """total: sum of the weights; low, high: bounds of each; gross and turnover: limits of |w| and |w - previous|.

    shrink: share of the diagonal in the covariance (0: none); ridge is added to its diagonal.
    """

    aversion: float = 1.0
    cost: float = 0.0
    total: float | None = 1.0
    low: float = 0.0
    high: float = 1.0
    gross: float | None = None
    turnover: float | None = None
    shrink: float = 0.0
    ridge: float = 0.0
    residual: float = 1e-9
    steps: int = 20_000


def _ball(v: np.ndarray, radius: float) -> np.ndarray:
    """Nearest point whose sizes sum to ``radius`` at most."""
    size = np.abs(v)
    if size.sum() <= radius:
        return v
    u = np.sort(size)[::-1]
    over = (np.cumsum(u) - radius) / np.arange(1, len(v) + 1)
    return np.sign(v) * np.clip(size - over[np.flatnonzero(u > over)[-1]], 0, None)


class _Smooth:
    """minimise w'(D + X'X)w / 2 - b'w with E w = d, for changing b and a changing multiple of the identity added to D."""

    def __init__(self, diagonal: np.ndarray, x: np.ndarray, e: np.ndarray, d: np.ndarray):
        self.diagonal, self.x, self.e, self.d = diagonal, x, e, d

    def prepare(self, more: float) -> None:
        self.inverse = 1 / (self.diagonal + more)
        self.wide = len(self.x) < len(self.diagonal)
        xd = self.x * self.inverse
        if self.wide:
            self.small = np.linalg.inv(np.eye(len(self.x)) + xd @ self.x.T)
            self.xd = xd
        else:
            self.full = np.linalg.inv(np.diag(self.diagonal + more) + self.x.T @ self.x)
        if len(self.e):
            self.solved_e = np.stack([self._apply(row) for row in self.e])
            self.schur = np.linalg.pinv(self.e @ self.solved_e.T)

    def _apply(self, v: np.ndarray) -> np.ndarray:
        if not self.wide:
            return self.full @ v
        return self.inverse * v - self.xd.T @ (self.small @ (self.xd @ v))

    def solve(self, b: np.ndarray) -> np.ndarray:
        w = self._apply(b)
        return w - self.solved_e.T @ (self.schur @ (self.e @ w - self.d)) if len(self.e) else w


def solve(mean: np.ndarray, diagonal: np.ndarray, x: np.ndarray, rules: Programme, previous: np.ndarray, neutral: np.ndarray | None = None) -> tuple[np.ndarray, float, int]:
    """Weights, the residual that was reached, and steps.  S = diag(diagonal) + x'x; ``neutral`` rows must have w-product 0.

    The residual is the largest disagreement of the parts, relative to the size of the weights.
    """
    n = len(mean)
    rows = ([np.ones(n)] if rules.total is not None else []) + ([] if neutral is None else list(neutral))
    e = np.array(rows).reshape(len(rows), n)
    d = np.array(([rules.total] if rules.total is not None else []) + [0.0] * (len(rows) - (rules.total is not None)))
    smooth = _Smooth(rules.aversion * diagonal, np.sqrt(rules.aversion) * x, e, d)

    def near(v: np.ndarray, step: float) -> np.ndarray:
        move = v - previous
        return np.clip(previous + np.sign(move) * np.clip(np.abs(move) - rules.cost / step, 0, None), rules.low, rules.high)

    limits = [near]
    if rules.gross is not None:
        limits.append(lambda v, step: _ball(v, rules.gross))
    if rules.turnover is not None:
        limits.append(lambda v, step: previous + _ball(v - previous, rules.turnover))
    m, scale = len(limits), max(float(np.mean(rules.aversion * (diagonal + np.sum(x * x, 0)))), 1e-12)
    step = scale
    smooth.prepare(m * step)
    z, u = np.tile(np.clip(previous, rules.low, rules.high), (m, 1)), np.zeros((m, n))
    gap = np.inf
    for k in range(1, rules.steps + 1):
        w = smooth.solve(mean + step * (z - u).sum(0))
        mixed = 1.6 * w + (1 - 1.6) * z
        old, z = z, np.stack([f(v, step) for f, v in zip(limits, mixed + u, strict=True)])
        u += mixed - z
        apart, moved = np.abs(w - z).max(), np.abs(z - old).max()
        gap = max(apart, moved) / max(1e-12, float(np.abs(w).max()))
        if gap < rules.residual:
            break
        if k % 50 == 0 and (apart > 5 * moved or moved > 5 * apart):  # both should fall alike
            factor = 2.0 if apart > moved else 0.5
            step, u = step * factor, u / factor
            smooth.prepare(m * step)
    best = z[0]
    if m == 1:
        exact = _polished(best, mean, diagonal, x, rules, previous, e, d)
        best = best if exact is None else exact
    return best, float(gap), k


def _polished(w: np.ndarray, mean: np.ndarray, diagonal: np.ndarray, x: np.ndarray, rules: Programme, previous: np.ndarray, e: np.ndarray, d: np.ndarray) -> np.ndarray | None:
    """The exact solution if the bounds and kinks at which ``w`` stands are the right ones."""
    close = 1e-6 * max(1e-12, float(np.abs(w).max()))
    at_low, at_high = w <= rules.low + close, w >= rules.high - close
    stays = (np.abs(w - previous) <= close) & (rules.cost > 0)
    fixed = np.where(at_low, rules.low, np.where(at_high, rules.high, previous))
    free = ~(at_low | at_high | stays)
    k = int(free.sum())
    if not k:
        return None
    held = np.where(free, 0.0, fixed)
    s = rules.aversion * (np.diag(diagonal) + x.T @ x) if len(w) <= 500 else None
    if s is None:
        return None
    side = np.sign(w - previous) * rules.cost
    top = np.hstack([s[np.ix_(free, free)], e[:, free].T])
    bottom = np.hstack([e[:, free], np.zeros((len(e), len(e)))])
    right = np.concatenate([mean[free] - side[free] - s[np.ix_(free, ~free)] @ held[~free], d - e[:, ~free] @ held[~free]])
    found = np.linalg.lstsq(np.vstack([top, bottom]), right, rcond=None)[0]
    made = held.copy()
    made[free] = found[:k]
    inside = (made >= rules.low - 1e-9).all() and (made <= rules.high + 1e-9).all()
    kept = (np.sign(made - previous)[free] * side[free] >= -1e-15).all()
    return made if inside and kept and np.abs(made - w).max() < 100 * close else None


def window_moments(r: np.ndarray, rules: Programme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, diagonal and x of a window of returns, one row per time: S = (1 - shrink) cov + shrink diag(cov) + ridge."""
    c = r - r.mean(0)
    x = c / np.sqrt(max(1, len(r) - 1))
    return r.mean(0), rules.shrink * np.sum(x * x, 0) + rules.ridge, np.sqrt(1 - rules.shrink) * x


def _rebalances(rows: pd.DataFrame, at: list[int], lookback: int, rules: Programme, chained: bool, least: int) -> Iterator[tuple]:
    """(t, alpha, w, gap, steps) of the rebalances at the times ``at``, of rows (t, alpha, r)."""
    names = sorted(rows["alpha"].unique())
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names in one programme; choose before")
    begin = int(rows["t"].min())
    place = {a: i for i, a in enumerate(names)}
    r = np.full((max(int(rows["t"].max()), at[-1]) - begin + 1, len(names)), np.nan)
    r[rows["t"].to_numpy(int) - begin, rows["alpha"].map(place).to_numpy(int)] = rows["r"].to_numpy(float)
    before = None
    for t in at:
        own = r[max(0, t - lookback - begin) : t - begin]
        there = np.count_nonzero(~np.isnan(own), axis=0) >= least
        if not there.any():
            continue
        mean, diagonal, x = window_moments(np.nan_to_num(own[:, there]), rules)
        even = np.full(int(there.sum()), (rules.total or 0.0) / int(there.sum()))
        previous = before[there] if chained and before is not None else even
        w, gap, steps = solve(mean, diagonal, x, rules, previous)
        before = np.zeros(len(names))
        before[there] = w
        for i, v in zip(np.flatnonzero(there), w, strict=True):
            yield t, names[i], float(v), gap, steps


def rolling_weights(
    returns: DataFrame, lookback: int, every: int, rules: Programme = Programme(), keys: tuple[str, ...] = (), chained: bool = False, least: int = 2
) -> DataFrame:
    """keys, ts, alpha, w, gap and steps: a programme at every ``every``-th time over the ``lookback`` times before it.

    ``returns`` has keys, alpha, ts and r.  A missing return counts as zero; an alpha with fewer than ``least`` returns in
    a window is left out of it.  ``chained`` measures cost and turnover from the rebalance before, else from equal
    weights; it walks each key's rebalances in one task.  Fewer times than the lookback have no rows.
    """
    times = returns.select(*keys, "ts").distinct()
    times = times.withColumn("t", F.row_number().over(Window.partitionBy(*keys).orderBy("ts")) - 1)
    times = written(times, "times")
    rows = returns.where(F.col("r").isNotNull()).join(times, [*keys, "ts"]).select(*keys, "alpha", "t", F.col("r").cast("double").alias("r"))
    rows = rows.join(times.groupBy(*keys).agg(F.count("*").alias("n")), list(keys)) if keys else rows.withColumn("n", F.lit(times.count()))
    spread = max(1, lookback // every)  # rebalances that are worked on together
    low = F.greatest(F.floor((F.col("t") - lookback) / every) + 1, F.lit(0))  # of the rebalances whose window holds t
    high = F.least(F.floor(F.col("t") / every), F.floor((F.col("n") - 1 - lookback) / every))
    span = F.lit(0).cast("long") if chained else F.explode(F.sequence(F.floor(low / spread), F.floor(high / spread)))
    dealt = rows.where(low <= high).select(*keys, "n", "alpha", "t", "r", span.alias("span"))

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        n, span = int(pdf["n"].iloc[0]), int(pdf["span"].iloc[0])
        last = (n - 1 - lookback) // every
        own = range(last + 1) if chained else range(span * spread, min((span + 1) * spread, last + 1))
        found = list(_rebalances(pdf, [lookback + i * every for i in own], lookback, rules, chained, least))
        made = pd.DataFrame(found, columns=["t", "alpha", "w", "gap", "steps"])
        return made.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "t", "alpha", "w", "gap", "steps"]]

    kinds = "".join(f"{k} {returns.schema[k].dataType.simpleString()}, " for k in keys)
    schema = f"{kinds}t int, alpha {returns.schema['alpha'].dataType.simpleString()}, w double, gap double, steps int"
    found = dealt.groupBy(*keys, "span").applyInPandas(walked, schema)
    return found.join(times, [*keys, "t"]).select(*keys, "ts", "alpha", "w", "gap", "steps")


def optimality_gap(weights: DataFrame, returns: DataFrame, lookback: int, rules: Programme) -> DataFrame:
    """ts and gap: how far the weights of a rebalance are from optimal, by their conditions, relative to the largest mean.

    ``weights`` has ts, alpha, w and previous.  Moving weight from one alpha to another may not pay: the best gain of
    more weight is at most the least loss of less weight.  The covariance of an alpha with the whole portfolio is all the
    conditions need, so no pair of alphas is formed.  Without limits of gross weight or turnover.
    """
    times = returns.select("ts").distinct().withColumn("t", F.row_number().over(Window.orderBy("ts")) - 1)
    at = weights.join(times, "ts").select("t", "alpha", "w", "previous").withColumn("e", F.col("t"))
    each = at.withColumn("t", F.explode(F.sequence(F.col("e") - lookback, F.col("e") - 1)))
    rows = each.join(returns.join(times, "ts").select("t", "alpha", "r"), ["t", "alpha"], "left").fillna(0.0, ["r"])
    book = rows.groupBy("e", "t").agg(F.sum(F.col("w") * F.col("r")).alias("p"))
    own = rows.join(book, ["e", "t"]).groupBy("e", "alpha", "w", "previous").agg(
        F.avg("r").alias("mean"), F.covar_samp("r", "p").alias("c"), F.var_samp("r").alias("v")
    )
    own_risk = (rules.shrink * F.col("v") + rules.ridge) * F.col("w")
    slope = F.col("mean") - rules.aversion * ((1 - rules.shrink) * F.col("c") + own_risk)
    near = 1e-7
    more = slope - F.when(F.col("w") >= F.col("previous") - near, rules.cost).otherwise(-rules.cost)
    less = slope - F.when(F.col("w") > F.col("previous") + near, rules.cost).otherwise(-rules.cost)
    made = own.groupBy("e").agg(
        F.max(F.when(F.col("w") < rules.high - near, more)).alias("more"),
        F.min(F.when(F.col("w") > rules.low + near, less)).alias("less"),
        F.max(F.abs("mean")).alias("size"),
    )
    gap = F.greatest(F.col("more") - F.col("less"), F.lit(0.0)) / F.greatest("size", F.lit(1e-12))
    return made.join(times.withColumnRenamed("t", "e"), "e").select("ts", F.coalesce(gap, F.lit(0.0)).alias("gap"))
