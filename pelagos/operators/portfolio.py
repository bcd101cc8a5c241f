"""Weights over a handful of alphas: covariance by Spark, a K by K solve on the driver, re-weighting by Spark.

K is the number of alphas (tens to hundreds); every alpha's series stays in Spark.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.operators.optimise import Programme, solve


def moments(returns: DataFrame, most: int = 1000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names, means and sample covariance of (alpha, ts, r), over each pair's common times."""
    clean = returns.where(F.col("r").isNotNull())
    means = {r["alpha"]: r["m"] for r in clean.groupBy("alpha").agg(F.avg("r").alias("m")).limit(most + 1).collect()}
    if len(means) > most:
        raise ValueError(f"more than {most} alphas; select before solving")
    a = clean.select("ts", F.col("alpha").alias("a"), F.col("r").alias("x"))
    b = clean.select("ts", F.col("alpha").alias("b"), F.col("r").alias("y"))
    pairs = a.join(b, "ts").where("a <= b").groupBy("a", "b").agg(F.covar_samp("x", "y").alias("c")).collect()
    names = sorted(means)
    at = {n: i for i, n in enumerate(names)}
    cov = np.zeros((len(names), len(names)))
    for r in pairs:
        cov[at[r["a"]], at[r["b"]]] = cov[at[r["b"]], at[r["a"]]] = r["c"] or 0.0
    return names, np.array([means[n] for n in names]), cov


def _simplex(w: np.ndarray) -> np.ndarray:
    w = np.clip(w, 0, None)
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))


def max_sharpe(mean: np.ndarray, cov: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    return _simplex(np.linalg.solve(cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-18 * np.eye(len(cov)), mean))


def min_variance(cov: np.ndarray, ridge: float = 1e-6) -> np.ndarray:
    return max_sharpe(np.ones(len(cov)), cov, ridge)


def risk_parity(cov: np.ndarray, steps: int = 500) -> np.ndarray:
    """Equal risk contributions by fixed-point iteration."""
    w = 1 / np.sqrt(np.clip(np.diag(cov), 1e-18, None))
    for _ in range(steps):
        w = np.sqrt(w / np.clip(cov @ w, 1e-18, None))
    return w / w.sum()


def mean_variance(mean: np.ndarray, cov: np.ndarray, aversion: float = 1.0, previous: np.ndarray | None = None, cost: float = 0.0) -> np.ndarray:
    """Maximises mean less variance less proportional trading cost over the simplex."""
    values, vectors = np.linalg.eigh(cov)
    x = np.sqrt(np.clip(values, 0, None))[:, None] * vectors.T
    previous = np.full(len(mean), 1 / len(mean)) if previous is None else previous
    return solve(mean, np.zeros(len(mean)), x, Programme(aversion=aversion, cost=cost), previous)[0]


def project_simplex(v: np.ndarray) -> np.ndarray:
    """Nearest point with entries of at least zero that sum to one."""
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.clip(v - over[np.flatnonzero(u > over)[-1]], 0, None)


def shrunk(cov: np.ndarray, weight: float) -> np.ndarray:
    """Towards the diagonal of mean variance."""
    return (1 - weight) * cov + weight * np.trace(cov) / len(cov) * np.eye(len(cov))


def select_orthogonal(scores: dict[str, float], corr: dict[tuple[str, str], float], cutoff: float, most: int) -> list[str]:
    """Best first, each kept if its correlation with all kept is at most ``cutoff`` in size."""
    kept: list[str] = []
    for name in sorted(scores, key=lambda n: (-scores[n], n)):
        if len(kept) < most and all(abs(corr.get((min(name, k), max(name, k)), 0.0)) <= cutoff for k in kept):
            kept.append(name)
    return kept


def probabilistic_sharpe(sharpe: float, n: int, skew: float = 0.0, excess: float = 0.0, against: float = 0.0) -> float:
    """Probability that the true per-bar Sharpe ratio exceeds ``against``; one half below 20 bars."""
    if n < 20:
        return 0.5
    spread = math.sqrt(max(1e-12, (1 - skew * sharpe + (excess + 2) / 4 * sharpe * sharpe) / (n - 1)))
    return NormalDist().cdf((sharpe - against) / spread)


def expected_max_sharpe(trials: int, deviation: float) -> float:
    """Expected best of ``trials`` independent Sharpe ratios of mean zero."""
    if trials < 2:
        return 0.0
    unit, euler = NormalDist(), 0.5772156649015329
    return deviation * ((1 - euler) * unit.inv_cdf(1 - 1 / trials) + euler * unit.inv_cdf(1 - 1 / (trials * math.e)))
