"""Principal components of a panel, whole and in windows, and what follows: residuals, factor variances, hedged weights.

A window of W times by N instruments has at most W components, so only its W by W matrix of products between times is
ever built: each instrument adds its own product, summed block by block in Spark.  Its eigenvectors give the components
as weighted sums of the window's rows, so loadings come from one join by time and one grouped sum.  No matrix over
instruments exists anywhere, and N is not bounded; W is, by MOST_TIMES.

A missing value counts as zero, as does a missing row.  Components are scaled to length one; their sign is free, which
residuals, variances and hedges do not see.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagos.scratch import written

#: Largest window, whose matrix is solved in one task.
MOST_TIMES = 4096
#: Values of one group of instruments while their products are summed.
GROUP_VALUES = 1 << 21
_FLAT = 1e-8


def time_index(panel: DataFrame) -> DataFrame:
    """(ts, t): the different times of the panel, numbered from 0.  One row per time goes through one task."""
    return panel.select("ts").distinct().select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("t"))


def _window_products(x: np.ndarray, scaled: bool) -> np.ndarray:
    """Products between times of the centred (and scaled) rows of ``x``, one row per instrument."""
    z = x - x.mean(1, keepdims=True)
    if scaled:
        spread = z.std(1, keepdims=True)
        z = np.where(spread > _FLAT, z / np.where(spread > _FLAT, spread, 1), 0)
    return z.T @ z


def pca_windows(panel: DataFrame, field: str, window: int | None, factors: int, every: int = 1, scaled: bool = False) -> DataFrame:
    """Components of ``field`` over windows of ``window`` times (None: the whole panel), one every ``every`` times.

    A row per window and component: e (number of its last time), ts, k (from 1), eigenvalue (of the sum of squares),
    share (of all eigenvalues), coef (weight of each time of the window, oldest first: a component is the sum of the
    window's rows under them, divided by each instrument's deviation if ``scaled``).  Components without variance are
    left out.  A panel with fewer times than the window has no rows.
    """
    times = written(time_index(panel), "times")
    count = times.count()
    window = window or count
    if window > MOST_TIMES:
        raise ValueError(f"a window of more than {MOST_TIMES} times; choose a shorter one")
    first, spread = window - 1, max(1, window // every)  # spread: windows that are worked on together
    rows = panel.where(F.col(field).isNotNull()).join(times, "ts").select("inst", "t", F.col(field).cast("double").alias("x"))
    # the first and the last window that holds t
    low = F.greatest(F.ceil((F.col("t") - first) / every), F.lit(0))
    high = F.least(F.floor(F.col("t") / every), F.lit((count - 1 - first) // every))
    spans = F.sequence(F.floor(low / spread), F.floor(high / spread))
    buckets = max(1, rows.select("inst").distinct().count() * window * 2 // GROUP_VALUES)
    bucket = F.pmod(F.xxhash64("inst"), F.lit(buckets)).cast("int").alias("bucket")
    dealt = rows.where(low <= high).select("inst", "t", "x", bucket, F.explode(spans).alias("span"))

    def products(key: tuple, table: pa.Table) -> pa.Table:
        span = key[0].as_py()
        names = table["inst"].combine_chunks().dictionary_encode()
        begin = span * spread * every  # the first time of the first window
        ends = [e for j in range(span * spread, (span + 1) * spread) if (e := first + j * every) < count]
        x = np.zeros((len(names.dictionary), ends[-1] - begin + 1))
        x[np.asarray(names.indices), table["t"].to_numpy() - begin] = table["x"].to_numpy()
        made = [_window_products(x[:, e - first - begin : e - begin + 1], scaled).ravel() for e in ends]
        n = len(ends)
        return pa.table({"e": pa.array(ends, pa.int32()), "part": pa.array([key[1].as_py() // 16] * n, pa.int32()), "gram": pa.array(made, pa.list_(pa.float64()))})

    grams = dealt.groupBy("span", "bucket").applyInArrow(products, "e int, part int, gram array<double>")

    def total(pdf: pd.DataFrame) -> np.ndarray:
        return np.sum(np.stack(pdf["gram"].to_list()), axis=0)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"e": [pdf["e"].iloc[0]], "part": [0], "gram": [total(pdf)]})

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        g = total(pdf).reshape(window, window)
        values, vectors = np.linalg.eigh((g + g.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        whole, made = float(np.trace(g)), []
        for k in range(min(factors, window)):
            if values[k] > 1e-12 * max(whole, 1e-300):
                coef = vectors[:, k] / np.sqrt(values[k])
                made.append((int(pdf["e"].iloc[0]), k + 1, float(values[k]), float(values[k] / whole), coef - coef.mean()))
        return pd.DataFrame(made, columns=["e", "k", "eigenvalue", "share", "coef"])

    if buckets > 16:
        grams = grams.groupBy("e", "part").applyInPandas(summed, "e int, part int, gram array<double>")
    found = grams.groupBy("e").applyInPandas(solved, "e int, k int, eigenvalue double, share double, coef array<double>")
    return written(found.join(times.withColumnRenamed("t", "e"), "e"), "components")


def loadings(panel: DataFrame, field: str, components: DataFrame, scaled: bool = False) -> DataFrame:
    """(e, inst, k, share, v): the components of ``pca_windows`` by instrument, zero where an instrument does not vary."""
    rows = panel.where(F.col(field).isNotNull()).join(time_index(panel), "ts").select("inst", "t", F.col(field).cast("double").alias("x"))
    each = components.select("e", "k", "share", F.size("coef").alias("w"), F.posexplode("coef").alias("at", "a"))
    each = each.select("e", "k", "share", "w", (F.col("e") - F.col("w") + 1 + F.col("at")).alias("t"), "a")
    made = rows.join(each, "t").groupBy("e", "inst", "k", "share", "w").agg(
        F.sum(F.col("a") * F.col("x")).alias("v"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")
    )
    if not scaled:
        return made.select("e", "inst", "k", "share", "v")
    mean = F.col("s") / F.col("w")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0)))
    return made.select("e", "inst", "k", "share", F.when(spread > _FLAT, F.col("v") / spread).otherwise(0.0).alias("v"))


def with_loadings(panel: DataFrame, field: str, components: DataFrame, every: int | None, lag: int = 0, scaled: bool = False) -> DataFrame:
    """``panel`` with t, and with v and share, each row's loadings on the components of the window in force and their shares
    of variance, as arrays.

    That is the last window which ends ``lag`` times before the row or earlier; ``every`` None applies the only window to
    all times.  Both are null before the first window.
    """
    first, last = components.agg(F.min("e"), F.max("e")).first()
    rows = panel.join(time_index(panel), "ts")
    if every is None or last is None:
        e = F.lit(last)
    else:
        e = F.when(F.col("t") - lag >= first, F.least(F.floor((F.col("t") - lag - first) / every) * every + first, F.lit(last)))
    each = loadings(panel, field, components, scaled).groupBy("e", "inst")
    v = each.agg(F.sort_array(F.collect_list(F.struct("k", "v", "share"))).alias("c"))
    v = v.select("e", "inst", F.col("c.v").alias("v"), F.col("c.share").alias("share"))
    return rows.withColumn("e", e.cast("int")).join(v, ["e", "inst"], "left").drop("e")


def _score(weight: Column, factors: int) -> list[Column]:
    return [F.sum(F.get("v", F.lit(k)) * weight).alias(f"f{k}") for k in range(factors)]


def pca_residual(
    panel: DataFrame, signal: str, field: str, factors: int = 1, window: int | None = None, every: int = 1, lag: int = 0, scaled: bool = False, out: str = "residual"
) -> DataFrame:
    """``panel`` with the signal less its projection on the components of ``field``, a missing signal being zero.

    window None takes the components of the whole panel; else those of the last ``window`` times up to ``lag`` times
    before, renewed every ``every`` times.  Before the first window the signal is unchanged.
    """
    components = pca_windows(panel, field, window, factors, every, scaled)
    own = with_loadings(panel, field, components, every if window else None, lag, scaled)
    own = written(own.withColumn("o", F.coalesce(F.col(signal).cast("double"), F.lit(0.0))), "loaded")
    made = own.join(own.groupBy("t").agg(*_score(F.col("o"), factors)), "t")
    part = [F.coalesce(F.col(f"f{k}") * F.get("v", F.lit(k)), F.lit(0.0)) for k in range(factors)]
    return made.withColumn(out, F.col("o") - sum(part[1:], part[0])).select(*panel.columns, out)


def factor_variances(panel: DataFrame, field: str, factors: int = 5, window: int | None = None, every: int = 1) -> DataFrame:
    """ts, k, variance and share of the factor returns of each window.

    A factor return is the projection of a time's returns on a component.  Components of one window are uncorrelated in
    it, so their covariance is diagonal and the variance is the eigenvalue over the degrees of freedom.
    """
    made = pca_windows(panel, field, window, factors, every)
    return made.select("ts", "k", (F.col("eigenvalue") / (F.size("coef") - 1)).alias("variance"), "share")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _inner(b: pd.Series, m: pd.Series, risk: pd.Series, strength: pd.Series) -> pd.Series:
    """(diag(1 / (strength risk)) + M)^-1 b of every time, K by K."""
    made = []
    for x, flat, r, s in zip(b, m, risk, strength, strict=True):
        if r is None or s <= 0:
            made.append(None)
            continue
        k, most = len(r), len(x)  # a window may have fewer components than were asked for
        inner = np.reshape(flat, (most, most))[:k, :k] + np.diag(1 / (np.asarray(r, float) * s))
        made.append(np.linalg.solve(inner, x[:k]).tolist())
    return pd.Series(made)


def hedged_weights(
    panel: DataFrame, weight: str, field: str, factors: int = 3, window: int = 60, every: int = 20, lag: int = 1, strength: float = 1.0, least: int = 3, out: str = "hedged"
) -> DataFrame:
    """``panel`` with weights moved towards the subspace without factor risk: (I + strength R)^-1 w, scaled to one.

    R = B S B' with the loadings B of scaled returns over a window that ended ``lag`` times before, and S their shares of
    variance, restricted to the rows of a time whose weight is not zero.  Only K by K systems are solved: the inverse is
    I - B (S^-1 / strength + B'B)^-1 B', where B'B and B'w are sums over the rows of a time.  A weight that would change
    its sign becomes zero.  Times with fewer than ``least`` weights, and those before the first window, keep theirs as they are.
    """
    components = pca_windows(panel, field, window, factors, every, scaled=True)
    own = with_loadings(panel, field, components, every, lag, scaled=True)
    own = own.withColumn("w", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)))
    own = written(own.withColumn("v", F.when(F.col("w") != 0, F.col("v"))), "active")
    pairs = [F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))) for i in range(factors) for j in range(factors)]
    filled = lambda sums: F.array(*(F.coalesce(x, F.lit(0.0)) for x in sums))
    sums = own.groupBy("t").agg(filled(_score(F.col("w"), factors)).alias("b"), filled(pairs).alias("m"), F.max("share").alias("risk"), F.count("v").alias("n"))
    inner = _inner("b", "m", "risk", F.lit(float(strength)))
    made = own.join(sums.select("t", "n", inner.alias("c")), "t")
    part = [F.coalesce(F.get("c", F.lit(k)) * F.get("v", F.lit(k)), F.lit(0.0)) for k in range(factors)]
    moved = F.col("w") - sum(part[1:], part[0])
    moved = F.when(F.col("w") * moved > 0, moved).otherwise(0.0)
    hedged = F.col("n") >= least
    total = F.sum(F.abs(moved)).over(Window.partitionBy("t"))
    return made.withColumn(out, F.when(hedged & (total > 1e-10), moved / total).otherwise(F.col("w"))).select(*panel.columns, out)
