"""Rolling operators along each instrument of a dense panel.

Windows count rows of the shared calendar, missing values included, so the panel must be dense (see
``sources.panel.densify``).  Columns here are window expressions: nest them by naming the inner one first with
``withColumn``; consecutive ones over the same keys share one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.elementwise import INF, over

KEY, TIME = "inst", "ts"


def series():
    return Window.partitionBy(KEY).orderBy(TIME)


def trailing(n: int):
    return series().rowsBetween(-(n - 1), 0)


def before(n: int):
    """The ``n`` rows that end with the previous one."""
    return series().rowsBetween(-n, -1)


def so_far():
    return series().rowsBetween(Window.unboundedPreceding, 0)


def at_least(k: int, seen: Column, w, value: Column) -> Column:
    return F.when(F.count(seen).over(w) >= k, value)


def let(make, **parts: Column) -> Column:
    """``make`` of a struct of ``parts``, each evaluated once: repeated window expressions would each be computed."""
    bound = F.array(F.struct(*(c.alias(n) for n, c in parts.items())))
    return F.get(F.transform(bound, make), F.lit(0))


def ts_sum(x: Column, n: int = 10) -> Column:
    return F.sum(x).over(trailing(n))


def ts_mean(x: Column, n: int = 10) -> Column:
    return F.avg(x).over(trailing(n))


def ts_min(x: Column, n: int = 10) -> Column:
    return F.min(x).over(trailing(n))


def ts_max(x: Column, n: int = 10) -> Column:
    return F.max(x).over(trailing(n))


def delay(x: Column, d: int = 1, lookahead: bool = False) -> Column:
    if d < 0 and not lookahead:
        raise ValueError("a negative delay looks ahead; pass lookahead=True to allow it")
    return F.lag(x, d).over(series())


def delta(x: Column, d: int = 2) -> Column:
    return x - F.lag(x, d).over(series())


def stddev(x: Column, n: int = 10) -> Column:
    return at_least(2, x, trailing(n), F.stddev_samp(x).over(trailing(n)))


def covariance(x: Column, y: Column, n: int = 10, same: bool = False) -> Column:
    """Sample covariance of complete pairs, from three; ``same`` inputs give zero."""
    if same:
        return F.lit(0.0)
    w = trailing(n)
    return at_least(3, x + y, w, F.covar_samp(x, y).over(w))


def correlation(x: Column, y: Column, n: int = 10, least: int = 3, same: bool = False) -> Column:
    """Pearson correlation of complete pairs; missing where a side is constant; ``same`` inputs give zero."""
    if same:
        return F.lit(0.0)
    w = trailing(n)
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)
    return at_least(least, x + y, w, over(F.covar_samp(a, b).over(w), spread))


def product(x: Column, n: int = 10) -> Column:
    """Missing where the window holds a missing value."""
    w = trailing(n)
    return F.when(F.count(F.when(x.isNull(), 1)).over(w) == 0, F.product(x).over(w))


def values(x: Column, n: int) -> Column:
    """The window as an array of structs ``v``, oldest first, missing values included."""
    return F.collect_list(F.struct(x.alias("v"))).over(trailing(n))


def ts_rank(x: Column, n: int = 10) -> Column:
    """Share of the window at or below the current value, ties at their mean rank."""
    own = values(x, n)
    below = F.size(F.filter(own, lambda e: e["v"] < x))
    equal = F.size(F.filter(own, lambda e: e["v"] == x))
    valid = F.size(F.filter(own, lambda e: e["v"].isNotNull()))
    return F.when(x.isNotNull(), (below + (equal + 1) / 2) / valid)


def ts_rank_strict(x: Column, n: int = 10) -> Column:
    """Values strictly below the current one over the others; missing for fewer than two."""
    own = values(x, n)
    below = F.size(F.filter(own, lambda e: e["v"] < x))
    valid = F.size(F.filter(own, lambda e: e["v"].isNotNull()))
    return F.when(x.isNotNull() & (valid >= 2), below / (valid - 1))


def _arg(x: Column, n: int, extreme) -> Column:
    own = values(x, n)
    plain = F.transform(own, lambda e: e["v"])
    gap = F.array_position(F.transform(own, lambda e: e["v"].isNull()), F.lit(True))
    return F.when(gap > 0, gap).otherwise(F.array_position(plain, extreme(plain))).cast("double")


def arg_max(x: Column, n: int = 10) -> Column:
    """Position of the first maximum from the oldest row, from 1; a missing value wins."""
    return _arg(x, n, F.array_max)


def arg_min(x: Column, n: int = 10) -> Column:
    return _arg(x, n, F.array_min)


def bars_since_max(x: Column, n: int = 10) -> Column:
    own = F.transform(values(x, n), lambda e: e["v"])
    return (F.size(own) - F.array_position(own, F.array_max(own))).cast("double")


def skewness(x: Column, n: int = 10) -> Column:
    """Bias-adjusted, from three values; zero for a constant window."""
    w = trailing(n)

    def adjusted(s: Column) -> Column:
        k = s["k"]
        made = s["raw"] * F.sqrt(k * (k - 1)) / F.when(k > 2, k - 2)
        return F.when((k >= 3) & (s["low"] == s["high"]), F.lit(0.0)).when(k >= 3, made)

    return let(adjusted, k=F.count(x).over(w), raw=F.skewness(x).over(w), low=F.min(x).over(w), high=F.max(x).over(w))


def kurtosis(x: Column, n: int = 10) -> Column:
    """Bias-adjusted excess, from four values; -3 for a constant window."""
    w = trailing(n)

    def adjusted(s: Column) -> Column:
        k = s["k"]
        made = (k - 1) / F.when(k > 3, (k - 2) * (k - 3)) * ((k + 1) * s["raw"] + 6)
        return F.when((k >= 4) & (s["low"] == s["high"]), F.lit(-3.0)).when(k >= 4, made)

    return let(adjusted, k=F.count(x).over(w), raw=F.kurtosis(x).over(w), low=F.min(x).over(w), high=F.max(x).over(w))


def ts_zscore(x: Column, n: int = 10) -> Column:
    """Against mean and population deviation of the window that ends yesterday, from two values."""
    w = before(n)
    mean, spread = F.avg(x).over(w), F.stddev_pop(x).over(w)
    gap = x - mean
    score = F.when(spread != 0, gap / spread).when(gap > 0, F.lit(INF)).when(gap < 0, F.lit(-INF))
    return at_least(2, x, w, score)


def rolling_zscore(x: Column, n: int = 20) -> Column:
    """Unshifted, sample deviation, from ``max(n // 2, 2)`` values."""
    w = trailing(n)
    return at_least(max(n // 2, 2), x, w, over(x - F.avg(x).over(w), F.stddev_samp(x).over(w)))


def av_diff(x: Column, n: int = 10) -> Column:
    return x - ts_mean(x, n)


def entropy(x: Column, n: int = 10) -> Column:
    """Of the absolute values as shares; zero total gives zero; missing for fewer than two values."""
    w = trailing(n)
    total = F.sum(F.abs(x)).over(w)
    terms = F.sum(F.when(x != 0, F.abs(x) * F.log(F.abs(F.when(x != 0, x)))).otherwise(F.when(x == 0, 0.0))).over(w)
    positive = F.when(total > 0, total)
    return at_least(2, x, w, F.when(total == 0, F.lit(0.0)).otherwise(F.log(positive) - terms / positive))


def regression(y: Column, x: Column, n: int = 252, kind: str = "residual") -> Column:
    """Least squares of y on x over the ``n`` rows before this one, all of which must exist, from three pairs.

    kind: residual, intercept, slope or fitted, the last at the current x.
    """
    w = before(n)
    a, b = F.when(x.isNotNull(), y), F.when(y.isNotNull(), x)
    spread = F.var_samp(b).over(w)
    slope = F.when(spread != 0, F.covar_samp(a, b).over(w) / spread)
    intercept = F.avg(a).over(w) - slope * F.avg(b).over(w)
    made = {"slope": slope, "intercept": intercept, "fitted": intercept + slope * x}
    made["residual"] = y - made["fitted"]
    ready = (F.count(x + y).over(w) >= 3) & (F.row_number().over(series()) > n)
    return F.when(ready, made[kind])


def with_lagged_regression(panel: DataFrame, y: str, x: str, n: int = 252, lag: int = 0, kind: str = "residual", out: str = "regression") -> DataFrame:
    """``panel`` with ``regression`` of y on the x of ``lag`` rows before."""
    made = panel.withColumn("_x", F.lag(x, lag).over(series())) if lag else panel.withColumn("_x", F.col(x))
    return made.withColumn(out, regression(F.col(y), F.col("_x"), n, kind)).drop("_x")


def decay_linear(x: Column, n: int = 10) -> Column:
    """Weights 1..m, newest heaviest, for the m rows there are; missing where one of them is."""
    w = trailing(n)
    rows = F.count(F.lit(1)).over(w)
    own = values(x, n)
    total = F.aggregate(
        F.transform(own, lambda e, i: e["v"] * (i + 1)), F.lit(0.0), lambda s, v: s + v
    )
    return F.when(F.count(x).over(w) == rows, total / (rows * (rows + 1) / 2))


def decay_finite(x: Column, f: float, n: int) -> Column:
    """Weights ``f**age`` over the window, missing values skipped."""
    own = F.reverse(values(x, n))
    weighed = F.transform(own, lambda e, i: F.struct((e["v"] * F.pow(F.lit(f), i)).alias("s"), F.when(e["v"].isNotNull(), F.pow(F.lit(f), i)).alias("w")))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
    step = lambda t, e: F.struct((t["s"] + F.coalesce(e["s"], F.lit(0.0))).alias("s"), (t["w"] + F.coalesce(e["w"], F.lit(0.0))).alias("w"))
    return F.aggregate(weighed, start, step, lambda t: F.when(t["w"] > 0, t["s"] / F.when(t["w"] > 0, t["w"])))


def count_missing(x: Column, n: int = 10) -> Column:
    return F.sum(x.isNull().cast("double")).over(trailing(n))


def backfill(x: Column, n: int = 30) -> Column:
    """The last present value, at most ``n`` rows back."""
    return F.last(x, ignorenulls=True).over(trailing(n + 1))


def ts_scale(x: Column, n: int = 10, c: float = 0.0) -> Column:
    low, high = ts_min(x, n), ts_max(x, n)
    return over(x - low, high - low) + c


def kth_element(x: Column, n: int = 10, k: int = 1) -> Column:
    return F.lag(x, n - k - 1).over(series()) if 0 <= n - k - 1 else F.lit(None).cast("double")


def last_different(x: Column, n: int = 10) -> Column:
    """The nearest earlier value, at most ``n`` rows back, that differs; a missing one differs but keeps the search open."""
    past = F.slice(F.reverse(values(x, n + 1)), 2, n)
    other = F.filter(past, lambda e: e["v"].isNotNull() & (x.isNull() | (e["v"] != x)))
    return F.when(F.size(other) > 0, F.get(other, F.lit(0))["v"])


def changed(x: Column) -> Column:
    """1 where the value is not the one before; a missing value, before or now, counts as a change."""
    return F.coalesce(x != F.lag(x).over(series()), F.lit(True)).cast("int")


def with_change_run(panel: DataFrame, field: str, out: str = "run") -> DataFrame:
    """``panel`` with the number of the field's run of equal values, from 1; a missing value is a run of its own."""
    made = panel.withColumn("_changed", changed(F.col(field)))
    return made.withColumn(out, F.sum("_changed").over(so_far())).drop("_changed")


def with_days_from_last_change(panel: DataFrame, field: str, out: str = "days") -> DataFrame:
    """``panel`` with the rows since the field last changed; zero on a change and on missing values."""
    made = with_change_run(panel, field, "_run")
    return made.withColumn(out, F.row_number().over(Window.partitionBy(KEY, "_run").orderBy(TIME)) - 1).drop("_run")


def with_moment(panel: DataFrame, field: str, n: int = 10, k: int = 2, out: str = "moment") -> DataFrame:
    """``panel`` with the rolling mean of the k-th power of the gap to each row's own rolling mean, from two values."""
    w = trailing(n)
    made = panel.withColumn("_gap", F.col(field) - at_least(2, F.col(field), w, F.avg(field).over(w)))
    return made.withColumn(out, at_least(2, F.col("_gap"), w, F.avg(F.pow("_gap", F.lit(k))).over(w))).drop("_gap")


def running_total(x: Column) -> Column:
    return F.sum(x).over(so_far())


def running_max(x: Column) -> Column:
    return F.max(x).over(so_far())


def drawdown(x: Column) -> Column:
    """Of a cumulative series named as a column, below its running maximum."""
    return x - F.max(x).over(so_far())


def forward_return(x: Column) -> Column:
    return over(F.lead(x).over(series()), x) - 1


def pct_change(x: Column) -> Column:
    """Relative change from the row before; name ``padded(x)`` first where a missing value should repeat the last one."""
    return over(x, F.lag(x).over(series())) - 1


def padded(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(so_far())


def rolling_beta(x: Column, market: Column, n: int = 60) -> Column:
    w = trailing(n)
    a, b = F.when(market.isNotNull(), x), F.when(x.isNotNull(), market)
    return at_least(max(n // 2, 2), x + market, w, over(F.covar_samp(a, b).over(w), F.var_samp(b).over(w)))


def top_first(score: Column, n: int, keys: list[str], descending: bool = True) -> Column:
    """Whether a row is among the first ``n`` of its keys; ties go to the smaller instrument."""
    order = score.desc_nulls_last() if descending else score.asc_nulls_last()
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order, F.col(KEY))) <= n
