"""Registered panel queries and their SQL twins.

Every query runs over whole tables.  Computed columns are rounded to six decimals on both sides, as sums of doubles
depend on their order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.functions import candles
from pelagos.functions import cross_section as xs
from pelagos.functions import elementwise as ew
from pelagos.functions import timeseries as ts
from pelagos.operators import aggregates as agg
from pelagos.operators import joins, portfolio, sequential
from pelagos.plans import backtest as bt
from pelagos.plans import catalog, quality, universe
from pelagos.scratch import scratch_dir
from pelagos.sources import panel as src
from pelagos.sources.keyed import KeyedTable
from pelagos.streaming import candles as stream
from pelagos.streaming import warm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "backtest_metrics"

PANEL_SQL = """
t AS (SELECT date_trunc('month', l_shipdate) AS ts, l_suppkey AS inst, l_extendedprice / l_quantity AS p, l_quantity AS q, l_extendedprice AS d,
        ((day(l_shipdate) * 1099511627776 + l_orderkey) * 8 + l_linenumber) * 32768 + CAST(round(l_extendedprice * 100) AS BIGINT) % 32768 AS o FROM lineitem),
b AS (SELECT ts, inst, arg_min(p, o) AS open, max(p) AS high, min(p) AS low, arg_max(p, o) AS close, sum(q) AS volume, sum(d) AS dollars FROM t GROUP BY ts, inst),
g AS (SELECT s_suppkey AS inst, s_nationkey AS industry, n_regionkey AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 MONTH)) AS ts FROM b),
panel AS (SELECT g.inst, c.ts, industry, sector, open, high, low, close, volume, dollars, dollars / volume AS vwap
          FROM g CROSS JOIN c LEFT JOIN b ON g.inst = b.inst AND c.ts = b.ts)"""
PANEL_KEYS = "CAST(ts AS DATE) AS ts, inst"


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return add


def rounded(**columns: Column) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


def keyed(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(F.col("ts").cast("date").alias("ts"), "inst", *columns)


def columns_query(name: str, columns: dict[str, tuple[Column | Callable, str]], stages: str = "", source: str = "panel", windows: str = "", prepare=None):
    """Register a query of panel columns: Spark expression and SQL expression by output name.

    ``stages`` are further SQL steps after the panel, ``source`` the one to read, ``prepare`` the same for the DataFrame.
    """
    made = ", ".join(f"round({sql}, 6) AS {n}" for n, (_, sql) in columns.items())
    sql = f"WITH {PANEL_SQL}{stages} SELECT {PANEL_KEYS}, {made} FROM {source} {windows}"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        panel = src.monthly_panel(spark, sf_dir)
        panel = prepare(panel) if prepare else panel
        return keyed(panel, *rounded(**{n: c() if callable(c) else c for n, (c, _) in columns.items()}))

    register(name, sql)(query)


def _c(name: str) -> Column:
    return F.col(name)


SERIES = "WINDOW s AS (PARTITION BY inst ORDER BY ts), w5 AS (PARTITION BY inst ORDER BY ts ROWS 4 PRECEDING), w10 AS (PARTITION BY inst ORDER BY ts ROWS 9 PRECEDING), p10 AS (PARTITION BY inst ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"

columns_query("ew_arithmetic", {
    "added": (lambda: ew.add(_c("close"), _c("open")), "close + open"),
    "subtracted": (lambda: ew.subtract(_c("close"), 3), "close - 3"),
    "multiplied": (lambda: ew.multiply(_c("close"), _c("volume")), "close * volume"),
    "divided": (lambda: ew.divide(_c("close"), _c("open")), "close / open"),
    "over_zero": (lambda: ew.over(_c("close"), _c("high") - _c("low")), "CASE WHEN high - low != 0 THEN close / (high - low) END"),
    "protected": (lambda: ew.protected_div(_c("close"), _c("high") - _c("low")), "CASE WHEN high - low = 0 THEN 0.0 ELSE close / (high - low) END"),
    "inverted": (lambda: ew.inverse(_c("volume")), "1 / volume"),
    "negated": (lambda: ew.negative(_c("close")), "-close"),
    "absolute": (lambda: ew.absolute(_c("close") - _c("open")), "abs(close - open)"),
    "signum": (lambda: ew.sign(_c("close") - _c("open")), "CAST(sign(close - open) AS DOUBLE)"),
})

columns_query("ew_math", {
    "cubed": (lambda: ew.power(_c("close") / 1000, 3), "power(close / 1000, 3)"),
    "rooted": (lambda: ew.signed_power(_c("close") - _c("open"), 0.5), "sign(close - open) * power(abs(close - open), 0.5)"),
    "magnitude": (lambda: ew.magnitude_power(_c("close") / 1000, -2), "power(close / 1000, 2)"),
    "logged": (lambda: ew.log(_c("close") - _c("open")), "CASE WHEN close > open THEN ln(CASE WHEN close > open THEN close - open END) END"),
    "logged10": (lambda: ew.log10(_c("close")), "log10(close)"),
    "root": (lambda: ew.sqrt(_c("close") - _c("open")), "CASE WHEN close >= open THEN sqrt(CASE WHEN close >= open THEN close - open END) END"),
    "squared": (lambda: ew.square(_c("close") - _c("open")), "(close - open) * (close - open)"),
    "signed_log": (lambda: ew.signed_log1p(_c("close") - _c("open")), "sign(close - open) * ln(1 + abs(close - open))"),
    "dead": (lambda: ew.dead_zone(_c("close") - _c("open"), 100), "CASE WHEN close - open > -100 AND close - open < 100 THEN 0.0 ELSE close - open END"),
    "tailed": (lambda: ew.tail(_c("close") - _c("open"), -50, 50, 7), "CASE WHEN close - open >= -50 AND close - open <= 50 THEN 7.0 ELSE close - open END"),
    "squashed": (lambda: ew.sigmoid((_c("close") - _c("open")) / 1000), "1 / (1 + exp(-(close - open) / 1000))"),
    "truncated": (lambda: ew.truncate(_c("close") - _c("open"), 200), "CASE WHEN close - open IS NOT NULL THEN least(greatest(close - open, -200.0), 200.0) END"),
})

columns_query("ew_logic", {
    "larger": (lambda: ew.maximum(_c("close"), _c("open")), "CASE WHEN close > open THEN close ELSE open END"),
    "smaller": (lambda: ew.minimum(_c("close"), _c("open")), "CASE WHEN close < open THEN close ELSE open END"),
    "less": (lambda: ew.compare(_c("close"), "<", _c("open")), "CASE WHEN close < open THEN 1.0 ELSE 0.0 END"),
    "unequal": (lambda: ew.compare(_c("close"), "!=", _c("open")), "CASE WHEN close = open THEN 0.0 ELSE 1.0 END"),
    "scalar_left": (lambda: ew.compare(1200, "<=", _c("close")), "CASE WHEN 1200 <= close THEN 1.0 ELSE 0.0 END"),
    "conjunction": (lambda: ew.both(_c("close") - _c("open"), _c("volume")), "CASE WHEN (close - open IS NULL OR close != open) AND (volume IS NULL OR volume != 0) THEN 1.0 ELSE 0.0 END"),
    "disjunction": (lambda: ew.either(_c("close") - _c("close"), _c("volume")), "CASE WHEN close IS NULL OR volume IS NULL OR volume != 0 THEN 1.0 ELSE 0.0 END"),
    "chosen": (lambda: ew.if_else(ew.compare(_c("close"), ">", _c("vwap")), _c("high"), _c("low")), "CASE WHEN close > vwap THEN high ELSE low END"),
    "missing": (lambda: ew.is_missing(_c("close")), "CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END"),
    "priced": (lambda: ew.price_filter(_c("volume"), _c("close"), 1000, 1800), "CASE WHEN close < 1000 OR close > 1800 THEN NULL ELSE volume END"),
    "pasted": (lambda: ew.pasteurize(_c("close"), _c("volume") > 100), "CASE WHEN volume > 100 THEN close END"),
    "filled": (lambda: ew.div_fill(_c("close"), _c("high") - _c("low")), "CASE WHEN abs(high - low) > 1e-10 THEN close / (high - low) ELSE 0.0 END"),
})

columns_query("ts_moments", {
    "total": (lambda: ts.ts_sum(_c("volume"), 5), "sum(volume) OVER w5"),
    "mean": (lambda: ts.ts_mean(_c("close"), 5), "avg(close) OVER w5"),
    "low": (lambda: ts.ts_min(_c("close"), 5), "min(close) OVER w5"),
    "high": (lambda: ts.ts_max(_c("close"), 5), "max(close) OVER w5"),
    "deviation": (lambda: ts.stddev(_c("close"), 10), "stddev_samp(close) OVER w10"),
    "skew": (lambda: ts.skewness(_c("close"), 10), "CASE WHEN count(close) OVER w10 >= 3 THEN skewness(close) OVER w10 END"),
    "kurt": (lambda: ts.kurtosis(_c("close"), 10), "CASE WHEN count(close) OVER w10 >= 4 THEN kurtosis(close) OVER w10 END"),
    "gap": (lambda: ts.av_diff(_c("close"), 5), "close - avg(close) OVER w5"),
    "shifted_z": (lambda: ts.ts_zscore(_c("close"), 10), "CASE WHEN count(close) OVER p10 >= 2 THEN (close - avg(close) OVER p10) / stddev_pop(close) OVER p10 END"),
    "plain_z": (lambda: ts.rolling_zscore(_c("close"), 10), "CASE WHEN count(close) OVER w10 >= 5 THEN (close - avg(close) OVER w10) / stddev_samp(close) OVER w10 END"),
}, windows=SERIES)

_PAIR = ", x AS (SELECT *, close AS a, volume AS b FROM panel)"
columns_query("ts_pairs", {
    "corr": (lambda: ts.correlation(_c("close"), _c("volume"), 10), "CASE WHEN count(a + b) OVER w10 >= 3 THEN covar_samp(a, b) OVER w10 / (stddev_samp(a) OVER w10 * stddev_samp(b) OVER w10) END"),
    "cov": (lambda: ts.covariance(_c("close"), _c("volume"), 10), "CASE WHEN count(a + b) OVER w10 >= 3 THEN covar_samp(a, b) OVER w10 END"),
    "same": (lambda: ts.correlation(_c("close"), _c("close"), 10, same=True), "0.0"),
    "slope": (lambda: ts.regression(_c("close"), _c("volume"), 10, "slope"), "CASE WHEN count(a + b) OVER p10 >= 3 AND row_number() OVER s > 10 THEN regr_slope(a, b) OVER p10 END"),
    "intercept": (lambda: ts.regression(_c("close"), _c("volume"), 10, "intercept"), "CASE WHEN count(a + b) OVER p10 >= 3 AND row_number() OVER s > 10 THEN regr_intercept(a, b) OVER p10 END"),
    "residual": (lambda: ts.regression(_c("close"), _c("volume"), 10), "CASE WHEN count(a + b) OVER p10 >= 3 AND row_number() OVER s > 10 THEN a - regr_intercept(a, b) OVER p10 - b * regr_slope(a, b) OVER p10 END"),
    "beta": (lambda: ts.rolling_beta(_c("close"), _c("volume"), 10), "CASE WHEN count(a + b) OVER w10 >= 5 THEN covar_samp(a, b) OVER w10 / var_samp(b) OVER w10 END"),
}, stages=_PAIR, source="x", windows=SERIES)

columns_query("ts_positions", {
    "ranked": (lambda: ts.ts_rank(_c("close"), 10), "CASE WHEN close IS NOT NULL THEN (len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2) / len(list_filter(l, lambda v: v IS NOT NULL)) END"),
    "ranked_strict": (lambda: ts.ts_rank_strict(_c("close"), 10), "CASE WHEN close IS NOT NULL AND len(list_filter(l, lambda v: v IS NOT NULL)) >= 2 THEN len(list_filter(l, lambda v: v < close)) / (len(list_filter(l, lambda v: v IS NOT NULL)) - 1) END"),
    "top_at": (lambda: ts.arg_max(_c("close"), 10), "CAST(CASE WHEN len(list_filter(l, lambda v: v IS NULL)) > 0 THEN list_position(list_transform(l, lambda v: v IS NULL), true) ELSE list_position(l, list_max(l)) END AS DOUBLE)"),
    "bottom_at": (lambda: ts.arg_min(_c("close"), 10), "CAST(CASE WHEN len(list_filter(l, lambda v: v IS NULL)) > 0 THEN list_position(list_transform(l, lambda v: v IS NULL), true) ELSE list_position(l, list_min(l)) END AS DOUBLE)"),
    "different": (lambda: ts.last_different(_c("close"), 9), "list_reverse(l[:-2])[list_position(list_transform(list_reverse(l[:-2]), lambda v: v IS NOT NULL AND (close IS NULL OR v != close)), true)]"),
    "strung": (lambda: ts.decay_linear(_c("close"), 10), "CASE WHEN len(list_filter(l, lambda v: v IS NULL)) = 0 THEN list_sum(list_transform(l, lambda v, i: v * i)) / (len(l) * (len(l) + 1) / 2) END"),
}, stages=", x AS (SELECT *, list(close) OVER (PARTITION BY inst ORDER BY ts ROWS 9 PRECEDING) AS l FROM panel)", source="x")

columns_query("ts_lags", {
    "delayed": (lambda: ts.delay(_c("close"), 3), "lag(close, 3) OVER s"),
    "ahead": (lambda: ts.delay(_c("close"), -2, lookahead=True), "lead(close, 2) OVER s"),
    "change": (lambda: ts.delta(_c("close"), 2), "close - lag(close, 2) OVER s"),
    "filled": (lambda: ts.backfill(_c("close"), 4), "last_value(close IGNORE NULLS) OVER w5"),
    "gaps": (lambda: ts.count_missing(_c("close"), 10), "CAST(count(*) OVER w10 - count(close) OVER w10 AS DOUBLE)"),
    "kth": (lambda: ts.kth_element(_c("close"), 10, 2), "lag(close, 7) OVER s"),
    "relative": (lambda: ts.pct_change(_c("close")), "close / lag(close) OVER s - 1"),
    "forward": (lambda: ts.forward_return(_c("close")), "lead(close) OVER s / close - 1"),
    "total": (lambda: ts.running_total(_c("volume")), "sum(volume) OVER s"),
    "below_peak": (lambda: ts.drawdown(_c("close")), "close - max(close) OVER s"),
    "ranged": (lambda: ts.ts_scale(_c("close"), 10), "(close - min(close) OVER w10) / nullif(max(close) OVER w10 - min(close) OVER w10, 0)"),
    "multiplied": (lambda: ts.product(_c("close") / 1000, 5), "CASE WHEN count(*) OVER w5 = count(close) OVER w5 THEN product(close / 1000) OVER w5 END"),
    "spread_out": (lambda: ts.entropy(_c("volume"), 10), "CASE WHEN count(volume) OVER w10 >= 2 THEN ln(sum(abs(volume)) OVER w10) - sum(abs(volume) * ln(abs(volume))) OVER w10 / sum(abs(volume)) OVER w10 END"),
}, windows=SERIES)

_XS = "WINDOW m AS (PARTITION BY ts)"
_RANK = "CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY ts{g}, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY ts{g}, {x}) - 1) / 2) / count({x}) OVER (PARTITION BY ts{g}) END"
columns_query("xs_section", {
    "ranked": (lambda: xs.rank(_c("close")), _RANK.format(x="close", g="")),
    "ranked_ties": (lambda: xs.rank(F.round("volume", -2)), _RANK.format(x="round(volume, -2)", g="")),
    "scored": (lambda: xs.zscore(_c("close")), "(close - avg(close) OVER m) / stddev_samp(close) OVER m"),
    "scaled": (lambda: xs.scale(_c("close") - _c("open")), "(close - open) / sum(abs(close - open)) OVER m"),
    "normal": (lambda: xs.normalize(_c("close"), 0.9), "CASE WHEN close IS NOT NULL THEN least(greatest(2 * (close - min(close) OVER m) / (max(close) OVER m - min(close) OVER m) - 1, -0.9), 0.9) END"),
    "neutral": (lambda: xs.market_neutralize(_c("close")), "close - avg(close) OVER m"),
    "average": (lambda: xs.vec_avg(_c("close")), "avg(close) OVER m"),
    "summed": (lambda: xs.vec_sum(_c("close")), "coalesce(sum(close) OVER m, 0)"),
    "humped": (lambda: xs.hump(_c("close"), 0.5), "CASE WHEN close IS NOT NULL THEN least(greatest(close, avg(close) OVER m - 0.5 * stddev_samp(close) OVER m), avg(close) OVER m + 0.5 * stddev_samp(close) OVER m) END"),
    "winsorized": (lambda: xs.winsorize(_c("close"), 0.05, 0.95), "CASE WHEN close IS NOT NULL THEN least(greatest(close, quantile_cont(close, 0.05) OVER m), quantile_cont(close, 0.95) OVER m) END"),
}, windows=_XS)

columns_query("xs_bucket", {
    "bin": (lambda: xs.bucket(_c("close"), 5), "CASE WHEN close IS NULL THEN NULL ELSE 1 + CAST(close > q[2] AS INT) + CAST(close > q[3] AS INT) + CAST(close > q[4] AS INT) + CAST(close > q[5] AS INT) END::DOUBLE"),
}, stages=", e AS (SELECT ts AS ets, quantile_cont(close, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM panel GROUP BY ts), x AS (SELECT * FROM panel JOIN e ON ts = ets)", source="x")

columns_query("group_operators", {
    "neutral": (lambda: xs.group_neutralize(_c("close"), "sector"), "close - avg(close) OVER gs"),
    "ranked": (lambda: xs.group_rank(_c("close"), "industry"), "CASE WHEN count(*) OVER gi = 1 THEN close ELSE " + _RANK.format(x="close", g=", industry") + " END"),
    "scored": (lambda: xs.group_zscore(_c("close"), "industry"), "CASE WHEN count(*) OVER gi = 1 THEN close WHEN stddev_samp(close) OVER gi != 0 THEN (close - avg(close) OVER gi) / stddev_samp(close) OVER gi END"),
    "scaled": (lambda: xs.group_scale(_c("close"), "sector"), "close / sum(abs(close)) OVER gs"),
    "weighted": (lambda: xs.group_mean(_c("close"), _c("volume"), "sector"), "sum(close * volume) OVER gs / sum(volume) OVER gs"),
}, windows="WINDOW gs AS (PARTITION BY ts, sector), gi AS (PARTITION BY ts, industry)")

_SIGNAL = """, x AS (SELECT *, -(close - lag(close, 2) OVER s) AS raw, lead(open) OVER s / open - 1 AS ret FROM panel WINDOW s AS (PARTITION BY inst ORDER BY ts)),
y AS (SELECT *, CASE WHEN raw IS NOT NULL THEN (rank() OVER (PARTITION BY ts, raw IS NULL ORDER BY raw) + (count(*) OVER (PARTITION BY ts, raw) - 1) / 2) / count(raw) OVER (PARTITION BY ts) END AS signal FROM x)"""


def reversal(panel: DataFrame) -> DataFrame:
    """``signal``: the cross-sectional rank of the negated two-bar change."""
    return panel.withColumn("raw", -ts.delta(_c("close"), 2)).withColumn("signal", xs.rank(_c("raw")))


RULES = bt.Rules(max_weight=0.05, decay=3, neutralization="sector", fees_bps=5.0, bars_per_year=12)
_POSITIONS = _SIGNAL + """,
d AS (SELECT *, (coalesce(lag(signal, 1) OVER s, 0) * 1 + coalesce(lag(signal, 2) OVER s, 0) * 2 + coalesce(lag(signal, 3) OVER s, 0) * 3) / 6 AS a FROM y WINDOW s AS (PARTITION BY inst ORDER BY ts)),
n AS (SELECT *, a - avg(a) OVER (PARTITION BY ts, sector) AS a2 FROM d),
w AS (SELECT *, CASE WHEN sum(abs(a2)) OVER (PARTITION BY ts) != 0 THEN least(greatest(a2 / sum(abs(a2)) OVER (PARTITION BY ts), -0.05), 0.05) END AS weight FROM n),
h AS (SELECT *, abs(weight - lag(weight) OVER (PARTITION BY inst ORDER BY ts)) AS change FROM w),
pnl AS (SELECT ts, coalesce(sum(weight * 2e7 * ret), 0) AS gross, coalesce(sum(change), 0) AS turnover, coalesce(sum(change), 0) * 2e7 * 5 / 1e4 AS cost,
          coalesce(sum(weight * 2e7 * ret), 0) - coalesce(sum(change), 0) * 2e7 * 5 / 1e4 AS pnl,
          count_if(weight > 0) AS longs, count_if(weight < 0) AS shorts FROM h GROUP BY ts)"""


def _pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.simulate(reversal(src.monthly_panel(spark, sf_dir)), "signal", RULES)


@register("backtest_pnl", f"""WITH {PANEL_SQL}{_POSITIONS} SELECT CAST(ts AS DATE) AS ts, round(gross, 2) AS gross, round(turnover, 6) AS turnover,
  round(cost, 2) AS cost, round(pnl, 2) AS pnl FROM pnl""")
def backtest_pnl(spark, sf_dir):
    made = _pnl(spark, sf_dir)
    return made.select(F.col("ts").cast("date").alias("ts"), F.round("gross", 2).alias("gross"), F.round("turnover", 6).alias("turnover"),
                       F.round("cost", 2).alias("cost"), F.round("pnl", 2).alias("pnl"))


_METRICS = """, k AS (SELECT *, sum(pnl) OVER (ORDER BY ts) AS total FROM pnl), z AS (SELECT *, total - max(total) OVER (ORDER BY ts) AS below FROM k),
m AS (SELECT count(*) AS bars, sum(pnl) AS pnl, avg(pnl) * 12 / 1e7 AS annual_return, avg(pnl) / stddev_samp(pnl) * sqrt(12) AS sharpe, avg(turnover) AS turnover,
  min(below) / 2e7 AS max_drawdown, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_share FROM z)
SELECT bars, round(pnl, 2) AS pnl, round(annual_return, 6) AS annual_return, round(sharpe, 6) AS sharpe, round(turnover, 6) AS turnover,
  round(CASE WHEN turnover > 0.001 THEN sharpe * sqrt(abs(annual_return) / greatest(turnover, 0.125)) ELSE 0 END, 6) AS fitness,
  round(max_drawdown, 6) AS max_drawdown, round(win_share, 6) AS win_share FROM m"""


@register("backtest_metrics", f"WITH {PANEL_SQL}{_POSITIONS}{_METRICS}")
def backtest_metrics(spark, sf_dir):
    made = bt.metrics(_pnl(spark, sf_dir), RULES)
    return made.select("bars", F.round("pnl", 2).alias("pnl"), *(F.round(c, 6).alias(c) for c in made.columns[2:]))


@register("backtest_fee_grid", f"""WITH {PANEL_SQL}{_POSITIONS}, f AS (SELECT unnest([0.0, 5.0, 10.0]) AS fee)
SELECT fee, round(avg(gross - turnover * 2e7 * fee / 1e4) / stddev_samp(gross - turnover * 2e7 * fee / 1e4) * sqrt(12), 6) AS sharpe FROM pnl CROSS JOIN f GROUP BY fee""")
def backtest_fee_grid(spark, sf_dir):
    made = bt.fee_grid(_pnl(spark, sf_dir), [0.0, 5.0, 10.0], RULES)
    return made.select("fee", F.round("sharpe", 6).alias("sharpe"))


@register("annual_metrics", f"""WITH {PANEL_SQL}{_POSITIONS} SELECT coalesce(CAST(year(ts) AS VARCHAR), 'Total') AS year, round(sum(pnl), 2) AS pnl,
  round(avg(pnl) / stddev_samp(pnl) * sqrt(12), 6) AS sharpe, count(*) AS bars FROM pnl GROUP BY ROLLUP (year(ts))""")
def annual_metrics(spark, sf_dir):
    made = _pnl(spark, sf_dir).rollup(F.year("ts").alias("y")).agg(F.sum("pnl").alias("pnl"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("s"), F.count("*").alias("bars"))
    sharpe = F.round(ew.over(_c("m"), _c("s")) * 12**0.5, 6).alias("sharpe")
    return made.select(F.coalesce(F.col("y").cast("string"), F.lit("Total")).alias("year"), F.round("pnl", 2).alias("pnl"), sharpe, "bars")


_BOTH = "WHERE signal IS NOT NULL AND ret IS NOT NULL"


def _signal_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.with_returns(reversal(src.monthly_panel(spark, sf_dir)), 1)


@register("spearman_ic", f"""WITH {PANEL_SQL}{_SIGNAL}, z AS (SELECT * FROM y {_BOTH}),
r AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY signal) + (count(*) OVER (PARTITION BY ts, signal) - 1) / 2 AS a,
        rank() OVER (PARTITION BY ts ORDER BY ret) + (count(*) OVER (PARTITION BY ts, ret) - 1) / 2 AS b FROM z)
SELECT CAST(ts AS DATE) AS ts, round(covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)), 6) AS ic, count(*) AS n FROM r GROUP BY ts HAVING count(*) >= 10""")
def spearman_ic(spark, sf_dir):
    made = agg.spearman_ic(_signal_panel(spark, sf_dir), "signal", "ret")
    return made.select(F.col("ts").cast("date").alias("ts"), F.round("ic", 6).alias("ic"), "n")


@register("quantile_spread", f"""WITH {PANEL_SQL}{_SIGNAL}, z AS (SELECT * FROM y {_BOTH}),
e AS (SELECT ts, quantile_cont(signal, 0.2) AS lo, quantile_cont(signal, 0.8) AS hi FROM z GROUP BY ts HAVING count(*) >= 20),
s AS (SELECT ts, avg(ret) FILTER (signal >= hi) AS l, avg(ret) FILTER (signal <= lo) AS s, count_if(signal >= hi) AS nl, count_if(signal <= lo) AS ns FROM z JOIN e USING (ts) GROUP BY ts)
SELECT CAST(ts AS DATE) AS ts, round(l, 6) AS long, round(s, 6) AS short, round(l - s, 6) AS spread FROM s WHERE nl >= 3 AND ns >= 3""")
def quantile_spread(spark, sf_dir):
    made = agg.quantile_spread(_signal_panel(spark, sf_dir), "signal", "ret")
    return made.select(F.col("ts").cast("date").alias("ts"), *(F.round(c, 6).alias(c) for c in ("long", "short", "spread")))


_FM = f"""WITH {PANEL_SQL}{_SIGNAL}, f AS (SELECT ts, regr_slope(ret, signal) AS slope, regr_intercept(ret, signal) AS intercept, regr_r2(ret, signal) AS r2, count(*) AS n
FROM y {_BOTH} GROUP BY ts HAVING count(*) >= 15)"""


@register("fama_macbeth_first", f"{_FM} SELECT CAST(ts AS DATE) AS ts, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, n FROM f")
def fama_macbeth_first(spark, sf_dir):
    made = agg.section_regression(_signal_panel(spark, sf_dir), "ret", "signal")
    return made.select(F.col("ts").cast("date").alias("ts"), *(F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2")), "n")


_LAGS = ", ".join(f"lag(e, {k}) OVER (ORDER BY ts) AS l{k}" for k in range(1, 7))
_HAC = " + ".join(f"2 * {1 - k / 7!r} * coalesce(sum(e * l{k}), 0)" for k in range(1, 7))


@register("fama_macbeth_newey_west", f"""{_FM}, e AS (SELECT ts, avg(slope) OVER () AS mean, slope - avg(slope) OVER () AS e FROM f), l AS (SELECT *, {_LAGS} FROM e),
v AS (SELECT any_value(mean) AS mean, sqrt(greatest((sum(e * e) + {_HAC}) / nullif(count(*), 0), 0) / nullif(count(*), 0)) AS se, count(*) AS n FROM l)
SELECT round(mean, 6) AS mean, round(se, 6) AS se, round(mean / se, 6) AS t, n FROM v""")
def fama_macbeth_newey_west(spark, sf_dir):
    made = agg.newey_west(agg.section_regression(_signal_panel(spark, sf_dir), "ret", "signal"))
    return made.select(*(F.round(c, 6).alias(c) for c in ("mean", "se", "t")), "n")


@register("group_counts", f"""WITH {PANEL_SQL} SELECT sector, industry, count(*) AS cells, count(close) AS present, round(median(close), 6) AS middle
FROM panel GROUP BY GROUPING SETS ((sector, industry), (sector), ())""")
def group_counts(spark, sf_dir):
    panel = src.monthly_panel(spark, sf_dir).select("sector", "industry", "close")
    sets = panel.groupingSets([["sector", "industry"], ["sector"], []], "sector", "industry")
    return sets.agg(F.count("*").alias("cells"), F.count("close").alias("present"), F.round(F.median("close"), 6).alias("middle"))


@register("asof_orders", """WITH f AS (SELECT o_custkey AS k, o_orderdate AS at, max(o_totalprice) AS price FROM orders GROUP BY 1, 2),
e AS (SELECT event_id, user_id AS k, ts FROM events)
SELECT event_id, round(price, 2) AS price FROM e ASOF LEFT JOIN f ON e.k = f.k AND e.ts >= f.at""")
def asof_orders(spark, sf_dir):
    """Each event with its user's latest order, users matched to customer numbers."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("k"), "ts")
    return joins.asof_backward(events, orders, ["k"], "ts", ["price"]).select("event_id", F.round("price", 2).alias("price"))


@register("interval_orders", """WITH o AS (SELECT o_custkey AS k, o_orderkey, o_orderdate AS since, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders),
e AS (SELECT event_id, user_id AS k, ts FROM events)
SELECT event_id, o_orderkey FROM e JOIN o ON e.k = o.k AND e.ts >= o.since AND (until IS NULL OR e.ts < until)""")
def interval_orders(spark, sf_dir):
    """Events inside the validity interval of an order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderdate").alias("since"))
    line = F.lead("since").over(src.Window.partitionBy("k").orderBy("since", "o_orderkey"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("k"), "ts")
    return joins.interval_join(events, orders.withColumn("until", line), ["k"], "ts", "since", "until").select("event_id", "o_orderkey")


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour candles of event values by event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("value IS NOT NULL")
    ticks = events.select(F.col("event_type").alias("inst"), "ts", F.struct("ts", "event_id").alias("o"), "value")
    bars = ticks.groupBy("inst", F.window("ts", "6 hours").alias("w")).agg(
        F.min_by("value", "o").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "o").alias("close"), F.count("*").cast("double").alias("volume"))
    return bars.select("inst", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


_BARS = """k AS (SELECT event_type AS inst, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""


@register("ohlc_resample", f"""WITH {_BARS} SELECT inst, CAST(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS DATE) AS day, round(arg_min(open, ts), 6) AS open, round(max(high), 6) AS high,
round(min(low), 6) AS low, round(arg_max(close, ts), 6) AS close, sum(volume) AS volume FROM k GROUP BY 1, 2""")
def ohlc_resample(spark, sf_dir):
    made = agg.ohlc_resample(_bars(spark, sf_dir), "1 day", ["inst"])
    return made.select("inst", F.col("ts").cast("date").alias("day"), *(F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")), "volume")


_PRICED = ", ".join(f"CASE WHEN low > 0 THEN {c} END AS {c}" for c in ("open", "high", "low", "close"))


@register("candle_signals", f"""WITH {_BARS}, kp AS (SELECT inst, ts, {_PRICED}, volume FROM k), c AS (SELECT *, close - lag(close) OVER s AS d, ln(close / lag(close, 4) OVER s) AS momentum, avg(close) OVER w AS m, avg(volume) OVER w AS v,
  min(low) OVER w AS lo, max(high) OVER w AS hi, stddev_samp(close) OVER w AS sd, avg(high - low) OVER w AS rg, avg(ln(high / low) ** 2) OVER w AS pk
  FROM kp WINDOW s AS (PARTITION BY inst ORDER BY ts), w AS (PARTITION BY inst ORDER BY ts ROWS 7 PRECEDING)),
r AS (SELECT *, avg(greatest(d, 0)) OVER w AS up, avg(greatest(-d, 0)) OVER w AS down FROM c WINDOW w AS (PARTITION BY inst ORDER BY ts ROWS 7 PRECEDING))
SELECT inst, epoch(ts)::BIGINT AS at, round(momentum, 6) AS momentum, round(CASE WHEN high - low > 1e-10 THEN (close - open) / (high - low) ELSE 0 END, 6) AS body,
  round(CASE WHEN hi - lo > 1e-10 THEN (close - lo) / (hi - lo) ELSE 0.5 END, 6) AS place, round(CASE WHEN high - low > 1e-10 THEN (high - greatest(open, close)) / (high - low) ELSE 0 END, 6) AS upper,
  round(close / m - 1, 6) AS above_mean, round(volume / v, 6) AS volume_ratio, round(CASE WHEN abs(2 * sd) > 1e-10 THEN (close - m) / (2 * sd) ELSE 0 END, 6) AS band,
  round(CASE WHEN rg > 1e-10 THEN (high - low) / rg ELSE 1 END, 6) AS expansion, round(sqrt(pk / (4 * ln(2))), 6) AS parkinson,
  round(CASE WHEN up + down > 0 THEN 100 * up / (up + down) ELSE 50 END, 6) AS rsi FROM r""")
def candle_signals(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    priced = F.col("low") > 0  # other bars keep their place, without prices
    bars = bars.withColumns({c: F.when(priced, F.col(c)) for c in ("open", "high", "low", "close")})
    change = _c("close") - F.lag("close").over(ts.series())
    bars = bars.withColumn("d", change).withColumns({"gain": F.when(_c("d").isNotNull(), F.greatest(_c("d"), F.lit(0.0))), "loss": F.when(_c("d").isNotNull(), F.greatest(-_c("d"), F.lit(0.0)))})
    made = rounded(momentum=candles.momentum(4), body=candles.body_ratio(), place=candles.close_position(8), upper=candles.upper_shadow(), above_mean=candles.price_vs_mean(8),
                   volume_ratio=candles.volume_ratio(8), band=candles.bollinger(8), expansion=candles.range_expansion(8), parkinson=candles.parkinson(8), rsi=candles.rsi("gain", "loss", 8))
    return bars.select("inst", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), *made)


_UNIVERSE = f"""WITH {PANEL_SQL}, a AS (SELECT *, row_number() OVER s - 1 AS bar, CASE WHEN count(dollars) OVER w >= 10 THEN avg(dollars) OVER w END AS adv, count(dollars) OVER s AS age
  FROM panel WINDOW s AS (PARTITION BY inst ORDER BY ts), w AS (PARTITION BY inst ORDER BY ts ROWS 19 PRECEDING)),
e AS (SELECT *, CASE WHEN age > 12 AND bar % 6 = 0 THEN adv END AS el FROM a),
k AS (SELECT *, CASE WHEN bar % 6 = 0 THEN coalesce(el IS NOT NULL AND row_number() OVER (PARTITION BY ts, el IS NULL ORDER BY el DESC, inst) <= {{n}}, false) END AS chosen FROM e),
u AS (SELECT *, coalesce(last_value(chosen IGNORE NULLS) OVER (PARTITION BY inst ORDER BY ts), false) AS member FROM k)"""


@register("universe_top_n", _UNIVERSE.format(n=20) + " SELECT CAST(ts AS DATE) AS ts, inst, member FROM u")
def universe_top_n(spark, sf_dir):
    return keyed(universe.top_n(src.monthly_panel(spark, sf_dir), 20, every=6, seasoning=12), F.col("member"))


@register("universe_band", _UNIVERSE.format(n=20) + ", " + _UNIVERSE.format(n=8).split(PANEL_SQL + ", ")[1].replace("u AS (", "u2 AS (").replace("FROM k)", "FROM k2)").replace("k AS (", "k2 AS (").replace("a AS (", "a2 AS (").replace("e AS (", "e2 AS (").replace("FROM a)", "FROM a2)").replace("FROM e)", "FROM e2)") + """
SELECT CAST(ts AS DATE) AS ts, inst FROM (SELECT ts, inst FROM u WHERE member EXCEPT SELECT ts, inst FROM u2 WHERE member)""")
def universe_band(spark, sf_dir):
    panel = src.monthly_panel(spark, sf_dir)
    wide, narrow = (universe.top_n(panel, n, every=6, seasoning=12) for n in (20, 8))
    return keyed(universe.band(wide, narrow))


@register("coverage_filter", f"""WITH {PANEL_SQL}, s AS (SELECT inst FROM panel GROUP BY inst HAVING avg(CASE WHEN volume > 200 THEN 1.0 ELSE 0 END) > 0.35)
SELECT inst, count(*) AS rows FROM panel SEMI JOIN s USING (inst) GROUP BY inst""")
def coverage_filter(spark, sf_dir):
    panel = src.monthly_panel(spark, sf_dir).withColumn("big", F.coalesce(F.col("volume") > 200, F.lit(False)))
    return universe.coverage_filter(panel, "big", 0.35).groupBy("inst").agg(F.count("*").alias("rows"))


@register("coverage_statistics", f"""WITH {PANEL_SQL} SELECT inst, round(avg(CASE WHEN close IS NULL THEN 0.0 ELSE 1 END), 6) AS coverage, round(avg(close), 6) AS mean,
round(median(close), 6) AS median, round(stddev_samp(close), 6) AS deviation FROM panel GROUP BY inst""")
def coverage_statistics(spark, sf_dir):
    made = agg.coverage(src.monthly_panel(spark, sf_dir), "close")
    return made.select("inst", *(F.round(c, 6).alias(c) for c in made.columns[1:]))


@register("integrity_report", "WITH " + PANEL_SQL + ", r AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) AS rows, avg(CASE WHEN {f} IS NULL THEN 1.0 ELSE 0 END) AS missing, count_if({f} <= 0) AS bad, min({f}) AS low, max({f}) AS high FROM panel"
    for f in ("open", "close", "volume")) + """) SELECT field, rows, round(missing, 6) AS missing, CAST(bad AS BIGINT) AS bad, round(low, 6) AS low, round(high, 6) AS high,
CASE WHEN missing > 0.2 OR bad > 0 THEN 'FAIL' WHEN missing > 0.002 THEN 'WARN' ELSE 'PASS' END AS status FROM r""")  # fmt: skip
def integrity_report(spark, sf_dir):
    made = quality.integrity_report(src.monthly_panel(spark, sf_dir), ["open", "close", "volume"], warn=0.002)
    return made.select("field", "rows", F.round("missing", 6).alias("missing"), F.col("bad").cast("long").alias("bad"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "status")


@register("cross_checks", f"""WITH {PANEL_SQL} SELECT 'high_below_low' AS rule, count_if(high < low)::BIGINT AS n FROM panel UNION ALL SELECT 'close_outside', count_if(close > high OR close < low)::BIGINT FROM panel
UNION ALL SELECT 'open_outside', count_if(open > high OR open < low)::BIGINT FROM panel UNION ALL SELECT 'no_volume', count_if(close IS NOT NULL AND coalesce(volume, 0) <= 0)::BIGINT FROM panel""")
def cross_checks(spark, sf_dir):
    return quality.cross_checks(src.monthly_panel(spark, sf_dir)).select("rule", F.col("n").cast("long").alias("n"))


@register("field_cleaner", f"""WITH {PANEL_SQL}, q AS (SELECT inst AS qi, quantile_cont(volume, 0.999) AS top, quantile_cont(close, 0.05) AS lo, quantile_cont(close, 0.95) AS hi, count(close) AS k FROM panel GROUP BY inst)
SELECT CAST(ts AS DATE) AS ts, inst, round(CASE WHEN volume < 0 OR volume > 10 * top THEN NULL ELSE volume END, 6) AS volume,
round(CASE WHEN k > 50 AND close IS NOT NULL THEN least(greatest(close, lo), hi) ELSE close END, 9) AS close, round(CASE WHEN open > 0 AND open <= 1500 THEN open END, 6) AS open FROM panel JOIN q ON inst = qi""")
def field_cleaner(spark, sf_dir):
    made = quality.clean_volume(src.monthly_panel(spark, sf_dir))
    made = quality.winsorize_by_instrument(made, "close", 0.05, 0.95)
    return keyed(made, *rounded(volume=_c("volume"), open=quality.clean_price(_c("open"), 1500)), F.round("close", 9).alias("close"))


_CHANGE = ", d AS (SELECT *, close - lag(close) OVER (PARTITION BY inst ORDER BY ts) AS change FROM panel)"


@register("signed_streak", f"""WITH {PANEL_SQL}{_CHANGE}, f AS (SELECT *, CASE WHEN sign(change) = lag(sign(change)) OVER s THEN 0 ELSE 1 END AS st FROM d WINDOW s AS (PARTITION BY inst ORDER BY ts)),
i AS (SELECT *, sum(st) OVER (PARTITION BY inst ORDER BY ts) AS island FROM f)
SELECT CAST(ts AS DATE) AS ts, inst, CAST(sign(change) * row_number() OVER (PARTITION BY inst, island ORDER BY ts) AS DOUBLE) AS streak FROM i""")
def signed_streak(spark, sf_dir):
    panel = src.monthly_panel(spark, sf_dir).withColumn("change", ts.delta(_c("close"), 1))
    return keyed(quality.signed_streak(panel, "change"), F.col("streak"))


@register("stale_runs", f"""WITH {PANEL_SQL}, p AS (SELECT *, round(volume, -2) AS v FROM panel), f AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY inst ORDER BY ts) THEN 0 ELSE 1 END AS st FROM p),
i AS (SELECT *, sum(st) OVER (PARTITION BY inst ORDER BY ts) AS island FROM f)
SELECT CAST(ts AS DATE) AS ts, inst, CASE WHEN v IS NOT NULL THEN row_number() OVER (PARTITION BY inst, island ORDER BY ts) END AS run FROM i""")
def stale_runs(spark, sf_dir):
    panel = src.monthly_panel(spark, sf_dir).withColumn("v", F.round("volume", -2))
    return keyed(quality.stale_runs(panel, "v"), F.col("run").cast("long").alias("run"))


@register("event_gaps", """WITH e AS (SELECT user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS step FROM events)
SELECT user_id, count(*) AS gaps, round(max(step), 3) AS longest FROM e WHERE step > 1.5 * 3600 GROUP BY user_id""")
def event_gaps(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = quality.time_gaps(events, ["user_id"], "ts", 3600)
    return made.groupBy("user_id").agg(F.count("*").alias("gaps"), F.round(F.max("step"), 3).alias("longest"))


@register("upsert_keep_last", """WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) AS n FROM orders)
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day FROM r WHERE n = 1""")
def upsert_keep_last(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    made = src.keep_last(orders, ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))
    return made.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


_FACTORS = f"""WITH {PANEL_SQL}{_SIGNAL}, a AS (SELECT 'reversal' AS alpha, ts, inst, signal AS s, ret FROM y UNION ALL SELECT 'value', ts, inst, close / vwap - 1, ret FROM y
  UNION ALL SELECT 'size', ts, inst, volume - avg(volume) OVER (PARTITION BY ts), ret FROM y),
w AS (SELECT *, s / nullif(sum(abs(s)) OVER (PARTITION BY alpha, ts), 0) AS w FROM a), h AS (SELECT *, lag(w) OVER l AS h, abs(w - lag(w) OVER l) AS t FROM w WINDOW l AS (PARTITION BY alpha, inst ORDER BY ts)),
f AS (SELECT alpha, ts, sum(h * ret) - coalesce(sum(t), 0) * 5 / 1e4 AS r FROM h GROUP BY alpha, ts)"""


def _alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _signal_panel(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(n).alias("alpha"), c.alias("s")) for n, c in
                     (("reversal", _c("signal")), ("value", ew.over(_c("close"), _c("vwap")) - 1), ("size", _c("small")))))
    panel = panel.withColumn("small", xs.market_neutralize(_c("volume")))
    return panel.select("ts", "inst", "ret", F.explode(each).alias("x")).select("x.alpha", "ts", "inst", "x.s", "ret")


@register("factor_returns", f"{_FACTORS} SELECT alpha, CAST(ts AS DATE) AS ts, round(r, 6) AS r FROM f")
def factor_returns(spark, sf_dir):
    return bt.factor_returns(_alphas(spark, sf_dir), 5.0).select("alpha", F.col("ts").cast("date").alias("ts"), F.round("r", 6).alias("r"))


_ADAPT = f"""{_FACTORS}, m AS (SELECT *, greatest(coalesce(avg(r) OVER (PARTITION BY alpha ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), 0), 0) AS m FROM f),
aw AS (SELECT alpha, ts, CASE WHEN sum(m) OVER (PARTITION BY ts) > 0 THEN m / sum(m) OVER (PARTITION BY ts) ELSE 1.0 / count(*) OVER (PARTITION BY ts) END AS w FROM m)"""


@register("adaptive_weights", f"{_ADAPT} SELECT alpha, CAST(ts AS DATE) AS ts, round(w, 6) AS w FROM aw")
def adaptive_weights(spark, sf_dir):
    made = bt.adaptive_weights(bt.factor_returns(_alphas(spark, sf_dir), 5.0), 12)
    return made.select("alpha", F.col("ts").cast("date").alias("ts"), F.round("w", 6).alias("w"))


@register("combined_signal", f"""{_ADAPT} SELECT CAST(a.ts AS DATE) AS ts, inst, round(sum(s * aw.w), 6) AS s FROM a JOIN aw ON a.alpha = aw.alpha AND a.ts = aw.ts GROUP BY a.ts, inst""")
def combined_signal(spark, sf_dir):
    signals = _alphas(spark, sf_dir)
    weights = bt.adaptive_weights(bt.factor_returns(signals, 5.0), 12)
    return keyed(bt.combine(signals, weights), F.round("s", 6).alias("s"))


@register("inverse_vol_weights", f"""{_FACTORS}, v AS (SELECT *, CASE WHEN count(r) OVER l >= 2 THEN stddev_samp(r) OVER l END AS v FROM f WINDOW l AS (PARTITION BY alpha ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT alpha, CAST(ts AS DATE) AS ts, round((1 / v) / sum(1 / v) OVER (PARTITION BY ts), 6) AS w FROM v""")
def inverse_vol_weights(spark, sf_dir):
    made = bt.inverse_vol_weights(bt.factor_returns(_alphas(spark, sf_dir), 5.0), 12)
    return made.select("alpha", F.col("ts").cast("date").alias("ts"), F.round("w", 6).alias("w"))


@register("alpha_correlations", f"""{_FACTORS} SELECT x.alpha AS a, y.alpha AS b, round(covar_samp(x.r, y.r) / (stddev_samp(x.r) * stddev_samp(y.r)), 6) AS corr, count(*) AS n
FROM f x JOIN f y ON x.ts = y.ts AND x.alpha < y.alpha WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2""")
def alpha_correlations(spark, sf_dir):
    made = agg.pair_correlations(bt.factor_returns(_alphas(spark, sf_dir), 5.0))
    return made.select("a", "b", F.round("corr", 6).alias("corr"), "n")


@register("pivot_report", f"""{_FACTORS} SELECT year(ts) AS year, round(sum(r) FILTER (alpha = 'reversal'), 6) AS reversal, round(sum(r) FILTER (alpha = 'size'), 6) AS size,
round(sum(r) FILTER (alpha = 'value'), 6) AS value FROM f GROUP BY 1""")
def pivot_report(spark, sf_dir):
    made = bt.factor_returns(_alphas(spark, sf_dir), 5.0).groupBy(F.year("ts").alias("year")).pivot("alpha", ["reversal", "size", "value"]).agg(F.round(F.sum("r"), 6))
    return made


@register("target_trades", """WITH p AS (SELECT p_partkey AS inst, p_retailprice AS close, (p_size - 25) * 1000.0 AS dollars FROM part),
h AS (SELECT l_partkey AS inst, CAST(count(*) - 30 AS BIGINT) AS held FROM lineitem GROUP BY 1),
b AS (SELECT coalesce(p.inst, h.inst) AS inst, coalesce(CAST(round_even(dollars / close, 0) AS BIGINT), 0) - coalesce(held, 0) AS shares FROM p FULL JOIN h ON p.inst = h.inst)
SELECT inst, shares FROM b WHERE shares != 0""")
def target_trades(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("inst"), F.col("p_retailprice").alias("close"), ((F.col("p_size") - 25) * 1000.0).alias("dollars"))
    held = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_partkey").alias("inst")).agg((F.count("*") - 30).alias("held"))
    return bt.target_trades(part, held)


@register("commission_costs", """SELECT o_orderkey, round(least(greatest(abs(o_totalprice / 100) * 0.0035, 0.35), abs(o_totalprice / 100) * 100 * 0.01), 9) AS fee FROM orders""")
def commission_costs(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", F.round(bt.commission(F.col("o_totalprice") / 100, F.lit(100.0)), 9).alias("fee"))


@register("ewm_mean", f"""WITH {PANEL_SQL}, r AS (SELECT inst, ts, close, row_number() OVER (PARTITION BY inst ORDER BY ts) AS n FROM panel)
SELECT CAST(a.ts AS DATE) AS ts, a.inst, round(sum(power(0.8, a.n - b.n) * b.close) / sum(power(0.8, a.n - b.n)) FILTER (b.close IS NOT NULL), 6) AS ewm
FROM r a JOIN r b ON a.inst = b.inst AND b.n <= a.n GROUP BY a.ts, a.inst""")
def ewm_mean(spark, sf_dir):
    panel = src.monthly_panel(spark, sf_dir).select("ts", "inst", "close")
    return keyed(sequential.ewm_mean(panel, "close", 0.2), F.round("ewm", 6).alias("ewm"))


@register("decay_finite", f"""WITH {PANEL_SQL}, r AS (SELECT inst, ts, close, row_number() OVER (PARTITION BY inst ORDER BY ts) AS n FROM panel)
SELECT CAST(a.ts AS DATE) AS ts, a.inst, round(sum(power(0.9, a.n - b.n) * b.close) / sum(power(0.9, a.n - b.n)) FILTER (b.close IS NOT NULL), 6) AS decayed
FROM r a JOIN r b ON a.inst = b.inst AND b.n BETWEEN a.n - 9 AND a.n GROUP BY a.ts, a.inst""")
def decay_finite(spark, sf_dir):
    return keyed(src.monthly_panel(spark, sf_dir), *rounded(decayed=ts.decay_finite(_c("close"), 0.9, 10)))


@register("risk_residuals", f"""WITH {PANEL_SQL}, s AS (SELECT ts AS st, regr_slope(close, volume) AS b, regr_intercept(close, volume) AS a, count(close + volume) AS k FROM panel GROUP BY ts)
SELECT CAST(ts AS DATE) AS ts, inst, round(CASE WHEN k >= 10 THEN close - a - b * volume ELSE close END, 5) AS residual FROM panel JOIN s ON ts = st""")
def risk_residuals(spark, sf_dir):
    panel = src.monthly_panel(spark, sf_dir).select("ts", "inst", "close", "volume")
    return keyed(sequential.risk_residuals(panel, "close", ["volume"]), F.round("residual", 5).alias("residual"))


@register("portfolio_weights")
def portfolio_weights(spark, sf_dir):
    """Weights of three alphas by several methods, from one covariance made in Spark."""
    names, mean, cov = portfolio.moments(bt.factor_returns(_alphas(spark, sf_dir), 5.0))
    made = {"max_sharpe": portfolio.max_sharpe(mean, cov), "min_variance": portfolio.min_variance(cov), "risk_parity": portfolio.risk_parity(cov),
            "mean_variance": portfolio.mean_variance(mean, cov, 5.0), "shrunk": portfolio.min_variance(portfolio.shrunk(cov, 0.5))}
    rows = [(m, n, round(float(x), 6)) for m, w in made.items() for n, x in zip(names, w, strict=True)]
    return spark.createDataFrame(rows, "method string, alpha string, weight double")


@register("stream_candles", """SELECT event_type AS symbol, epoch(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'))::BIGINT AS at, round(arg_min(value, row(ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
round(arg_max(value, row(ts, event_id)), 6) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def stream_candles(spark, sf_dir):
    """Candles of the events table read as a stream, all available data in one run."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet").where("value IS NOT NULL")
    ticks = events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1).alias("size"), F.col("event_id").alias("event"))
    out = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/table")
    run = stream.windowed(ticks, "6 hours").writeStream.outputMode("complete").option("checkpointLocation", f"{out}/checkpoint")
    run.foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    made = spark.read.parquet(f"{out}/table")
    return made.select("symbol", F.unix_seconds("ts").alias("at"), *rounded(**{c: _c(c) for c in ("open", "high", "low", "close")}), "volume")


@register("stream_warm_weights", """WITH o AS (SELECT event_type AS symbol, ts, 'a' || (user_id % 5) AS alpha, CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS net FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol, alpha ORDER BY ts DESC) AS place FROM o WHERE net IS NOT NULL),
m AS (SELECT symbol, alpha, avg(net) AS m FROM l WHERE place <= 50 GROUP BY 1, 2),
p AS (SELECT *, max(m) OVER (PARTITION BY symbol) > 0 AS any_up, row_number() OVER (PARTITION BY symbol ORDER BY m DESC, alpha) AS place FROM m),
w AS (SELECT symbol, alpha, CASE WHEN any_up THEN m ELSE 1 END AS w FROM p WHERE CASE WHEN any_up THEN m > 0 ELSE place <= 3 END)
SELECT symbol, alpha, round(w / sum(w) OVER (PARTITION BY symbol), 6) AS weight FROM w""")
def stream_warm_weights(spark, sf_dir):
    """Weights after a stream of the last third of the events, begun with the state of those before as history."""
    warm.use_keyed_state(spark)
    known = spark.read.parquet(f"{sf_dir}/events.parquet")
    net = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    named = lambda df: df.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("a"), F.col("user_id") % 5).alias("alpha"), net.alias("net"))
    fresh = F.col("ts") >= F.to_timestamp(F.lit("2024-01-20"))
    stream_in = named(spark.readStream.schema(known.schema).parquet(f"{sf_dir}/events*.parquet")).where(fresh)
    out = f"{scratch_dir(spark)}/warm-{uuid.uuid4().hex}"
    put = lambda batch, n: batch.write.mode("append").parquet(f"{out}/table")
    run = warm.warm_weights(stream_in, named(known).where(~fresh), 50).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint")
    run.foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    made = spark.read.schema("symbol string, ts timestamp, alpha string, weight double").parquet(f"{out}/table").where("alpha IS NOT NULL")
    last = made.groupBy("symbol").agg(F.max("ts").alias("ts"))
    return made.join(last, ["symbol", "ts"]).select("symbol", "alpha", F.round("weight", 6).alias("weight"))


_CATALOG = """alphas AS (SELECT p_partkey AS id, p_name AS expression, p_type AS category, p_size > 45 AS archived FROM part),
evaluations AS (SELECT o_orderkey AS id, o_custkey % 300 + 1 AS alpha_id, o_totalprice / 1e5 AS sharpe, o_orderdate AS evaluated_at FROM orders)"""


def _catalog(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "orders"))
    alphas = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("expression"), F.col("p_type").alias("category"), (F.col("p_size") > 45).alias("archived"))
    seen = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 300 + 1).alias("alpha_id"), (F.col("o_totalprice") / 1e5).alias("sharpe"), F.col("o_orderdate").alias("evaluated_at"))
    return alphas, seen


@register("catalog_best", f"""WITH {_CATALOG} SELECT a.id, expression, sharpe FROM alphas a JOIN evaluations e ON a.id = e.alpha_id
WHERE NOT coalesce(archived, false) AND sharpe >= 1 ORDER BY sharpe DESC, a.id LIMIT 25""")
def catalog_best(spark, sf_dir):
    return catalog.best_alphas(*_catalog(spark, sf_dir), 1.0, 25)


@register("catalog_latest", f"""WITH {_CATALOG}, r AS (SELECT *, row_number() OVER (PARTITION BY alpha_id ORDER BY evaluated_at DESC, id DESC) AS n FROM evaluations)
SELECT alpha_id, id, sharpe FROM r WHERE n = 1""")
def catalog_latest(spark, sf_dir):
    return catalog.latest_evaluations(_catalog(spark, sf_dir)[1]).select("alpha_id", "id", "sharpe")


@register("catalog_summary", f"""WITH {_CATALOG}, s AS (SELECT alpha_id, count(*) AS k, max(sharpe) AS best FROM evaluations GROUP BY 1)
SELECT category, count(*) AS alphas, CAST(count_if(coalesce(archived, false)) AS BIGINT) AS archived, count(alpha_id) AS evaluated, CAST(coalesce(sum(k), 0) AS BIGINT) AS evaluations, max(best) AS best
FROM alphas LEFT JOIN s ON id = alpha_id GROUP BY category""")
def catalog_summary(spark, sf_dir):
    return catalog.summary(*_catalog(spark, sf_dir))


@register("catalog_upsert", """SELECT p_partkey AS id, p_name AS expression, CASE WHEN p_size > 20 THEN 'second' ELSE 'first' END AS run, CASE WHEN p_size > 20 THEN p_retailprice * 2 ELSE p_retailprice END AS sharpe
FROM part WHERE p_size > 20 OR p_size <= 30""")
def catalog_upsert(spark, sf_dir):
    """A keyed table after a first write and an upsert of newer rows, each published as a generation."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    table = KeyedTable(spark, f"{scratch_dir(spark)}/catalog-{uuid.uuid4().hex}", ["id"])
    rows = lambda run, times: part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("expression"), F.lit(run).alias("run"), (F.col("p_retailprice") * times).alias("sharpe"), "p_size")
    table.replace(rows("first", 1.0).where("p_size <= 30").drop("p_size"))
    table.upsert(rows("second", 2.0).where("p_size > 20").drop("p_size"))
    return table.read()


@register("selection_history", """WITH s AS (SELECT o_orderkey AS id, o_custkey % 7 AS run_id, CAST(o_orderdate AS DATE) AS bar_index, o_custkey % 50 + 1 AS alpha_id, o_totalprice AS weight FROM orders)
SELECT s.id, bar_index, alpha_id, p_name AS expression, p_type AS category, CAST(row_number() OVER (PARTITION BY bar_index ORDER BY weight DESC, alpha_id) AS INT) AS place FROM s JOIN part ON p_partkey = alpha_id WHERE run_id = 3""")
def selection_history(spark, sf_dir):
    alphas, _ = _catalog(spark, sf_dir)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    chosen = orders.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("run_id"), F.col("o_orderdate").cast("date").alias("bar_index"), (F.col("o_custkey") % 50 + 1).alias("alpha_id"), F.col("o_totalprice").alias("weight"))
    return catalog.selection_history(chosen, alphas, 3).select("id", "bar_index", "alpha_id", "expression", "category", "place")


@register("stored_correlations", """WITH c AS (SELECT o_custkey % 40 AS x, o_orderkey % 40 AS y, o_totalprice AS c, o_orderdate AS at0 FROM orders),
p AS (SELECT least(x, y) AS a, greatest(x, y) AS b, c, at0 FROM c WHERE x <> y)
SELECT a, b, round(arg_max(c, struct_pack(p := at0, q := c)), 6) AS correlation FROM p GROUP BY a, b""")
def stored_correlations(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = orders.select((F.col("o_custkey") % 40).alias("alpha_a"), (F.col("o_orderkey") % 40).alias("alpha_b"), F.col("o_totalprice").alias("correlation"), F.col("o_orderdate").alias("computed_at"))
    return catalog.as_pairs(found).select("a", "b", F.round("correlation", 6).alias("correlation"))
