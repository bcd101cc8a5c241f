"""Registered queries of cleaning and of moving quantiles, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.functions import timeseries as ts
from pelagos.functions.elementwise import over
from pelagos.operators import order_stats
from pelagos.plans import cleaning
from pelagos.plans.queries import PANEL_KEYS, PANEL_SQL, keyed, register, rounded
from pelagos.sources import panel as src

#: For monthly bars.
LIMITS = cleaning.Limits(least_bars=12, most_missing=0.1, least_dollars=350_000.0, stale_run=2, empty_run=2, most_return=0.5, cap_multiple=2.0, least_cap=0.1, window=24, least_window=6, spike_multiple=3.0, spike_return=0.2)


QUANTILES_SQL = f"""WITH {PANEL_SQL}
SELECT {PANEL_KEYS}, round(CASE WHEN count(close) OVER w >= 5 THEN quantile_cont(close, 0.9) OVER w END, 6) AS upper,
       round(quantile_cont(close, 0.5) OVER (PARTITION BY inst ORDER BY ts), 6) AS middle
FROM panel WINDOW w AS (PARTITION BY inst ORDER BY ts ROWS 19 PRECEDING)"""


@register("moving_quantiles", QUANTILES_SQL)
def moving_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper decile of twenty months and median of all months so far."""
    made = order_stats.rolling_quantile(src.monthly_panel(spark, sf_dir), "close", 20, 0.9, 5, out="upper")
    return keyed(order_stats.expanding_quantile(made, "close", out="middle"), *rounded(upper=F.col("upper"), middle=F.col("middle")))


EXCLUDED_SQL = f"""WITH {PANEL_SQL},
p AS (SELECT *, coalesce((close = lag(close) OVER (PARTITION BY inst ORDER BY ts))::INT, 0) AS still FROM panel),
s AS (SELECT inst, count(close) AS bars, avg((close IS NULL)::INT) AS missing, avg(still) AS still, bool_or(close <= 0) AS low, stddev_samp(close) AS spread, median(dollars) AS mid FROM p GROUP BY inst)
SELECT inst, reason FROM (SELECT inst, CASE WHEN bars < 12 THEN 'few_bars' WHEN missing > 0.1 THEN 'missing' WHEN still > 0.2 THEN 'stale' WHEN low THEN 'not_positive'
  WHEN spread < 1e-10 THEN 'constant' WHEN mid < 350000 THEN 'illiquid' WHEN still > 0.4 THEN 'coarse' END AS reason FROM s) WHERE reason IS NOT NULL"""


@register("excluded_instruments", EXCLUDED_SQL)
def excluded_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.excluded_instruments(src.monthly_panel(spark, sf_dir), LIMITS)


_FAULTS_SQL = f"""{PANEL_SQL},
p AS (SELECT *, coalesce(close = lag(close) OVER s, false) AS still, volume = 0 AND close IS NOT NULL AS dry, last_value(close IGNORE NULLS) OVER (PARTITION BY inst ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
        close IS NOT NULL AND lag(close IS NULL) OVER s AS resumed FROM panel WINDOW s AS (PARTITION BY inst ORDER BY ts)),
i AS (SELECT *, sum((NOT still)::INT) OVER s AS a, sum((NOT coalesce(dry, false))::INT) OVER s AS b FROM p WINDOW s AS (PARTITION BY inst ORDER BY ts)),
l AS (SELECT *, CASE WHEN still THEN sum(still::INT) OVER (PARTITION BY inst, a) ELSE 0 END AS stale, CASE WHEN dry THEN sum(coalesce(dry, false)::INT) OVER (PARTITION BY inst, b) ELSE 0 END AS empty FROM i),
faults AS (SELECT *, CASE WHEN stale >= 2 THEN 'stale' WHEN empty >= 2 THEN 'empty' WHEN high < low OR close <= 0 OR close < low OR close > high THEN 'broken'
        WHEN high = low AND high = close THEN 'flat' WHEN resumed AND abs((close - prior) / abs(prior)) > 0.5 THEN 'jump' END AS fault FROM l)"""


@register("bar_faults", f"WITH {_FAULTS_SQL} SELECT {PANEL_KEYS}, fault, round(CASE WHEN fault IS NULL THEN close END, 6) AS close FROM faults")
def bar_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of monthly bars, and closing prices without the faulty ones."""
    made = cleaning.emptied(cleaning.bar_faults(src.monthly_panel(spark, sf_dir), LIMITS))
    return keyed(made, F.col("fault"), *rounded(close=F.col("close")))


_CAPPED_SQL = """
m AS (SELECT *, CASE WHEN count(r) OVER w >= 6 THEN quantile_cont(abs(r), 0.5) OVER w END AS mid, CASE WHEN count(dollars) OVER w >= 6 THEN quantile_cont(dollars, 0.5) OVER w END AS usual
      FROM h WINDOW w AS (PARTITION BY inst ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
cut AS (SELECT *, CASE WHEN r IS NULL THEN NULL WHEN mid IS NULL THEN r ELSE least(greatest(r, -greatest(2 * mid, 0.1)), greatest(2 * mid, 0.1)) END AS x FROM m),
k AS (SELECT *, CASE WHEN coalesce(dollars > 3 * usual AND abs(x) > 0.2, false) THEN NULL ELSE x END AS capped FROM cut)"""
CAPPED_SQL = f"""WITH {PANEL_SQL},
g0 AS (SELECT *, close / lag(close) OVER (PARTITION BY inst ORDER BY ts) - 1 AS raw FROM panel),
h AS (SELECT *, CASE WHEN raw IS NOT NULL THEN least(greatest(raw, -0.5), 0.5) END AS r FROM g0),{_CAPPED_SQL}
SELECT {PANEL_KEYS}, round(raw, 6) AS raw, round(capped, 6) AS capped FROM k"""


@register("capped_returns", CAPPED_SQL)
def capped_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly returns capped by the two years before them."""
    panel = src.monthly_panel(spark, sf_dir).select("ts", "inst", "close", "dollars")
    panel = panel.withColumn("raw", over(F.col("close"), F.lag("close").over(ts.series())) - 1)
    made = cleaning.capped_returns(panel, "raw", "dollars", LIMITS)
    return keyed(made, *rounded(raw=F.col("raw"), capped=F.col("capped")))


CLEANED_SQL = f"""WITH {_FAULTS_SQL},
ps AS (SELECT inst, count(close) AS bars, avg((close IS NULL)::INT) AS missing, avg(still::INT) AS rest, median(dollars) AS md FROM p GROUP BY inst),
left_in AS (SELECT * REPLACE (CASE WHEN fault IS NULL THEN close END AS close) FROM faults WHERE inst NOT IN (SELECT inst FROM ps WHERE bars < 12 OR missing > 0.1 OR rest > 0.2 OR md < 350000)),
g0 AS (SELECT *, close / lag(close) OVER (PARTITION BY inst ORDER BY ts) - 1 AS raw FROM left_in),
h AS (SELECT *, CASE WHEN raw IS NOT NULL THEN least(greatest(raw, -0.5), 0.5) END AS r FROM g0),{_CAPPED_SQL}
SELECT {PANEL_KEYS}, round(capped, 6) AS ret, close IS NOT NULL AS tradable FROM k"""


@register("cleaned_panel", CLEANED_SQL)
def cleaned_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of cleaning over the monthly panel."""
    panel = src.monthly_panel(spark, sf_dir).select("ts", "inst", "high", "low", "close", "volume", "dollars")
    return keyed(cleaning.cleaned(panel, LIMITS), *rounded(ret=F.col("ret")), F.col("tradable"))
