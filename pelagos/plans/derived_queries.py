"""Registered queries of derived fields, lagged regressions and simulations of each side by itself, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.functions import timeseries as ts
from pelagos.plans import backtest as bt
from pelagos.plans import evaluation as ev
from pelagos.plans.queries import _POSITIONS, PANEL_KEYS, PANEL_SQL, RULES, keyed, register, reversal, rounded
from pelagos.sources import derived
from pelagos.sources import panel as src

_VALUES = ["returns", "log_returns", "vwap_deviation", "volume_ratio", "high_low_range", "open_close_range", "overnight_gap", "upper_shadow", "lower_shadow", "adv_6", "momentum_3", "parkinson_6", "volatility_12"]
DERIVED_SQL = f"""WITH {PANEL_SQL},
f AS (SELECT ts, inst, close / lag(close) OVER s - 1 AS returns, ln(close / lag(close) OVER s) AS log_returns, (close - dollars / volume) / (dollars / volume) AS vwap_deviation,
  dollars / CASE WHEN count(dollars) OVER w6 >= 3 THEN avg(dollars) OVER w6 END AS volume_ratio, (high - low) / close AS high_low_range, abs(close - open) / close AS open_close_range,
  open / lag(close) OVER s - 1 AS overnight_gap, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_shadow, (least(open, close) - low) / nullif(high - low, 0) AS lower_shadow,
  CASE WHEN count(dollars) OVER w6 >= 3 THEN avg(dollars) OVER w6 END AS adv_6, close / lag(close, 3) OVER s - 1 AS momentum_3,
  CASE WHEN count(high / low) OVER w6 >= 3 THEN sqrt(avg(power(ln(high / low), 2) / (4 * ln(2))) OVER w6) * sqrt(12) END AS parkinson_6
  FROM panel WINDOW s AS (PARTITION BY inst ORDER BY ts), w6 AS (PARTITION BY inst ORDER BY ts ROWS 5 PRECEDING)),
v AS (SELECT *, CASE WHEN count(returns) OVER w12 >= 6 THEN stddev_samp(returns) OVER w12 * sqrt(12) END AS volatility_12 FROM f WINDOW w12 AS (PARTITION BY inst ORDER BY ts ROWS 11 PRECEDING))
SELECT {PANEL_KEYS}, {", ".join(f"round({c}, 6) AS {c}" for c in _VALUES)} FROM v"""


@register("derived_fields", DERIVED_SQL)
def derived_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived fields of the monthly panel."""
    made = derived.derived_fields(src.monthly_panel(spark, sf_dir).drop("vwap"), 12, (6,), (12,), (6,), (3,), 6)
    return keyed(made, *rounded(**{c: F.col(c) for c in _VALUES}))


BASIS_SQL = f"""WITH {PANEL_SQL}, y AS (SELECT *, close / vwap - 1 AS basis FROM panel)
SELECT {PANEL_KEYS}, round(basis, 6) AS basis, round(CASE WHEN count(basis) OVER w >= 6 THEN (basis - avg(basis) OVER w) / nullif(stddev_samp(basis) OVER w, 0) END, 6) AS basis_z
FROM y WINDOW w AS (PARTITION BY inst ORDER BY ts ROWS 11 PRECEDING)"""


@register("futures_basis", BASIS_SQL)
def futures_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closing price as a future's over the month's mean price as the spot's."""
    made = derived.basis(src.monthly_panel(spark, sf_dir), "close", "vwap", 12)
    return keyed(made, *rounded(basis=F.col("basis"), basis_z=F.col("basis_z")))


LAGGED_SQL = f"""WITH {PANEL_SQL}, y AS (SELECT *, lag(volume, 3) OVER (PARTITION BY inst ORDER BY ts) AS x FROM panel),
r AS (SELECT *, count(close + x) OVER p10 >= 3 AND row_number() OVER s > 10 AND var_samp(CASE WHEN close IS NOT NULL THEN x END) OVER p10 != 0 AS ok, regr_slope(close, x) OVER p10 AS b, regr_intercept(close, x) OVER p10 AS a FROM y
      WINDOW s AS (PARTITION BY inst ORDER BY ts), p10 AS (PARTITION BY inst ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT {PANEL_KEYS}, round(CASE WHEN ok THEN b END, 6) AS slope, round(CASE WHEN ok THEN close - a - b * x END, 6) AS residual FROM r"""


@register("regression_lagged", LAGGED_SQL)
def regression_lagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing price on the volume of three months before."""
    made = ts.with_lagged_regression(src.monthly_panel(spark, sf_dir), "close", "volume", 10, 3, "slope", "slope")
    made = ts.with_lagged_regression(made, "close", "volume", 10, 3, "residual", "residual")
    return keyed(made, *rounded(slope=F.col("slope"), residual=F.col("residual")))


_APART = _POSITIONS.replace("FROM panel WINDOW", "FROM apart WINDOW")
_APART_METRICS = """SELECT {keys}, count(*) AS bars, round(sum(pnl), 2) AS pnl, round(avg(pnl) / stddev_samp(pnl) * sqrt(12), 6) AS sharpe, round(avg(turnover), 6) AS turnover FROM pnl GROUP BY {keys}"""
APART_SQL = f"""WITH {PANEL_SQL},
sides AS (SELECT ts, CASE WHEN row_number() OVER (ORDER BY ts) <= floor(count(*) OVER () * 0.7::DOUBLE) THEN 'in' ELSE 'out' END AS sample FROM c),
apart AS (SELECT panel.* REPLACE (struct_pack(ts := panel.ts, side := sample) AS ts, struct_pack(side := sample, i := inst) AS inst) FROM panel JOIN sides ON panel.ts = sides.ts){_APART}
{_APART_METRICS.format(keys="ts.side").replace("SELECT ts.side,", "SELECT ts.side AS sample,")}"""


@register("split_simulations", APART_SQL)
def split_simulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reversal signal simulated by itself on the first seven tenths of the months and on the rest."""
    panel = src.monthly_panel(spark, sf_dir)
    sides = ev.fixed_split(ev.times_of(panel), 0.7, 12)
    made = bt.metrics(ev.simulate_apart(panel, reversal, "signal", RULES, sides), RULES, ("sample",))
    return made.select("sample", "bars", *(F.round(c, n).alias(c) for c, n in (("pnl", 2), ("sharpe", 6), ("turnover", 6))))
