"""Registered queries of the choice of alphas inside walk-forward folds, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagos.functions.elementwise import clip, log, over
from pelagos.plans import selection
from pelagos.plans.queries import PANEL_SQL, register
from pelagos.scratch import written
from pelagos.sources import panel as src

FOLDS = selection.Folds(train=24, val=12, step=6, warmup=12, closeness=12, most_corr=0.5, most=4, bars_per_year=12, least_bars=10)


def _back(x: str, k: int) -> Column:
    return F.lag(x, k).over(Window.partitionBy("inst").orderBy("ts"))


_SQL = {f"trend_{k}": f"close / nullif(lag(close, {k}) OVER s, 0) - 1" for k in (1, 2, 3, 6, 12)} | {
    "fall_1": "-(close / nullif(lag(close, 1) OVER s, 0) - 1)", "body": "close / nullif(open, 0) - 1", "small": "-ln(CASE WHEN dollars > 0 THEN dollars END)",
    "cheap": "vwap / nullif(close, 0)", "wide": "(high - low) / nullif(close, 0)", "calm": "-(high - low) / nullif(close, 0)", "busy": "volume",
}


def _columns() -> dict[str, Column]:
    close = F.col("close")
    made = {f"trend_{k}": over(close, _back("close", k)) - 1 for k in (1, 2, 3, 6, 12)}
    width = over(F.col("high") - F.col("low"), close)
    return made | {
        "fall_1": -made["trend_1"], "body": over(close, F.col("open")) - 1, "small": -log(F.col("dollars")), "cheap": over(F.col("vwap"), close),
        "wide": width, "calm": -width, "busy": F.col("volume"),
    }


def named_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alpha, ts, inst, s, ret): a dozen simple signals of the monthly panel, written once."""
    made = _columns()
    panel = src.monthly_panel(spark, sf_dir).select("ts", "inst", clip(made["trend_1"], -0.5, 0.5).alias("ret"), *(c.alias(n) for n, c in made.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("alpha"), F.col(n).cast("double").alias("s")) for n in made))
    return written(panel.select("ts", "inst", "ret", F.explode(pairs).alias("p")).select("p.alpha", "ts", "inst", "p.s", "ret"), "signals")


def signals_sql() -> str:
    """Steps up to hel, each signal's position h at every bar."""
    return f"""{PANEL_SQL},
cols AS (SELECT inst, ts, (dense_rank() OVER (ORDER BY ts) - 1)::INT AS t, CASE WHEN close / nullif(lag(close) OVER s, 0) IS NOT NULL THEN least(greatest(close / nullif(lag(close) OVER s, 0) - 1, -0.5), 0.5) END AS ret,
         {", ".join(f"{sql} AS {n}" for n, sql in _SQL.items())} FROM panel WINDOW s AS (PARTITION BY inst ORDER BY ts)),
sig AS (SELECT * FROM cols UNPIVOT INCLUDE NULLS (s FOR alpha IN ({", ".join(_SQL)}))),
dem AS (SELECT *, s - avg(s) OVER (PARTITION BY alpha, t) AS d FROM sig),
sca AS (SELECT *, d / nullif(sum(abs(d)) OVER (PARTITION BY alpha, t), 0) AS w FROM dem),
hel AS (SELECT *, lag(w) OVER (PARTITION BY alpha, inst ORDER BY t) AS h FROM sca)"""


_SIGNALS_SQL = f"""{signals_sql()},
fr AS (SELECT alpha, t, coalesce(sum(h * ret), 0) AS r FROM hel GROUP BY alpha, t),
fold AS (SELECT (c - 48) // 6 AS fold, c FROM (SELECT unnest(range(48, max(t) + 1, 6)) AS c FROM sig)),
cell AS (SELECT fold, alpha, t >= c - 12 AS val, CASE WHEN t IN (c - 36, c - 12) THEN 0 ELSE r END AS r FROM fold JOIN fr ON t >= c - 36 AND t < c),
sharpe AS (SELECT fold, alpha, val, CASE WHEN count(*) >= 10 AND stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(12) END AS s FROM cell GROUP BY ALL),
pass AS (SELECT * FROM (SELECT fold, alpha, max(s) FILTER (NOT val) AS train, max(s) FILTER (val) AS val FROM sharpe GROUP BY ALL) WHERE train > 0 AND val > 0),
pair AS (SELECT a.t, a.alpha AS a, b.alpha AS b, CASE WHEN var_samp(a.s) > 0 AND var_samp(b.s) > 0 THEN corr(a.s, b.s) END AS corr
         FROM sig a JOIN sig b ON a.t = b.t AND a.inst = b.inst AND a.alpha < b.alpha WHERE a.s IS NOT NULL AND b.s IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
near AS (SELECT fold, a, b, avg(abs(corr)) AS corr FROM fold JOIN pair ON t >= c - 12 AND t < c GROUP BY ALL),
cand AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY train * 0.5 + val * 0.5 DESC, alpha) AS i FROM pass),
rowsof AS (SELECT x.fold, x.i, list(CASE WHEN x.i = y.i THEN 1.0 ELSE coalesce(corr, 1.0) END ORDER BY y.i) AS m FROM cand x JOIN cand y ON x.fold = y.fold
           LEFT JOIN near ON near.fold = x.fold AND a = least(x.alpha, y.alpha) AND b = greatest(x.alpha, y.alpha) GROUP BY ALL),
mat AS (SELECT fold, list(m ORDER BY i) AS m FROM rowsof GROUP BY fold),
pick AS (SELECT fold, 1 AS i, [1]::BIGINT[] AS chosen FROM mat
         UNION ALL SELECT fold, i + 1, CASE WHEN len(chosen) < 4 AND list_max(list_transform(chosen, lambda k: m[i + 1][k])) <= 0.5 THEN list_append(chosen, i + 1) ELSE chosen END
         FROM pick JOIN mat USING (fold) WHERE i < len(m)),
chosen AS (SELECT fold, unnest(chosen) AS i, unnest(range(1, len(chosen) + 1)) AS place FROM pick JOIN mat USING (fold) WHERE i = len(m))"""

CHOICE_SQL = f"""
WITH RECURSIVE {_SIGNALS_SQL}
SELECT fold, CAST(ts AS DATE) AS ts, place::INT AS place, alpha, round(train, 6) AS train, round(val, 6) AS val
FROM chosen JOIN cand USING (fold, i) JOIN fold USING (fold) JOIN (SELECT DISTINCT t AS c, ts FROM cols) USING (c)
"""


@register("fold_selection", CHOICE_SQL)
def fold_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alphas that each half-yearly fold chooses from two years of training and one of validation."""
    made = selection.choose(named_signals(spark, sf_dir), FOLDS)
    return made.select("fold", F.col("ts").cast("date").alias("ts"), "place", "alpha", F.round("train", 6).alias("train"), F.round("val", 6).alias("val"))


FOLD_RETURNS_SQL = f"""
WITH RECURSIVE {_SIGNALS_SQL}
SELECT fold, CAST(ts AS DATE) AS ts, round(avg(r), 6) AS r, count(*) AS names
FROM chosen JOIN cand USING (fold, i) JOIN fold USING (fold) JOIN fr ON fr.alpha = cand.alpha AND t > c AND t < c + 6 JOIN (SELECT DISTINCT t, ts FROM cols) USING (t) GROUP BY fold, ts
"""


@register("fold_returns", FOLD_RETURNS_SQL)
def fold_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample returns of the alphas that each fold has chosen."""
    signals = named_signals(spark, sf_dir)
    made = selection.fold_returns(selection.choose(signals, FOLDS), signals, FOLDS)
    return made.select("fold", F.col("ts").cast("date").alias("ts"), F.round("r", 6).alias("r"), "names")
