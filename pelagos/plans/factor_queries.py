"""Registered queries of components, hedges and optimised weights, and their SQL.

The SQL finds components by squaring the matrix of products between times until one direction is left, removes it and
goes on; rows and matrices are lists.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagos.functions.elementwise import clip, log, over
from pelagos.operators import factors, optimise
from pelagos.operators import random_features as rff
from pelagos.plans.queries import PANEL_KEYS, PANEL_SQL, keyed, register, rounded
from pelagos.scratch import written
from pelagos.sources import panel as src


def return_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The monthly panel with r, the return since the month before, and o, the move within the month."""
    line = Window.partitionBy("inst").orderBy("ts")
    made = src.monthly_panel(spark, sf_dir)
    return made.withColumn("r", over(F.col("close"), F.lag("close").over(line)) - 1).withColumn("o", over(F.col("close"), F.col("open")) - 1)


RETURNS_SQL = PANEL_SQL + """,
ret AS (SELECT *, close / lag(close) OVER (PARTITION BY inst ORDER BY ts) - 1 AS r, close / open - 1 AS o FROM panel),
x AS (SELECT inst, ts, (dense_rank() OVER (ORDER BY ts) - 1)::INT AS t, coalesce(r, 0) AS x, coalesce(o, 0) AS o FROM ret)"""


def components_sql(window: int | str, every: int, number: int, scaled: bool = False, squarings: int = 16) -> str:
    """Steps that make comp(e, w, k, val, share, a): a is the weight of each time of the window that ends at e."""
    z = "(x - m) / s" if scaled else "x - m"
    steps = f""",
size AS (SELECT max(t) + 1 AS n, {window} AS w FROM x),
ends AS (SELECT unnest(range(w - 1, n, {every})) AS e, w FROM size),
xe AS (SELECT e, w, inst, t, x FROM ends JOIN x ON t > e - w AND t <= e),
me AS (SELECT e, inst, avg(x) AS m, stddev_pop(x) AS s FROM xe GROUP BY e, inst),
ze AS (SELECT e, w, inst, t, CASE WHEN {str(not scaled).lower()} OR s > 1e-8 THEN {z} ELSE 0 END AS z FROM xe JOIN me USING (e, inst)),
ce AS (SELECT e, w, t, list(z ORDER BY inst) AS col FROM ze GROUP BY e, w, t),
re AS (SELECT a.e, a.w, a.t, list(list_dot_product(a.col, b.col) ORDER BY b.t) AS line FROM ce a JOIN ce b USING (e) GROUP BY a.e, a.w, a.t),
g0 AS (SELECT e, w, list(line ORDER BY t) AS g FROM re GROUP BY e, w),
tr AS (SELECT e, list_sum(list_transform(range(1, w + 1), lambda i: g[i][i])) AS total FROM g0)"""
    for k in range(1, number + 1):
        steps += f""",
q{k} AS (SELECT e, w, 0 AS n, list_transform(g, lambda a: list_transform(a, lambda v: v / d)) AS m
         FROM (SELECT *, list_sum(list_transform(range(1, w + 1), lambda i: g[i][i])) AS d FROM g{k - 1})
         UNION ALL SELECT e, w, n + 1, list_transform(m2, lambda a: list_transform(a, lambda v: v / d))
         FROM (SELECT *, list_sum(list_transform(range(1, w + 1), lambda i: m2[i][i])) AS d
               FROM (SELECT e, w, n, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS m2 FROM q{k} WHERE n < {squarings}))),
d{k} AS (SELECT e, w, m, list_transform(range(1, w + 1), lambda i: m[i][i]) AS d FROM q{k} WHERE n = {squarings}),
u{k} AS (SELECT e, w, list_transform(m[list_position(d, list_max(d))], lambda v: v / sqrt(list_max(d))) AS u FROM d{k}),
l{k} AS (SELECT e, w, g, u, list_sum(list_transform(range(1, w + 1), lambda i: u[i] * list_dot_product(g[i], u))) AS val FROM u{k} JOIN g{k - 1} USING (e, w)),
g{k} AS (SELECT e, w, list_transform(range(1, w + 1), lambda i: list_transform(range(1, w + 1), lambda j: g[i][j] - val * u[i] * u[j])) AS g FROM l{k})"""
    parts = " UNION ALL ".join(f"SELECT e, w, {k} AS k, val, list_transform(u, lambda v: (v - list_avg(u)) / sqrt(val)) AS a FROM l{k}" for k in range(1, number + 1))
    return steps + f", comp AS (SELECT p.*, val / total AS share FROM ({parts}) p JOIN tr USING (e))"


PCA_SQL = f"""
WITH RECURSIVE {RETURNS_SQL}{components_sql("max(t) + 1", 1, 2)},
v AS (SELECT k, inst, sum(a[t + 1] * x) AS v FROM x, comp GROUP BY k, inst),
f AS (SELECT t, k, sum(v * o) AS f FROM x JOIN v USING (inst) GROUP BY t, k),
p AS (SELECT t, inst, sum(f * v) AS p FROM f JOIN v USING (k) GROUP BY t, inst)
SELECT {PANEL_KEYS}, round(o, 6) AS o, round(o - p, 6) AS residual FROM x JOIN p USING (t, inst)
"""


@register("pca_residual", PCA_SQL)
def pca_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves within the month without the first two components of monthly returns."""
    made = factors.pca_residual(return_panel(spark, sf_dir), "o", "r", factors=2)
    return keyed(made, *rounded(o=F.coalesce("o", F.lit(0.0)), residual=F.col("residual")))


VARIANCES_SQL = f"""
WITH RECURSIVE {RETURNS_SQL}{components_sql(24, 12, 2)}
SELECT CAST(ts AS DATE) AS ts, k, round(val / (w - 1), 6) AS variance, round(share, 6) AS share
FROM comp JOIN (SELECT DISTINCT t AS e, ts FROM x) USING (e)
"""


@register("factor_variances", VARIANCES_SQL)
def factor_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances of the two leading factors of two-year windows."""
    made = factors.factor_variances(return_panel(spark, sf_dir), "r", 2, 24, 12)
    return made.select(F.col("ts").cast("date").alias("ts"), "k", *rounded(variance=F.col("variance"), share=F.col("share")))


HEDGED_SQL = f"""
WITH RECURSIVE {RETURNS_SQL}{components_sql(24, 6, 1, scaled=True)},
v AS (SELECT e, share, inst, CASE WHEN any_value(s) > 1e-8 THEN sum(a[t - e + w] * xe.x) / any_value(s) ELSE 0 END AS v
      FROM comp JOIN xe USING (e, w) JOIN me USING (e, inst) GROUP BY e, share, inst),
y AS (SELECT x.*, CASE WHEN t >= 24 THEN (23 + (t - 24) // 6 * 6)::INT END AS e FROM x),
hb AS (SELECT t, sum(v * o) AS b, sum(v * v) AS m, max(share) AS share, count(v) AS n FROM y JOIN v USING (e, inst) WHERE o <> 0 GROUP BY t),
h AS (SELECT y.t, ts, inst, o, n, CASE WHEN n >= 3 AND o * (o - v * b / (1 / (hb.share * 2) + m)) > 0 THEN o - v * b / (1 / (hb.share * 2) + m) ELSE 0 END AS h
      FROM y LEFT JOIN v USING (e, inst) LEFT JOIN hb ON y.t = hb.t)
SELECT {PANEL_KEYS}, round(o, 6) AS o, round(CASE WHEN n >= 3 AND sum(abs(h)) OVER (PARTITION BY t) > 1e-10 THEN h / sum(abs(h)) OVER (PARTITION BY t) ELSE o END, 6) AS hedged FROM h
"""


@register("hedged_weights", HEDGED_SQL)
def hedged_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves within the month as weights, hedged against the first component of the two years before."""
    made = factors.hedged_weights(return_panel(spark, sf_dir), "o", "r", factors=1, window=24, every=6, lag=1, strength=2.0)
    return keyed(made, *rounded(o=F.coalesce("o", F.lit(0.0)), hedged=F.col("hedged")))


def industry_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alpha, ts, r): mean move within the month of each industry, at most a half per instrument, as an alpha's return."""
    made = return_panel(spark, sf_dir).where(F.col("o").isNotNull())
    return written(made.groupBy(F.col("industry").alias("alpha"), "ts").agg(F.avg(clip(F.col("o"), -0.5, 0.5)).alias("r")), "industries")


RULES = optimise.Programme(aversion=2.0, shrink=0.5, ridge=0.01)
QP_SQL = f"""
WITH RECURSIVE {RETURNS_SQL},
f AS (SELECT industry AS alpha, t, avg(least(greatest(ret.o, -0.5), 0.5)) AS r FROM x JOIN ret USING (inst, ts) WHERE ret.o IS NOT NULL GROUP BY industry, t),
ends AS (SELECT unnest(range(24, n, 6)) AS e FROM (SELECT max(t) + 1 AS n FROM x)),
names AS (SELECT e, alpha FROM ends JOIN f ON t >= e - 24 AND t < e GROUP BY e, alpha HAVING count(*) >= 2),
cells AS (SELECT e, alpha, unnest(range(e - 24, e)) AS t FROM names),
win AS (SELECT e, alpha, list(coalesce(r, 0) ORDER BY t) AS r, avg(coalesce(r, 0)) AS m FROM cells LEFT JOIN f USING (alpha, t) GROUP BY e, alpha),
cen AS (SELECT e, alpha, m, list_transform(r, lambda v: v - m) AS c FROM win),
cov AS (SELECT a.e, a.alpha, a.m, list(list_dot_product(a.c, b.c) / 23 * (CASE WHEN a.alpha = b.alpha THEN 1 ELSE 0.5 END) + (CASE WHEN a.alpha = b.alpha THEN 0.01 ELSE 0 END) ORDER BY b.alpha) AS s
        FROM cen a JOIN cen b USING (e) GROUP BY a.e, a.alpha, a.m),
pro AS (SELECT e, list(alpha ORDER BY alpha) AS names, list(m ORDER BY alpha) AS m, list(s ORDER BY alpha) AS s,
          1 / (2 * max(list_sum(list_transform(s, lambda v: abs(v))))) AS step FROM cov GROUP BY e),
it AS (SELECT e, 0 AS n, list_transform(m, lambda v: 1.0::DOUBLE / len(m)) AS w FROM pro
       UNION ALL
       SELECT e, n + 1, list_transform(v, lambda q: greatest(q - (list_sum(u[1:rho]) - 1) / rho, 0))
       FROM (SELECT e, n, v, u, list_max(list_filter(range(1, len(u) + 1), lambda j: u[j] > (list_sum(u[1:j]) - 1) / j)) AS rho
             FROM (SELECT e, n, v, list_sort(v, 'DESC') AS u
                   FROM (SELECT e, n, list_transform(range(1, len(w) + 1), lambda i: w[i] + step * (m[i] - 2 * list_dot_product(s[i], w))) AS v FROM it JOIN pro USING (e) WHERE n < 3000)))),
got AS (SELECT e, unnest(names) AS alpha, unnest(w) AS w FROM it JOIN pro USING (e) WHERE n = 3000)
SELECT CAST(ts AS DATE) AS ts, alpha, round(w, 6) AS w FROM got JOIN (SELECT DISTINCT t AS e, ts FROM x) USING (e)
"""


@register("qp_weights", QP_SQL)
def qp_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-only mean-variance weights of industries, solved anew every half year from the two years before."""
    made = optimise.rolling_weights(industry_returns(spark, sf_dir), 24, 6, RULES)
    return made.select(F.col("ts").cast("date").alias("ts"), "alpha", (F.round("w", 6) + 0.0).alias("w"))


QP_COST_SQL = f"""
WITH {RETURNS_SQL},
f AS (SELECT industry AS alpha, t FROM x JOIN ret USING (inst, ts) WHERE ret.o IS NOT NULL GROUP BY industry, t),
ends AS (SELECT unnest(range(24, n, 6)) AS e FROM (SELECT max(t) + 1 AS n FROM x)),
names AS (SELECT e, alpha FROM ends JOIN f ON f.t >= e - 24 AND f.t < e GROUP BY e, alpha HAVING count(*) >= 2)
SELECT CAST(ts AS DATE) AS ts, count(*) AS names, 1.0::DOUBLE AS total, 0.0::DOUBLE AS gap
FROM names JOIN (SELECT DISTINCT t AS e, ts FROM x) USING (e) GROUP BY ts
"""


@register("qp_turnover", QP_COST_SQL)
def qp_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights that pay for the change from the rebalance before: their number, sum and distance from optimal.

    Optimality is judged by the conditions that the weights must meet, from returns and weights alone.
    """
    rules = replace(RULES, cost=0.02)
    returns = industry_returns(spark, sf_dir)
    made = written(optimise.rolling_weights(returns, 24, 6, rules, chained=True), "weights")
    line = Window.partitionBy("alpha").orderBy("ts")
    # every alpha is in every programme from its first one on; before the first rebalance weights are equal
    first = F.col("ts") == F.min("ts").over(Window.partitionBy(F.lit(0)))
    even = F.when(first, 1 / F.count("*").over(Window.partitionBy("ts"))).otherwise(0.0)
    own = made.withColumn("previous", F.coalesce(F.lag("w").over(line), even))
    gap = optimise.optimality_gap(own, returns, 24, rules)
    total = made.groupBy("ts").agg(F.count("*").alias("names"), F.round(F.sum("w"), 6).alias("total"))
    return total.join(gap, "ts").select(F.col("ts").cast("date").alias("ts"), "names", "total", F.round("gap", 6).alias("gap"))


FIT = rff.Fit(features=3, horizon=2, window=26, every=6, warmup=30, ridge=40.0, least_rows=20)
FIELDS = ["o", "size", "width", "volume"]


def _row(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}" for v in values) + "]"


RFF_SQL = f"""
WITH RECURSIVE {RETURNS_SQL},
c0 AS (SELECT inst, ts, least(greatest(coalesce(r, 0), -0.5), 0.5) AS r, o, CASE WHEN dollars > 0 THEN ln(dollars) END AS size, (high - low) / close AS width, volume FROM ret),
z AS (SELECT inst, ts, t, r, [{", ".join(f"coalesce(CASE WHEN count(c0.{f}) OVER w >= 5 AND stddev_pop(c0.{f}) OVER w >= 1e-10 AND c0.{f} IS NOT NULL THEN least(greatest((c0.{f} - avg(c0.{f}) OVER w) / stddev_pop(c0.{f}) OVER w, -5), 5) END, 0)" for f in FIELDS)}] AS x
      FROM c0 JOIN (SELECT DISTINCT ts, t FROM x) USING (ts) WINDOW w AS (PARTITION BY ts)),
p AS (SELECT inst, ts, t, [list_dot_product(x, d) FOR d IN [{", ".join(_row(d) for d in rff.directions(len(FIELDS), FIT.features, FIT.seed))}]] AS p,
        lead(r, 1) OVER l + lead(r, 2) OVER l AS y FROM z WINDOW l AS (PARTITION BY inst ORDER BY t)),
f AS (SELECT inst, ts, t, least(greatest(CASE WHEN y IS NOT NULL THEN y END, -0.1), 0.1) AS y, y IS NOT NULL AS known,
        list_concat([sin(v) / sqrt(3) FOR v IN p], [cos(v) / sqrt(3) FOR v IN p]) AS f FROM p),
ends AS (SELECT unnest(range(30, n, 6)) AS e FROM (SELECT max(t) + 1 AS n FROM x)),
cell AS (SELECT e, i, j, sum(f[i] * f[j]) + CASE WHEN i = j THEN 40 ELSE 0 END AS a, sum(f[i] * y) AS c, count(*) AS n
         FROM ends JOIN f ON t >= e - 26 AND t < e - 2 AND known, range(1, 7) ri(i), range(1, 7) rj(j) GROUP BY e, i, j),
line AS (SELECT e, i, n, list(a ORDER BY j) AS a, any_value(c) AS c FROM cell GROUP BY e, i, n),
eq AS (SELECT e, list(a ORDER BY i) AS a, list(c ORDER BY i) AS c, max(list_sum(list_transform(a, lambda v: abs(v)))) AS top FROM line WHERE n >= 20 GROUP BY e),
it AS (SELECT e, 0 AS k, [0.0::DOUBLE FOR v IN c] AS b FROM eq
       UNION ALL SELECT e, k + 1, list_transform(range(1, 7), lambda i: b[i] + (c[i] - list_dot_product(a[i], b)) / top) FROM it JOIN eq USING (e) WHERE k < 2500),
beta AS (SELECT e, b FROM it WHERE k = 2500)
SELECT {PANEL_KEYS}, round(list_dot_product(f, b), 6) AS predicted FROM f LEFT JOIN beta ON e = 30 + (t - 30) // 6 * 6 AND t >= 30
"""


@register("rff_forecast", RFF_SQL)
def rff_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-month returns forecast by ridge regressions on random features, refitted every half year."""
    panel = return_panel(spark, sf_dir)
    size, width = log(F.col("dollars")), over(F.col("high") - F.col("low"), F.col("close"))
    panel = panel.select("ts", "inst", clip(F.coalesce("r", F.lit(0.0)), -0.5, 0.5).alias("r"), "o", size.alias("size"), width.alias("width"), "volume")
    return keyed(rff.rff_predict(panel, FIELDS, "r", FIT), *rounded(predicted=F.col("predicted")))
