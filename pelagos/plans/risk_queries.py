"""Registered queries of factor risk, joint intercepts, ranks and decoded returns, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagos.functions.elementwise import clip, over
from pelagos.operators import rolling_fit
from pelagos.plans import risk
from pelagos.plans.factor_queries import RETURNS_SQL, return_panel
from pelagos.plans.fold_queries import named_signals, signals_sql
from pelagos.plans.queries import PANEL_KEYS, keyed, register, rounded
from pelagos.plans.selection import neutral_returns
from pelagos.scratch import written

SECTORS = 5
EXPOSURES = [*(f"sector_{i}" for i in range(SECTORS)), "size"]


def exposed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly returns, at most a half, with sector dummies and size in deviations of the month."""
    made = return_panel(spark, sf_dir)
    size = F.when(F.col("dollars") > 0, F.log("dollars"))
    each = Window.partitionBy("ts")
    size = F.coalesce(over(size - F.avg(size).over(each), F.stddev_samp(size).over(each)), F.lit(0.0))
    dummies = [(F.col("sector") == i).cast("double").alias(f"sector_{i}") for i in range(SECTORS)]
    return written(made.select("ts", "inst", clip(F.coalesce("r", F.lit(0.0)), -0.5, 0.5).alias("r"), *dummies, size.alias("size")), "exposed")


_FACTORS_SQL = f"""{RETURNS_SQL},
ln0 AS (SELECT inst, ts, sector, least(greatest(coalesce(r, 0), -0.5), 0.5) AS r, CASE WHEN dollars > 0 THEN ln(dollars) END AS ld FROM ret),
ex AS (SELECT inst, t, ts, ln0.r, [{", ".join(f"(sector = {i})::INT::DOUBLE" for i in range(SECTORS))}, coalesce((ld - avg(ld) OVER w) / nullif(stddev_samp(ld) OVER w, 0), 0)] AS b
       FROM ln0 JOIN x USING (inst, ts) WINDOW w AS (PARTITION BY ts)),
cell AS (SELECT t, i, j, sum(b[i] * b[j]) + CASE WHEN i = j THEN 1 ELSE 0 END AS a, sum(b[i] * r) AS c FROM ex, range(1, 7) ri(i), range(1, 7) rj(j) GROUP BY t, i, j),
line AS (SELECT t, i, list(a ORDER BY j) AS a, any_value(c) AS c FROM cell GROUP BY t, i),
eq AS (SELECT t, list(a ORDER BY i) AS a, list(c ORDER BY i) AS c, max(list_sum(list_transform(a, lambda v: abs(v)))) AS top FROM line GROUP BY t),
it AS (SELECT t, 0 AS k, [0.0::DOUBLE FOR v IN c] AS f FROM eq
       UNION ALL SELECT t, k + 1, list_transform(range(1, 7), lambda i: f[i] + (c[i] - list_dot_product(a[i], f)) / top) FROM it JOIN eq USING (t) WHERE k < 1500),
fac AS (SELECT t, f FROM it WHERE k = 1500)"""
_MEMORY = "(CASE WHEN s.t = 0 THEN 1 ELSE 1 - power(0.5, 1.0 / 6) END) * power(0.5, (e.t - s.t) / 6.0)"
FACTOR_RISK_SQL = f"""WITH RECURSIVE {_FACTORS_SQL}
SELECT CAST(ts AS DATE) AS ts, i::INT AS i, j::INT AS j, round(sum({_MEMORY} * s.f[i] * s.f[j]), 7) AS cov
FROM fac e JOIN fac s ON s.t <= e.t, range(1, 7) ri(i), range(1, 7) rj(j), (SELECT DISTINCT t AS tt, ts FROM x) WHERE tt = e.t AND i <= j GROUP BY ts, i, j"""


@register("factor_risk", FACTOR_RISK_SQL)
def factor_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decaying covariance of sector and size factors, a half-life of half a year, in blocks of ten months."""
    found = risk.factor_risk(risk.factor_returns(exposed_panel(spark, sf_dir), "r", EXPOSURES, 1.0), 6.0, 10)
    k = len(EXPOSURES)
    cells = found.select("ts", F.posexplode("cov").alias("at", "cov"))
    cells = cells.select(F.col("ts").cast("date").alias("ts"), (F.floor(F.col("at") / k) + 1).cast("int").alias("i"), (F.col("at") % k + 1).cast("int").alias("j"), F.round("cov", 7).alias("cov"))
    return cells.where("i <= j")


SPECIFIC_RISK_SQL = f"""WITH RECURSIVE {_FACTORS_SQL},
rest AS (SELECT inst, ts, t, power(r - list_dot_product(b, f), 2) AS q FROM ex JOIN fac USING (t))
SELECT CAST(e.ts AS DATE) AS ts, inst, round(sum({_MEMORY} * s.q), 7) AS variance FROM rest e JOIN rest s USING (inst) WHERE s.t <= e.t GROUP BY e.ts, inst"""


@register("specific_risk", SPECIFIC_RISK_SQL)
def specific_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decaying variance of what sector and size factors leave of an instrument's returns."""
    panel = exposed_panel(spark, sf_dir)
    found = risk.specific_risk(panel, "r", EXPOSURES, risk.factor_returns(panel, "r", EXPOSURES, 1.0), 6.0)
    return keyed(found, F.round("variance", 7).alias("variance"))


def _minor(i: int, j: int) -> str:
    """Signed minor of a symmetric three by three matrix m."""
    r, c = [k for k in (1, 2, 3) if k != i], [k for k in (1, 2, 3) if k != j]
    sign = "" if (i + j) % 2 == 0 else "-"
    return f"{sign}(m[{r[0]}][{c[0]}] * m[{r[1]}][{c[1]}] - m[{r[0]}][{c[1]}] * m[{r[1]}][{c[0]}])"


ALPHAS = ["body", "busy", "trend_3"]
_MARKET_SQL = f"""{signals_sql()},
mk AS (SELECT t, avg(ret) AS m FROM cols WHERE ret IS NOT NULL GROUP BY t),
raw AS (SELECT alpha, t, sum(h * ret) AS r FROM hel WHERE alpha IN ({", ".join(f"'{a}'" for a in ALPHAS)}) GROUP BY alpha, t),
ok AS (SELECT t FROM raw JOIN mk USING (t) WHERE r IS NOT NULL GROUP BY t HAVING count(*) = 3),
cr AS (SELECT alpha, t, r, m FROM raw JOIN mk USING (t) JOIN ok USING (t)),
reg AS (SELECT alpha, regr_intercept(r, m) AS a, regr_slope(r, m) AS b, count(*) AS n, avg(m) AS mm, var_pop(m) AS vp FROM cr GROUP BY alpha),
e AS (SELECT alpha, t, r - a - b * m AS e FROM cr JOIN reg USING (alpha)),
cv AS (SELECT p.alpha AS pa, q.alpha AS qa, covar_samp(p.e, q.e) AS c FROM e p JOIN e q USING (t) GROUP BY ALL),
ma AS (SELECT list(line ORDER BY pa) AS m FROM (SELECT pa, list(c ORDER BY qa) AS line FROM cv GROUP BY pa)),
v AS (SELECT list(a ORDER BY alpha) AS a, max(n) AS n, max(mm) AS mm, max(vp) AS vp FROM reg)"""
JOINT_SQL = f"""WITH {_MARKET_SQL}
SELECT 3 AS k, n, round(n / 3.0 * (n - 4) / (n - 2) * ({" + ".join(f"a[{i}] * a[{j}] * {_minor(i, j)}" for i in (1, 2, 3) for j in (1, 2, 3))})
  / (m[1][1] * {_minor(1, 1)} + m[1][2] * {_minor(1, 2)} + m[1][3] * {_minor(1, 3)}) / (1 + mm * mm / vp), 6) AS f FROM v, ma"""


def _three(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    signals = named_signals(spark, sf_dir)
    market = signals.where(F.col("alpha") == ALPHAS[0]).groupBy("ts").agg(F.avg("ret").alias("m"))
    return signals.where(F.col("alpha").isin(ALPHAS)), market


@register("joint_intercepts", JOINT_SQL)
def joint_intercepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistic of the test that three signals earn nothing beside the market."""
    signals, market = _three(spark, sf_dir)
    return risk.joint_intercepts(neutral_returns(signals), market).select("k", "n", F.round("f", 6).alias("f"))


def scaled_positions(signals: DataFrame) -> DataFrame:
    """(ts, alpha, inst, w): signals without their mean, scaled to one."""
    each = Window.partitionBy("alpha", "ts")
    made = signals.withColumn("d", F.col("s") - F.avg("s").over(each))
    return made.select("ts", "alpha", "inst", over(F.col("d"), F.sum(F.abs("d")).over(each)).alias("w"))


RANK_SQL = f"""WITH {signals_sql()},
gg AS (SELECT p.t, sum(p.w * p.w) AS a, sum(p.w * q.w) AS b, sum(q.w * q.w) AS c FROM sca p JOIN sca q ON p.t = q.t AND p.inst = q.inst AND p.alpha = 'body' AND q.alpha = 'busy' WHERE p.w IS NOT NULL AND q.w IS NOT NULL GROUP BY p.t),
l AS (SELECT t, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS u, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS v FROM gg)
SELECT CAST(ts AS DATE) AS ts, round(CASE WHEN v <= 1e-10 * u THEN 1 ELSE exp(-(u / (u + v) * ln(u / (u + v)) + v / (u + v) * ln(v / (u + v)))) END, 6) AS rank
FROM l JOIN (SELECT DISTINCT t, ts FROM cols) USING (t)"""


@register("position_rank", RANK_SQL)
def position_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many independent signals two of them amount to, month by month."""
    made = risk.position_rank(scaled_positions(named_signals(spark, sf_dir).where(F.col("alpha").isin(["body", "busy"]))))
    return made.select(F.col("ts").cast("date").alias("ts"), F.round("rank", 6).alias("rank"))


_INVERSE = "[" + ", ".join("[" + ", ".join(f"({_minor(i, j)}) / det" for j in (1, 2, 3)) + "]" for i in (1, 2, 3)) + "]"
_DET = f"(m[1][1] * {_minor(1, 1)} + m[1][2] * {_minor(1, 2)} + m[1][3] * {_minor(1, 3)})"
DECODED_SQL = f"""WITH {signals_sql()},
pos AS (SELECT t, alpha, inst, coalesce(w, 0) AS w FROM sca WHERE alpha IN ({", ".join(f"'{a}'" for a in ALPHAS)})),
live AS (SELECT t FROM sca WHERE w IS NOT NULL AND alpha IN ({", ".join(f"'{a}'" for a in ALPHAS)}) GROUP BY t),
raw AS (SELECT alpha, t, sum(h * ret) AS r FROM hel WHERE alpha IN ({", ".join(f"'{a}'" for a in ALPHAS)}) GROUP BY alpha, t),
ex AS (SELECT alpha, t, avg(r) OVER (PARTITION BY alpha ORDER BY t ROWS 11 PRECEDING) AS e FROM raw),
es AS (SELECT t, list(coalesce(e, 0) ORDER BY alpha) AS e FROM ex GROUP BY t),
cl AS (SELECT p.t, p.alpha AS i, q.alpha AS j, sum(p.w * q.w) AS g FROM pos p JOIN pos q ON p.t = q.t AND p.inst = q.inst JOIN live ON live.t = p.t GROUP BY ALL),
ln1 AS (SELECT t, i, list(g ORDER BY j) AS line FROM cl GROUP BY t, i),
gr AS (SELECT t, list(line ORDER BY i) AS g FROM ln1 GROUP BY t),
m1 AS (SELECT t, g, e, [[g[i][j] + CASE WHEN i = j THEN 0.01 ELSE 0 END FOR j IN [1, 2, 3]] FOR i IN [1, 2, 3]] AS m FROM gr JOIN es USING (t)),
m2 AS (SELECT *, {_DET} AS det FROM m1),
m3 AS (SELECT t, g, e, {_INVERSE} AS inv FROM m2),
rs AS (SELECT t, g, e, [e[i] - list_dot_product(g[i], [list_dot_product(inv[k], e) FOR k IN [1, 2, 3]]) FOR i IN [1, 2, 3]] AS rest FROM m3),
vr AS (SELECT [var_pop(rest[1]), var_pop(rest[2]), var_pop(rest[3])] AS v FROM rs WHERE t < (SELECT max(t) FROM rs)),
w1 AS (SELECT g, e, [sqrt(list_avg(v) / x) FOR x IN v] AS root FROM rs, vr WHERE t = (SELECT max(t) FROM rs)),
w2 AS (SELECT e, root, [[root[i] * g[i][j] * root[j] + CASE WHEN i = j THEN 0.01 ELSE 0 END FOR j IN [1, 2, 3]] FOR i IN [1, 2, 3]] AS m FROM w1),
w3 AS (SELECT *, {_DET} AS det FROM w2),
w4 AS (SELECT e, root, {_INVERSE} AS inv FROM w3),
y AS (SELECT unnest({ALPHAS}) AS alpha, unnest([root[i] * list_dot_product(inv[i], [root[k] * e[k] FOR k IN [1, 2, 3]]) FOR i IN [1, 2, 3]]) AS y FROM w4)
SELECT inst, round(sum(w * y), 6) AS r FROM sca JOIN y USING (alpha) WHERE w IS NOT NULL AND t = (SELECT max(t) FROM rs) GROUP BY inst"""


@register("decoded_returns", DECODED_SQL)
def decoded_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments' returns that explain what three signals have earned over the last year."""
    signals, _ = _three(spark, sf_dir)
    year = Window.partitionBy("alpha").orderBy("ts").rowsBetween(-11, 0)
    expected = neutral_returns(signals).select("ts", "alpha", F.avg("r").over(year).alias("e"))
    return risk.decoded_returns(scaled_positions(signals), expected, 0.01).select("inst", F.round("r", 6).alias("r"))


RESIDUAL_SQL = f"""WITH {signals_sql()},
raw AS (SELECT alpha, t, coalesce(sum(h * ret), 0) AS r FROM hel WHERE alpha IN ({", ".join(f"'{a}'" for a in ALPHAS)}) GROUP BY alpha, t),
ex AS (SELECT alpha, t, r, avg(r) OVER (PARTITION BY alpha ORDER BY t ROWS 5 PRECEDING) AS e FROM raw),
en AS (SELECT unnest(range(23, n)) AS c FROM (SELECT max(t) + 1 AS n FROM ex)),
wi AS (SELECT c, alpha, t, r, e FROM en JOIN ex ON t > c - 24 AND t <= c),
st AS (SELECT c, alpha, avg(r) AS mu, stddev_samp(r) AS s FROM wi GROUP BY c, alpha),
ce AS (SELECT c, alpha, list(r - mu ORDER BY t) AS x, list(e ORDER BY t) AS y, any_value(s) AS s, arg_max(r - mu, t) AS xl, arg_max(e, t) AS el FROM wi JOIN st USING (c, alpha) GROUP BY c, alpha),
pr AS (SELECT p.c, p.alpha, p.xl, list(list_dot_product(p.x, q.x) ORDER BY q.alpha) AS m, list(list_dot_product(p.x, q.y) ORDER BY q.alpha) AS k FROM ce p JOIN ce q USING (c) GROUP BY ALL),
al AS (SELECT c, list(m ORDER BY alpha) AS m, list(k ORDER BY alpha) AS k, list(xl ORDER BY alpha) AS xl FROM pr GROUP BY c),
d3 AS (SELECT *, {_DET} AS det FROM al),
iv AS (SELECT c, k, xl, {_INVERSE} AS inv FROM d3),
zz AS (SELECT c, k, [list_dot_product(inv[i], xl) FOR i IN [1, 2, 3]] AS z FROM iv),
tl AS (SELECT c, unnest({ALPHAS}) AS alpha, unnest([z[1] * k[1][j] + z[2] * k[2][j] + z[3] * k[3][j] FOR j IN [1, 2, 3]]) AS told FROM zz),
rw AS (SELECT c, alpha, (told / s - el / s) / s AS raw FROM tl JOIN ce USING (c, alpha))
SELECT CAST(ts AS DATE) AS ts, alpha, round(raw / sum(raw) OVER (PARTITION BY c), 5) AS w FROM rw JOIN (SELECT DISTINCT t AS c, ts FROM cols) USING (c)"""


@register("residual_weights", RESIDUAL_SQL)
def residual_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of three signals by what two years of their returns leave of their expectations."""
    signals, _ = _three(spark, sf_dir)
    half = Window.partitionBy("alpha").orderBy("ts").rowsBetween(-5, 0)
    returns = neutral_returns(signals).select("alpha", "ts", F.coalesce("r", F.lit(0.0)).alias("r"))
    made = rolling_fit.residual_weights(returns.withColumn("e", F.avg("r").over(half)), 24)
    return made.select(F.col("ts").cast("date").alias("ts"), "alpha", F.round("w", 5).alias("w"))
