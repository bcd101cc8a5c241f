"""Registered queries of combiners, evaluation, text fields and time alignment, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pelagos.operators import aggregates as agg
from pelagos.operators import joins
from pelagos.plans import backtest as bt
from pelagos.plans import combiners as cb
from pelagos.plans import evaluation as ev
from pelagos.plans.queries import _BARS, _FACTORS, _SIGNAL, PANEL_KEYS, PANEL_SQL, QUERIES, _alphas, _bars, _c, _signal_panel, keyed, register, rounded
from pelagos.sources import files
from pelagos.sources import panel as src


def _returns(spark, sf_dir) -> DataFrame:
    return bt.factor_returns(_alphas(spark, sf_dir), 5.0)


def _series(df: DataFrame, *columns) -> DataFrame:
    return df.select("alpha", F.col("ts").cast("date").alias("ts"), *columns)


_KEYS = "alpha, CAST(ts AS DATE) AS ts"


def _share_sql(x: str) -> str:
    return f"coalesce({x} / nullif(sum({x}) OVER (PARTITION BY ts), 0), 0)"


_WEIGHTS = f"""{_FACTORS}, sc AS (SELECT alpha, ts, CASE WHEN count(r) OVER w >= 6 THEN round(avg(r) OVER w, 12) END AS m, CASE WHEN count(r) OVER w >= 6 THEN round(sum(r) OVER w, 12) END AS total,
  CASE WHEN count(r) OVER w >= 6 THEN stddev_samp(r) OVER w END AS v FROM f WINDOW w AS (PARTITION BY alpha ORDER BY ts ROWS 11 PRECEDING)),
ch AS (SELECT alpha, ts, CASE WHEN m > 0 THEN m ELSE 0 END AS up, CASE WHEN total > 0 THEN total ELSE 0 END AS rise, CASE WHEN m > 0 THEN coalesce(1 / nullif(v, 0), 0) ELSE 0 END AS calm,
  CASE WHEN m > 0 AND row_number() OVER (PARTITION BY ts ORDER BY m DESC NULLS LAST, alpha) <= 2 THEN 1.0::DOUBLE ELSE 0 END AS chosen FROM sc),
rw AS (SELECT alpha, ts, {_share_sql('up')} AS adaptive, {_share_sql('rise')} AS momentum, {_share_sql('chosen')} AS top,
  {_share_sql('up')} * 0.5 + 0.5 / count(*) OVER (PARTITION BY ts) AS shrunk, {_share_sql('calm')} AS parity FROM ch)"""
_KINDS = ["adaptive", "momentum", "top", "shrunk", "parity"]


@register("rolling_weights", f"{_WEIGHTS} SELECT {_KEYS}, {', '.join(f'round({k}, 6) AS {k}' for k in _KINDS)} FROM rw")
def rolling_weights(spark, sf_dir):
    made = cb.rolling_weights(_returns(spark, sf_dir), 12, 6, 2)
    return _series(made, *(F.round(k, 6).alias(k) for k in _KINDS))


@register("smoothed_weights", f"""{_WEIGHTS}, n AS (SELECT *, row_number() OVER (PARTITION BY alpha ORDER BY ts) AS n FROM rw),
sm AS (SELECT a.alpha, a.ts, sum(power(0.5, (a.n - b.n) / 6.0::DOUBLE) * b.adaptive) / sum(power(0.5, (a.n - b.n) / 6.0::DOUBLE)) AS slow FROM n a JOIN n b ON a.alpha = b.alpha AND b.n <= a.n GROUP BY 1, 2)
SELECT {_KEYS}, round({_share_sql('slow')}, 6) AS w FROM sm""")
def smoothed_weights(spark, sf_dir):
    weights = cb.rolling_weights(_returns(spark, sf_dir), 12, 6, 2)
    return _series(cb.smoothed_weights(weights, "adaptive", 6.0), F.round("w", 6).alias("w"))


@register("ic_weights", f"""{_FACTORS}, hs AS (SELECT *, lag(s) OVER (PARTITION BY alpha, inst ORDER BY ts) AS hh FROM a),
rk AS (SELECT alpha, ts, rank() OVER (PARTITION BY alpha, ts ORDER BY hh) + (count(*) OVER (PARTITION BY alpha, ts, hh) - 1) / 2 AS x,
  rank() OVER (PARTITION BY alpha, ts ORDER BY ret) + (count(*) OVER (PARTITION BY alpha, ts, ret) - 1) / 2 AS y FROM (SELECT alpha, ts, round(hh, 9) AS hh, round(ret, 9) AS ret FROM hs) WHERE hh IS NOT NULL AND ret IS NOT NULL),
ic AS (SELECT alpha, ts, covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0) AS r FROM rk GROUP BY alpha, ts HAVING count(*) >= 5),
sc AS (SELECT alpha, ts, CASE WHEN count(r) OVER w >= 6 THEN greatest(round(avg(r) OVER w, 12), 0) ELSE 0 END AS up FROM ic WINDOW w AS (PARTITION BY alpha ORDER BY ts ROWS 11 PRECEDING))
SELECT {_KEYS}, round({_share_sql('up')}, 6) AS w FROM sc""")
def ic_weights(spark, sf_dir):
    """Weights by rolling rank correlation; values are rounded before ranking, as sums of doubles depend on their order."""
    signals = _alphas(spark, sf_dir).select("alpha", "ts", "inst", F.round("s", 9).alias("s"), F.round("ret", 9).alias("ret"))
    return _series(cb.rolling_weights(cb.ic_series(signals), 12, 6, 2), F.round("adaptive", 6).alias("w"))


@register("shut_off", f"""{_FACTORS} SELECT {_KEYS}, round(r, 6) AS r, round(CASE WHEN avg(r) OVER (PARTITION BY alpha ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) > 0 THEN r ELSE 0 END, 6) AS live FROM f""")
def shut_off(spark, sf_dir):
    return _series(cb.shut_off(_returns(spark, sf_dir), 12), *rounded(r=_c("r"), live=_c("live")))


def _ewm_sql(source: str, field: str, halflife: float, out: str) -> str:
    power = f"power(0.5, (a.n - b.n) / {halflife}::DOUBLE)"
    return f"SELECT a.ts, a.n, sum({power} * b.{field}) / sum({power}) FILTER (b.{field} IS NOT NULL) AS {out} FROM {source} a JOIN {source} b ON b.n <= a.n GROUP BY a.ts, a.n"


_MARKET = f"WITH {PANEL_SQL}{_SIGNAL}, m AS (SELECT ts, avg(ret) AS x FROM y GROUP BY ts)"


@register("market_series", f"""{_MARKET} SELECT CAST(ts AS DATE) AS ts, round(x, 6) AS x, round(avg(x) OVER w, 6) AS mean, round(CASE WHEN count(x) OVER w >= 2 THEN stddev_samp(x) OVER w END, 6) AS deviation
FROM m WINDOW w AS (ORDER BY ts ROWS 11 PRECEDING)""")
def market_series(spark, sf_dir):
    made = cb.market_series(_signal_panel(spark, sf_dir), "ret", 12)
    return made.select(F.col("ts").cast("date").alias("ts"), *rounded(x=_c("x"), mean=_c("mean"), deviation=_c("deviation")))


@register("regime_scale", f"""{_MARKET}, v AS (SELECT ts, row_number() OVER (ORDER BY ts) AS n, CASE WHEN count(x) OVER w >= 2 THEN stddev_samp(x) OVER w END AS v FROM m WINDOW w AS (ORDER BY ts ROWS 11 PRECEDING)),
e AS ({_ewm_sql('v', 'v', 6.0, 'vol')}), d AS (SELECT *, greatest(coalesce(median(vol) OVER (ORDER BY ts), 0.0001::DOUBLE), 0.0001::DOUBLE) AS middle FROM e),
q AS (SELECT ts, n, CASE WHEN vol IS NOT NULL THEN least(greatest(middle / nullif(vol, 0), 0.2::DOUBLE), 2.5::DOUBLE) END AS raw FROM d),
z AS ({_ewm_sql('q', 'raw', 4.0, 'scale')}) SELECT CAST(ts AS DATE) AS ts, round(scale, 6) AS scale FROM z""")
def regime_scale(spark, sf_dir):
    made = cb.regime_scale(_signal_panel(spark, sf_dir), "ret", 12, 6.0, 4.0)
    return made.select(F.col("ts").cast("date").alias("ts"), F.round("scale", 6).alias("scale"))


@register("section_selection", f"""WITH {PANEL_SQL} SELECT {PANEL_KEYS}, CASE WHEN volume IS NULL THEN 0.0::DOUBLE ELSE
  ((row_number() OVER (PARTITION BY ts ORDER BY volume DESC NULLS LAST, inst) <= 5)::INT - (row_number() OVER (PARTITION BY ts ORDER BY volume NULLS LAST, inst) <= 5)::INT) / 5.0::DOUBLE END AS side,
  round(CASE WHEN close - open IS NULL THEN NULL WHEN row_number() OVER (PARTITION BY ts ORDER BY abs(close - open) DESC NULLS LAST, inst) <= 8 THEN close - open ELSE 0 END, 6) AS capped FROM panel""")
def section_selection(spark, sf_dir):
    return keyed(src.monthly_panel(spark, sf_dir), cb.top_bottom(_c("volume"), 5).alias("side"), *rounded(capped=cb.capped_positions(_c("close") - _c("open"), 8)))


@register("volatility_hedge", f"""WITH {PANEL_SQL}{_SIGNAL}, v AS (SELECT *, CASE WHEN count(ret) OVER w >= 2 THEN stddev_samp(abs(ret)) OVER w END AS moves FROM y WINDOW w AS (PARTITION BY inst ORDER BY ts ROWS 11 PRECEDING))
SELECT {PANEL_KEYS}, round(moves / nullif(stddev_samp(moves) OVER (PARTITION BY ts), 0), 6) AS hedge FROM v""")
def volatility_hedge(spark, sf_dir):
    return keyed(cb.volatility_hedge(_signal_panel(spark, sf_dir), "ret", 12), F.round("hedge", 6).alias("hedge"))


def _decay_sql(keys: str, source: str) -> str:
    return f"""sg AS (SELECT {keys}, avg(r) FILTER (sample = 'in') AS im, avg(r) FILTER (sample = 'out') AS om, stddev_samp(r) FILTER (sample = 'in') AS iv, stddev_samp(r) FILTER (sample = 'out') AS ov,
  count_if(sample = 'in')::BIGINT AS in_n, count_if(sample = 'out')::BIGINT AS out_n FROM {source} GROUP BY {keys}),
sd AS (SELECT *, im / nullif(iv, 0) * sqrt(252) AS isr, om / nullif(ov, 0) * sqrt(252) AS osr FROM sg)
SELECT {keys}, in_n, out_n, round(isr, 6) AS in_sharpe, round(osr, 6) AS out_sharpe, round(coalesce(osr / nullif(isr, 0), 0), 6) AS sharpe_decay, round(coalesce(om / nullif(im, 0), 0), 6) AS mean_decay,
  CASE WHEN isr > 0 THEN coalesce(osr > 0, false) ELSE true END AS steady FROM sd"""


def _decayed(df: DataFrame, *keys: str) -> DataFrame:
    names = ["in_sharpe", "out_sharpe", "sharpe_decay", "mean_decay"]
    return df.select(*keys, "in_n", "out_n", *(F.round(n, 6).alias(n) for n in names), "steady")


@register("fixed_split", f"""{_FACTORS}, p AS (SELECT alpha, r, row_number() OVER (PARTITION BY alpha ORDER BY ts) AS place, floor(count(*) OVER (PARTITION BY alpha) * 0.7::DOUBLE) AS cut, count(*) OVER (PARTITION BY alpha) AS n FROM f),
sp AS (SELECT alpha, r, CASE WHEN place <= cut THEN 'in' ELSE 'out' END AS sample FROM p WHERE cut >= 20 AND n - cut >= 20), {_decay_sql('alpha', 'sp')}""")
def fixed_split(spark, sf_dir):
    return _decayed(ev.decay(ev.fixed_split(_returns(spark, sf_dir), 0.7, 20), ["alpha"]), "alpha")


@register("walk_forward", f"""{_FACTORS}, p AS (SELECT alpha, r, row_number() OVER (PARTITION BY alpha ORDER BY ts) - 1 AS place, count(*) OVER (PARTITION BY alpha) AS n FROM f),
fi AS (SELECT *, unnest(range(4)) AS i FROM p), fb AS (SELECT alpha, r, place, n - (i + 1) * 12 AS b, least((n - 36) // 12, 4) - i AS fold FROM fi WHERE i < least((n - 36) // 12, 4)),
sp AS (SELECT alpha, fold::INT AS fold, r, CASE WHEN place >= b THEN 'out' ELSE 'in' END AS sample FROM fb WHERE place >= b - 36 AND place < b + 12), {_decay_sql('alpha, fold', 'sp')}""")
def walk_forward(spark, sf_dir):
    return _decayed(ev.decay(ev.walk_forward(_returns(spark, sf_dir), 36, 12, 4), ["alpha", "fold"]), "alpha", "fold")


@register("result_gates", """SELECT o_orderkey, CASE WHEN s > 4.5 THEN 'Spectacular' WHEN s > 3.5 THEN 'Excellent' WHEN s > 3.0 THEN 'Good' WHEN s > 2.5 THEN 'Average' WHEN s >= 1.0 THEN 'Inferior' ELSE 'Poor' END AS rating,
CASE WHEN s IS NULL THEN 0 ELSE (s >= 1.25)::INT + (s >= 0.5)::INT + (s / 2 >= 1)::INT + (s / 2 >= 0.5)::INT + (s / 5 > 0.01 AND s / 5 < 0.7)::INT + (-s / 10 > -0.3)::INT + (s - 2 > 0)::INT + (abs(s - 1) > 0.1)::INT END AS passed
FROM (SELECT o_orderkey, o_totalprice / 1e5 AS s FROM orders)""")
def result_gates(spark, sf_dir):
    """Ratings and gates over orders, whose totals stand for Sharpe ratios."""
    s = F.col("o_totalprice") / 1e5
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", ev.rating(s).alias("rating"), ev.passed_gates(s, s / 2, s / 5, -s / 10, s - 2, s - 1).alias("passed"))


@register("equity_curve", f"""{_FACTORS} SELECT {_KEYS}, round(product(1 + coalesce(r, 0)) OVER (PARTITION BY alpha ORDER BY ts), 6) AS equity FROM f""")
def equity_curve(spark, sf_dir):
    return _series(ev.equity(_returns(spark, sf_dir)), F.round("equity", 6).alias("equity"))


@register("directional_pnl", f"""WITH {PANEL_SQL}{_SIGNAL}, d AS (SELECT ts, inst, ret, coalesce(sign(round(signal, 9)), 0)::DOUBLE AS side FROM y)
SELECT {PANEL_KEYS}, side, round(side * coalesce(ret, 0) - abs(side - coalesce(lag(side) OVER (PARTITION BY inst ORDER BY ts), 0)) * 7 / 1e4, 6) + 0.0 AS pnl FROM d""")
def directional_pnl(spark, sf_dir):
    panel = _signal_panel(spark, sf_dir).withColumn("signal", F.round("signal", 9))
    return keyed(ev.directional_pnl(panel, "signal", "ret", 7.0), "side", (F.round("pnl", 6) + 0.0).alias("pnl"))


@register("correlation_with", f"""WITH {PANEL_SQL}{_SIGNAL} SELECT inst, round(covar_samp(volume, ret) / nullif(stddev_samp(volume) * stddev_samp(ret), 0), 6) AS corr, count(*) AS n
FROM y WHERE volume IS NOT NULL AND ret IS NOT NULL GROUP BY inst HAVING count(*) >= 3""")
def correlation_with(spark, sf_dir):
    return ev.correlation_with(_signal_panel(spark, sf_dir), "volume", "ret").select("inst", F.round("corr", 6).alias("corr"), "n")


@register("log_fit", """SELECT round(regr_slope(price, ln(n)), 4) AS slope, round(regr_intercept(price, ln(n)), 4) AS intercept, round(regr_r2(price, ln(n)), 6) AS r2
FROM (SELECT count(*) AS n, avg(o_totalprice) / 1e5 AS price FROM orders GROUP BY o_custkey)""")
def log_fit(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.avg("o_totalprice") / 1e5).alias("price"))
    return ev.log_fit(points, "price", "n").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"))


@register("granger", f"""WITH {PANEL_SQL}{_SIGNAL}, l AS (SELECT inst, ret AS y, lag(ret) OVER s AS z, lag(volume) OVER s AS x FROM y WINDOW s AS (PARTITION BY inst ORDER BY ts)),
cg AS (SELECT inst, corr(y, x) AS yx, corr(y, z) AS yz, corr(x, z) AS xz, count(*) AS n FROM l WHERE y IS NOT NULL AND z IS NOT NULL AND x IS NOT NULL GROUP BY inst HAVING count(*) >= 8),
p AS (SELECT inst, n, power(yx - yz * xz, 2) / nullif((1 - yz * yz) * (1 - xz * xz), 0) AS q FROM cg) SELECT inst, n, round(q / (1 - q) * (n - 3), 5) AS f FROM p""")
def granger(spark, sf_dir):
    """Whether volume helps to tell the next return, per instrument; the tests check the probabilities."""
    made = ev.granger(_signal_panel(spark, sf_dir), "ret", "volume", ["inst"]).where("n >= 8")
    return made.select("inst", "n", F.round("f", 5).alias("f"))


@register("statement_asof", """WITH st AS (SELECT o_custkey AS k, o_totalprice AS v, coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 40 END, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS DATE) + 31 END,
  CAST(o_orderdate AS DATE) + 90) AS known FROM orders), u AS (SELECT k, known, max(v) AS v FROM st GROUP BY 1, 2), c AS (SELECT c_custkey AS k, DATE '1998-06-30' AS day FROM customer)
SELECT c.k, round(v, 2) AS v, known FROM c ASOF LEFT JOIN u ON c.k = u.k AND c.day >= u.known""")
def statement_asof(spark, sf_dir):
    """Each customer's last statement known on a day: orders as statements, accepted, filed or neither by status."""
    day = F.to_date("o_orderdate")
    stated = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderdate",
        F.when(_c("o_orderstatus") == "F", F.date_add(day, 40)).alias("accepted"), F.when(_c("o_orderstatus") == "O", F.date_add(day, 30)).alias("filed"),
    )
    known = stated.withColumn("day", joins.known_from("o_orderdate", "filed", "accepted")).withColumn("known", F.col("day"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.lit("1998-06-30").cast("date").alias("day"))
    made = joins.asof_backward(customers, known.select("k", "day", "v", "known"), ["k"], "day", ["v", "known"])
    return made.select("k", F.round("v", 2).alias("v"), "known")


@register("higher_timeframe", f"""WITH {_BARS}, d AS (SELECT inst, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(close, ts) AS close FROM k GROUP BY 1, 2),
l AS (SELECT inst, ts, lag(close) OVER (PARTITION BY inst ORDER BY ts) AS slow FROM d)
SELECT k.inst, epoch(k.ts)::BIGINT AS at, round(slow, 6) AS slow, CAST((floor(epoch(k.ts) / 86400) + 1) * 86400 AS BIGINT) AS settles FROM k ASOF LEFT JOIN l ON k.inst = l.inst AND k.ts >= l.ts""")
def higher_timeframe(spark, sf_dir):
    """Six-hour candles with the last complete day's close, and the second at which a daily contract settles."""
    bars = _bars(spark, sf_dir)
    made = joins.higher_timeframe(bars, agg.ohlc_resample(bars, "1 day", ["inst"]), ["inst"], "ts", ["close"])
    return made.select("inst", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.round("slow_close", 6).alias("slow"), joins.contract_end("ts", 86400).alias("settles"))


@register("ladder_fill", """WITH l AS (SELECT l_orderkey, l_extendedprice / l_quantity AS p, l_quantity AS q, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / l_quantity, l_quantity ROWS UNBOUNDED PRECEDING) - l_quantity AS done FROM lineitem)
SELECT l_orderkey, round(sum(least(q, greatest(60 - done, 0))), 6) AS filled, round(sum(least(q, greatest(60 - done, 0)) * p), 4) AS cost FROM l GROUP BY l_orderkey""")
def ladder_fill(spark, sf_dir):
    """Sixty units taken from each order's lines, cheapest first; an order has a handful of lines."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    levels = line.groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"))).alias("levels"))
    made = levels.select("l_orderkey", files.ladder_fill(F.col("levels"), F.lit(60.0)).alias("x"))
    return made.select("l_orderkey", F.round("x.filled", 6).alias("filled"), F.round("x.cost", 4).alias("cost"))


@register("text_fields", r"""SELECT p_partkey, trim(regexp_replace(lower(concat_ws(' ', p_name, p_brand, p_type)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, contains(lower(p_name), 'ring') AS has_ring,
regexp_matches(upper(replace(p_name, ' ', '')), '^[A-Z]{1,4}$') OR regexp_matches(upper(replace(p_name, ' ', '')), '^[A-Z]{4}[A-PSTV]$') AS plain,
substr(code, 1, 2) AS sector, substr(code, 1, 4) AS "group", substr(code, 1, 6) AS industry, CASE WHEN length(code) >= 8 THEN substr(code, 1, 8) END AS sub_industry
FROM (SELECT *, CAST(p_partkey * 37 + 1000000 AS VARCHAR) || CASE WHEN p_size > 25 THEN '7' ELSE '' END AS code FROM part)""")
def text_fields(spark, sf_dir):
    code = F.concat((F.col("p_partkey") * 37 + 1000000).cast("string"), F.when(F.col("p_size") > 25, "7").otherwise(""))
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("code", code)
    symbol = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    return part.select("p_partkey", files.slug(_c("p_name"), _c("p_brand"), _c("p_type")).alias("slug"), F.col("p_name").ilike("%ring%").alias("has_ring"),
                       files.plain_ticker(symbol).alias("plain"), *files.group_levels(F.col("code")))


@register("rebalance_days", """SELECT CAST(min(o_orderdate) AS DATE) AS day, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, count(DISTINCT o_custkey) AS customers
FROM orders WHERE isodow(o_orderdate) <= 5 AND o_orderdate >= '1996-01-01' AND o_orderdate < '2000-01-01' GROUP BY date_trunc('month', o_orderdate)""")
def rebalance_days(spark, sf_dir):
    """First market day of each month of four years, with the month's market days and customers."""
    orders = files.between(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", "1996-01-01", "2000-01-01").where(files.is_weekday(F.col("o_orderdate")))
    month = F.trunc("o_orderdate", "month")
    first = files.rebalance_days(orders.select(F.to_date("o_orderdate").alias("ts"))).select(F.trunc("ts", "month").alias("month"), F.col("ts").alias("day"))
    counts = orders.groupBy(month.alias("month")).agg(F.count_distinct(F.to_date("o_orderdate")).alias("days"), F.count_distinct("o_custkey").alias("customers"))
    return first.join(counts, "month").select("day", "days", "customers")


_FUND = "volume * 10 AS market_cap, close - open AS eps, dollars - 40000 AS equity, dollars AS enterprise_value, volume - 50 AS ebitda, high - low AS income, volume AS assets, close AS debt"


@register("fundamental_ratios", f"""WITH {PANEL_SQL}, x AS (SELECT ts, inst, close, {_FUND} FROM panel) SELECT {PANEL_KEYS}, round(greatest(market_cap / nullif(close, 0), 0.001::DOUBLE), 6) AS sharesout,
""" + ", ".join(f"round(CASE WHEN {b} != 0 THEN least(greatest({a} / nullif({b}, 0), {lo}::DOUBLE), {hi}::DOUBLE) END, 6) + 0.0 AS {n}" for n, a, b, lo, hi in files.RATIOS[1:]) + " FROM (SELECT * FROM x WHERE close IS NOT NULL)")  # fmt: skip
def fundamental_ratios(spark, sf_dir):
    """Ratios of fields that the bars stand for, where there is a bar."""
    panel = src.monthly_panel(spark, sf_dir).where("close IS NOT NULL").selectExpr("ts", "inst", "close", *_FUND.split(", "))
    return keyed(files.fundamental_ratios(panel), *((F.round(r[0], 6) + 0.0).alias(r[0]) for r in files.RATIOS))


@register("profile_filter", """SELECT p_partkey, CASE WHEN name IS NULL THEN 'no_profile' WHEN regexp_matches(lower(name), '\\b(etf|fund|trust units)\\b') THEN 'fund' WHEN contains(lower(name), 'reit') THEN 'reit'
WHEN regexp_matches(lower(name), '\\b(shell|blank check|acquisition corp)\\b') THEN 'shell' WHEN date_diff('day', listed, DATE '2001-01-01') < 365 THEN 'new' END AS reason
FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN p_name || ' ETF' WHEN 2 THEN p_name || ' Reit' WHEN 3 THEN 'Shell ' || p_name ELSE p_name END AS name, DATE '1999-01-01' + p_size * 20 AS listed FROM part)""".replace("\\\\", "\\"))
def profile_filter(spark, sf_dir):
    """Why a part, as an instrument with a made-up name and listing, is left out."""
    size, name = F.col("p_size") % 5, F.col("p_name")
    made = F.when(size == 1, F.concat(name, F.lit(" ETF"))).when(size == 2, F.concat(name, F.lit(" Reit"))).when(size == 3, F.concat(F.lit("Shell "), name)).when(size == 4, name)
    listed = F.date_add(F.lit("1999-01-01").cast("date"), F.col("p_size") * 20)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", files.profile_reason(made, listed, F.lit("2001-01-01").cast("date")).alias("reason"))


__all__ = ["QUERIES"]
