"""Registered queries of signal libraries and recursions, with their SQL twins: evaluated in stages, as windows do not nest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions import candles
from pelagos.functions import elementwise as ew
from pelagos.functions import timeseries as ts
from pelagos.operators import aggregates as agg
from pelagos.operators import sequential
from pelagos.plans import backtest as bt
from pelagos.plans.queries import _SIGNAL, PANEL_KEYS, PANEL_SQL, QUERIES, keyed, register, reversal, rounded
from pelagos.sources import panel as src


def _c(name: str) -> Column:
    return F.col(name)


def _rolling(expression: str, n: int, fn: str = "avg", least: int = 1) -> str:
    return f"(CASE WHEN count({expression}) OVER w{n} >= {least} THEN {fn}({expression}) OVER w{n} END)"


def _windows(*sizes: int) -> str:
    return "WINDOW s AS (PARTITION BY inst ORDER BY ts), " + ", ".join(
        f"w{n} AS (PARTITION BY inst ORDER BY ts ROWS {n - 1} PRECEDING)" for n in sorted(set(sizes))
    )


def _corr(a: str, b: str, n: int) -> str:
    both = f"CASE WHEN {{0}} IS NOT NULL THEN {{1}} END"  # noqa: F541
    a, b = both.format(b, a), both.format(a, b)
    return f"(CASE WHEN count(({a}) + ({b})) OVER w{n} >= 2 THEN covar_samp({a}, {b}) OVER w{n} / nullif(stddev_samp({a}) OVER w{n} * stddev_samp({b}) OVER w{n}, 0) END)"


_EPS = 1e-10

#: Window aggregates that the named expressions are made of: name, and column for a choice of window.
PARTS: dict[str, object] = {}


def _part(kind: str, x: str, n: int) -> Column:
    """The aggregate of a column over the last ``n`` rows, listed in ``PARTS`` so that each is computed once."""
    least = {"sd": 2, "mean2": 2}.get(kind, 1)
    make = {"mean": F.avg, "mean2": F.avg, "sd": F.stddev_samp, "low": F.min, "high": F.max, "sum": F.sum}[kind]

    def over_window(w):
        return make(x).over(w) if least == 1 else ts.at_least(least, _c(x), w, make(x).over(w))

    PARTS.setdefault(f"{kind}_{x}_{n}", (over_window, n))
    return _c(f"{kind}_{x}_{n}")


def _corr_part(x: str, y: str, n: int) -> Column:
    """Pearson correlation of complete pairs, from two; missing where a side is constant."""
    a, b = F.when(_c(y).isNotNull(), _c(x)), F.when(_c(x).isNotNull(), _c(y))
    parts = {"sd_a": lambda w: F.stddev_samp(a).over(w), "sd_b": lambda w: F.stddev_samp(b).over(w), "cov": lambda w: ts.at_least(2, _c(x) + _c(y), w, F.covar_samp(a, b).over(w))}
    for kind, made in parts.items():
        PARTS.setdefault(f"{kind}_{x}_{y}_{n}", (made, n))
    cov, left, right = (_c(f"{kind}_{x}_{y}_{n}") for kind in ("cov", "sd_a", "sd_b"))
    return ew.over(cov, left * right)


#: The families of the named expressions and their lookbacks.  Of each: name, lookbacks, column and SQL.
FAMILIES = [
    ("mom_{0}bar", [(90,), (120,), (180,), (240,)], lambda n: _part("mean", "r", n), lambda n: _rolling("r", n)),
    ("double_smooth_{0}_{1}", [(30, 90), (45, 120)], lambda a, b: _part("mean", f"smooth{a}", b), lambda a, b: _rolling(f"smooth{a}", b)),
    ("donchian_{0}", [(90,), (120,), (180,), (240,)],
     lambda n: (_c("close") - _part("low", "close", n)) / (_part("high", "close", n) - _part("low", "close", n) + _EPS),
     lambda n: f"(close - {_rolling('close', n, 'min')}) / ({_rolling('close', n, 'max')} - {_rolling('close', n, 'min')} + {_EPS})"),
    ("trend_strength_{0}", [(60,), (90,), (120,)], lambda n: _part("mean", "r", n) / (_part("mean", "size", n) + _EPS),
     lambda n: f"{_rolling('r', n)} / ({_rolling('abs(r)', n)} + {_EPS})"),
    ("mom_diff_{0}_{1}", [(30, 90), (60, 180), (90, 270)], lambda a, b: _part("mean", "r", a) - _part("mean", "r", b),
     lambda a, b: f"{_rolling('r', a)} - {_rolling('r', b)}"),
    ("sharpe_{0}", [(60,), (90,), (120,)], lambda n: _part("mean", "r", n) / (_part("sd", "r", n) + _EPS),
     lambda n: f"{_rolling('r', n)} / ({_rolling('r', n, 'stddev_samp', 2)} + {_EPS})"),
    ("trend_vol_adj_{0}", [(90,), (120,)], lambda n: _part("mean", "r", n) * (1 / (_part("sd", "r", n) + _EPS)),
     lambda n: f"{_rolling('r', n)} * (1 / ({_rolling('r', n, 'stddev_samp', 2)} + {_EPS}))"),
    ("vol_weighted_mom_{0}", [(60,), (90,), (120,)], lambda n: _part("mean", "traded", n), lambda n: _rolling("r * volume", n)),
    ("reversal_{1}day", [(6, 1), (12, 2), (18, 3), (24, 4), (30, 5)], lambda n, _: -_part("mean", "r", n), lambda n, _: f"-{_rolling('r', n)}"),
    ("zscore_rev_{0}", [(30,), (45,), (60,), (90,)],
     lambda n: -ew.over(_c("close") - _part("mean2", "close", n), _part("sd", "close", n)),
     lambda n: f"-(close - {_rolling('close', n, 'avg', 2)}) / nullif({_rolling('close', n, 'stddev_samp', 2)}, 0)"),
    ("buy_dip_{0}", [(30,), (45,), (60,)], lambda n: (_part("high", "high", n) - _c("close")) / (_part("high", "high", n) + _EPS),
     lambda n: f"({_rolling('high', n, 'max')} - close) / ({_rolling('high', n, 'max')} + {_EPS})"),
    ("fade_moves_{1}d", [(6, 1), (12, 2), (18, 3)], lambda n, _: -_part("high", "size", n), lambda n, _: f"-{_rolling('abs(r)', n, 'max')}"),
    ("low_vol_{0}", [(60,), (90,), (120,)], lambda n: -_part("sd", "r", n), lambda n: f"-{_rolling('r', n, 'stddev_samp', 2)}"),
    ("obv_{0}", [(60,), (90,), (120,)], lambda n: _part("sum", "signed", n), lambda n: _rolling("sign(r) * volume", n, "sum")),
    ("corr_ret_vol_{0}", [(60,), (90,)], lambda n: _corr_part("r", "volume", n), lambda n: _corr("r", "volume", n)),
    ("hl_corr_{0}", [(90,), (120,)], lambda n: _corr_part("high", "low", n), lambda n: _corr("high", "low", n)),
    ("price_vs_ma{0}", [(120,), (180,)], lambda n: ew.over(_c("close"), _part("mean", "close", n)), lambda n: f"close / nullif({_rolling('close', n)}, 0)"),
    ("ma{0}_vs_ma{1}", [(30, 90), (60, 180)], lambda a, b: ew.over(_part("mean", "close", a), _part("mean", "close", b)),
     lambda a, b: f"{_rolling('close', a)} / nullif({_rolling('close', b)}, 0)"),
    ("close_location_{0}", [(60,), (90,)], lambda n: _part("mean", "location", n),
     lambda n: _rolling(f"((close - low) / (high - low + {_EPS}))", n)),
    ("oc_position_{0}", [(60,)], lambda n: _part("mean", "moved", n),
     lambda n: _rolling(f"((close - open) / (high - low + {_EPS}))", n)),
]
NAMED = {name.format(*n): (column, sql, n) for name, sizes, column, sql in FAMILIES for n in sizes}
_SIZES = {n for _, _, own in NAMED.values() for n in own} | {30, 45}


def named_expressions(panel: DataFrame, times: int | None = None) -> DataFrame:
    """``panel`` with ``r``, the return of each row, and a column for each of the named expressions.

    ``times``: the rows of the longest series, if known.  A window of as many rows or more holds all rows so far, which
    Spark keeps up from row to row; a shorter one is gone through anew at every row.
    """
    whole = ts.so_far()
    window = lambda n: whole if times is not None and n >= times else ts.trailing(n)
    spread = _c("high") - _c("low") + _EPS
    made = panel.withColumn("r", ts.pct_change(_c("close")))
    made = made.withColumns({f"smooth{n}": F.avg("r").over(window(n)) for n in (30, 45)})
    made = made.withColumns({
        "size": F.abs("r"), "traded": _c("r") * _c("volume"), "signed": F.signum("r") * _c("volume"),
        "location": (_c("close") - _c("low")) / spread, "moved": (_c("close") - _c("open")) / spread,
    })
    expressions = {name: column(*n) for name, (column, _, n) in NAMED.items()}
    made = made.withColumns({name: part(window(n)) for name, (part, n) in PARTS.items()})
    return made.select(*panel.columns, "r", *(c.alias(name) for name, c in expressions.items()))


_NAMED_SQL = f"""WITH {PANEL_SQL}, q AS (SELECT *, close / nullif(lag(close) OVER s, 0) - 1 AS r, lead(open) OVER s / nullif(open, 0) - 1 AS ret FROM panel {_windows(1)}),
p AS (SELECT *, {_rolling('r', 30)} AS smooth30, {_rolling('r', 45)} AS smooth45 FROM q {_windows(30, 45)}),
e AS (SELECT ts, inst, ret, {', '.join(f'({sql(*n)})::DOUBLE AS "{name}"' for name, (_, sql, n) in NAMED.items())} FROM p {_windows(*_SIZES)}),
l AS (UNPIVOT e ON COLUMNS(* EXCLUDE (ts, inst, ret)) INTO NAME alpha VALUE v),
z AS (SELECT alpha, ts, round(v, 9) AS v, round(ret, 9) AS ret FROM l WHERE v IS NOT NULL AND ret IS NOT NULL),
k AS (SELECT alpha, ts, rank() OVER (PARTITION BY alpha, ts ORDER BY v) + (count(*) OVER (PARTITION BY alpha, ts, v) - 1) / 2 AS a,
        rank() OVER (PARTITION BY alpha, ts ORDER BY ret) + (count(*) OVER (PARTITION BY alpha, ts, ret) - 1) / 2 AS b FROM z)
SELECT alpha, CAST(ts AS DATE) AS ts, round(covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0), 6) AS ic, count(*) AS n FROM k GROUP BY alpha, ts HAVING count(*) >= 10"""


@register("batch_expressions_ic", _NAMED_SQL)
def batch_expressions_ic(spark, sf_dir):
    """Rank IC per time of the named expressions: one window stage, then one section per time.

    Values are rounded to nine decimals before they are ranked, as sums of doubles depend on their order.
    """
    panel = src.monthly_panel(spark, sf_dir).select("ts", "inst", "open", "high", "low", "close", "volume")
    # the panel is dense, so one instrument tells the rows of each
    one = src.groups(spark, sf_dir).agg(F.min("inst")).first()[0]
    times = panel.where(F.col("inst") == one).count()
    panel = named_expressions(bt.with_returns(panel, 1), times)
    panel = panel.select("ts", "inst", *(F.round(c, 9).alias(c) for c in ["ret", *NAMED]))
    made = agg.batch_ic(panel, list(NAMED), "ret")
    return made.select("alpha", F.col("ts").cast("date").alias("ts"), F.round("ic", 6).alias("ic"), "n")


def _staged(text: str) -> str:
    return f"WITH {PANEL_SQL}{text}"


def _half(n: int) -> int:
    return max(n // 2, 2)


def _fill(a: str, b: str, fill: float) -> str:
    return f"(CASE WHEN abs({b}) > 1e-10 THEN {a} / {b} ELSE {fill} END)"


_CANDLE_SQL = {
    "return_mean": _rolling("r", 12, "avg", 6),
    "return_z": f"(close - {_rolling('close', 12, 'avg', 6)}) / nullif({_rolling('close', 12, 'stddev_samp', 6)}, 0)",
    "place_in_range": _rolling("pos", 3),
    "body": _rolling("body", 3),
    "upper": f"-{_rolling('upper', 3)}",
    "lower": _rolling("lower", 3),
    "above_mean": f"(close - {_rolling('close', 12, 'avg', 6)}) / {_rolling('close', 12, 'avg', 6)}",
    "donchian": _fill(f"(close - {_rolling('low', 12, 'min', 6)})", f"({_rolling('high', 12, 'max', 6)} - {_rolling('low', 12, 'min', 6)})", 0.5) + " - 0.5",
    "trend": _fill(_rolling("r", 12, "avg", 6), _rolling("abs(r)", 12, "avg", 6), 0.0),
    "macd": f"{_rolling('r', 6, 'avg', 3)} - {_rolling('r', 12, 'avg', 6)}",
    "volume_ratio": _fill("volume", _rolling("volume", 12, "avg", 6), 1.0) + " - 1",
    "taker_ratio": f"{_rolling('tb', 6)} - 0.5",
    "taker_delta": f"tb - {_rolling('tb', 6, 'avg', 3)}",
    "volume_confirms": "r * " + _fill("volume", _rolling("volume", 12, "avg", 6), 1.0),
    "obv_momentum": f"(obv - {_rolling('obv', 12, 'avg', 6)}) / nullif(abs({_rolling('obv', 12, 'avg', 6)}), 0)",
    "volatility_regime": _fill(_rolling("r", 6, "stddev_samp", 3), _rolling("r", 12, "stddev_samp", 6), 1.0) + " - 1",
    "range_expansion": f"(high - low - {_rolling('(high - low)', 12, 'avg', 6)}) / nullif({_rolling('(high - low)', 12, 'avg', 6)}, 0)",
    "parkinson_ratio": _fill(f"sqrt({_rolling('lhl', 6, 'avg', 3)} / (4 * ln(2)))", f"sqrt({_rolling('lhl', 12, 'avg', 6)} / (4 * ln(2)))", 1.0) + " - 1",
    "bollinger_reversal": f"-(close - {_rolling('close', 12, 'avg', 6)}) / nullif({_rolling('close', 12, 'stddev_samp', 6)}, 0)",
    "rsi_reversal": f"-((100 - 100 / (1 + {_fill(_rolling('up', 12, 'avg', 6), _rolling('down', 12, 'avg', 6), 1.0)})) - 50) / 50",
    "momentum_taker": "(close / nullif(lag(close, 6) OVER s, 0) - 1) * tb",
    "vwap_deviation": f"(close - {_rolling('dollars', 12, 'sum', 2)} / {_rolling('volume', 12, 'sum', 2)}) / ({_rolling('dollars', 12, 'sum', 2)} / {_rolling('volume', 12, 'sum', 2)})",
    "momentum_scaled": _fill(_rolling("r", 6, "avg", 3), _rolling("r", 12, "stddev_samp", 6), 0.0),
}


@register("candle_library", _staged(f""", q AS (SELECT *, close / nullif(lag(close) OVER s, 0) - 1 AS r, close - lag(close) OVER s AS d, {_fill('(close - low)', '(high - low)', 0.5)} - 0.5 AS pos,
  {_fill('(close - open)', '(high - low)', 0.0)} AS body, {_fill('(high - greatest(open, close))', '(high - low)', 0.0)} AS upper, {_fill('(least(open, close) - low)', '(high - low)', 0.0)} AS lower,
  {_fill('(dollars / high)', 'volume', 0.5)} AS tb, ln(high / low) ** 2 AS lhl FROM panel {_windows(1)}),
y AS (SELECT *, sum(sign(d) * volume) OVER s AS obv, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS up, CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS down FROM q {_windows(1)}),
x AS (SELECT ts, inst, {', '.join(f'{sql} AS {name}' for name, sql in _CANDLE_SQL.items())} FROM y {_windows(3, 6, 12)})
SELECT {PANEL_KEYS}, {', '.join(f'round(lag({name}) OVER s, 6) + 0.0 AS {name}' for name in _CANDLE_SQL)} FROM x {_windows(1)}"""))
def candle_library(spark, sf_dir):
    """The candle signals of one parameter set, each known only from the bar after it."""
    panel = src.monthly_panel(spark, sf_dir).withColumn("taker", _c("dollars") / _c("high"))
    made = candles.library(panel, short=6, long=12, smooth=3)
    return keyed(made, *rounded(**{n: _c(n) for n in _CANDLE_SQL}))


@register("change_runs", _staged(""", p AS (SELECT *, round(volume, -2) AS v FROM panel), f AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY inst ORDER BY ts) THEN 0 ELSE 1 END AS st FROM p),
i AS (SELECT *, sum(st) OVER (PARTITION BY inst ORDER BY ts) AS island FROM f)
SELECT CAST(ts AS DATE) AS ts, inst, CAST(island AS BIGINT) AS run, row_number() OVER (PARTITION BY inst, island ORDER BY ts) - 1 AS days FROM i"""))
def change_runs(spark, sf_dir):
    panel = src.monthly_panel(spark, sf_dir).withColumn("v", F.round("volume", -2))
    made = ts.with_days_from_last_change(ts.with_change_run(panel, "v"), "v")
    return keyed(made, _c("run").cast("long").alias("run"), _c("days").cast("long").alias("days"))


@register("rolling_moment", _staged(f""", x AS (SELECT *, close - {_rolling('close', 10, 'avg', 2)} AS gap FROM panel {_windows(10)})
SELECT {PANEL_KEYS}, round({_rolling('power(gap, 3)', 10, 'avg', 2)} / 1e6, 6) AS third, round({_rolling('gap * gap', 10, 'avg', 2)} / 1e3, 6) AS second FROM x {_windows(10)}"""))
def rolling_moment(spark, sf_dir):
    made = ts.with_moment(ts.with_moment(src.monthly_panel(spark, sf_dir), "close", 10, 3, "third"), "close", 10, 2, "second")
    return keyed(made, *rounded(third=_c("third") / 1e6, second=_c("second") / 1e3))


@register("regression_fitted", _staged(f""" SELECT {PANEL_KEYS}, round(CASE WHEN count(close + volume) OVER p10 >= 3 AND row_number() OVER s > 10
THEN regr_intercept(close, volume) OVER p10 + volume * regr_slope(close, volume) OVER p10 END, 6) AS fitted FROM panel
WINDOW s AS (PARTITION BY inst ORDER BY ts), p10 AS (PARTITION BY inst ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""))
def regression_fitted(spark, sf_dir):
    return keyed(src.monthly_panel(spark, sf_dir), *rounded(fitted=ts.regression(_c("close"), _c("volume"), 10, "fitted")))


_STATE = ", o AS (SELECT ts, inst, signal, row_number() OVER (PARTITION BY inst ORDER BY ts) AS n FROM y)"


@register("dead_band", f"""WITH RECURSIVE {PANEL_SQL}{_SIGNAL}{_STATE},
h AS (SELECT ts, inst, n, CASE WHEN abs(signal) > 0.25 THEN signal ELSE 0.0 END AS held FROM o WHERE n = 1
UNION ALL SELECT o.ts, o.inst, o.n, CASE WHEN abs(signal - held) > 0.25 THEN signal ELSE held END FROM h JOIN o ON o.inst = h.inst AND o.n = h.n + 1)
SELECT CAST(ts AS DATE) AS ts, inst, round(held, 6) AS held FROM h""")
def dead_band(spark, sf_dir):
    panel = reversal(src.monthly_panel(spark, sf_dir)).select("ts", "inst", "signal")
    return keyed(sequential.dead_band(panel, "signal", 0.25), F.round("held", 6).alias("held"))


@register("threshold_positions", f"""WITH RECURSIVE {PANEL_SQL}{_SIGNAL}{_STATE}, v AS (SELECT ts, inst, n, signal - 0.5 AS x FROM o),
h AS (SELECT ts, inst, n, CASE WHEN abs(x) > 0.4 THEN sign(x)::DOUBLE ELSE 0.0 END AS side, CASE WHEN abs(x) > 0.4 THEN 0 ELSE 1 END AS age FROM v WHERE n = 1
UNION ALL SELECT ts, inst, n, CASE WHEN kept = 0 AND abs(x) > 0.4 THEN sign(x)::DOUBLE ELSE kept END, CASE WHEN kept = 0 AND abs(x) > 0.4 THEN 0 ELSE age END
FROM (SELECT v.ts, v.inst, v.n, x, h.age + 1 AS age, CASE WHEN side != 0 AND h.age + 1 > 2 AND x IS NOT NULL AND side * x < 0.1 THEN 0.0 ELSE side END AS kept
      FROM h JOIN v ON v.inst = h.inst AND v.n = h.n + 1))
SELECT CAST(ts AS DATE) AS ts, inst, side FROM h""")
def threshold_positions(spark, sf_dir):
    panel = reversal(src.monthly_panel(spark, sf_dir)).select("ts", "inst", (F.col("signal") - 0.5).alias("signal"))
    return keyed(sequential.threshold_positions(panel, "signal", 0.4, 0.1, 2), F.col("side"))


_OVER24 = "OVER (PARTITION BY inst ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"


@register("rolling_ridge", _staged(f""", k AS (SELECT *, close + open + volume IS NOT NULL AS ok FROM panel),
m AS (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY ts) AS n, count_if(ok) {_OVER24} AS c, sum(open * open) FILTER (ok) {_OVER24} + 1 AS aa, sum(open * volume) FILTER (ok) {_OVER24} AS ab,
  sum(volume * volume) FILTER (ok) {_OVER24} + 1 AS bb, sum(open * close) FILTER (ok) {_OVER24} AS ay, sum(volume * close) FILTER (ok) {_OVER24} AS byy FROM k)
SELECT CAST(ts AS DATE) AS ts, inst, round(CASE WHEN n > 24 AND c > 2 AND open + volume IS NOT NULL
  THEN open * (bb * ay - ab * byy) / (aa * bb - ab * ab) + volume * (aa * byy - ab * ay) / (aa * bb - ab * ab) END, 4) AS predicted FROM m"""))
def rolling_ridge(spark, sf_dir):
    panel = src.monthly_panel(spark, sf_dir).select("ts", "inst", "close", "open", "volume")
    return keyed(sequential.rolling_ridge(panel, "close", ["open", "volume"], 24, 1.0), F.round("predicted", 4).alias("predicted"))


@register("trade_costs", """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity * 40 AS shares, round(l_extendedprice / l_quantity, 2) AS price, l_returnflag = 'R' AS sell,
  sum(l_quantity * 40) OVER (PARTITION BY l_suppkey, date_trunc('month', l_shipdate) ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS monthly FROM lineitem),
c AS (SELECT *, CASE WHEN monthly <= 300000 THEN 0.0035 WHEN monthly <= 3000000 THEN 0.002 WHEN monthly <= 20000000 THEN 0.0015 WHEN monthly <= 100000000 THEN 0.001 ELSE 0.0005 END::DOUBLE AS rate FROM t),
f AS (SELECT *, greatest(0.35, least(shares * rate, 0.01 * shares * price)) AS commission, shares * 0.0003::DOUBLE
  + CASE WHEN sell THEN shares * price * 0.0000278::DOUBLE + least(shares * 0.000145::DOUBLE, 7.27) ELSE 0 END AS fees FROM c)
SELECT sell, count(*) AS trades, round(sum(commission), 2) AS commission, round(sum(fees), 2) AS fees, round(sum(commission + fees) / sum(shares * price) * 1e4, 4) AS bps FROM f GROUP BY sell""")
def trade_costs(spark, sf_dir):
    """Tiered commission and regulatory fees of every order line as a trade, by side."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = ts.Window.partitionBy("l_suppkey", F.date_trunc("month", "l_shipdate")).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    shares, price = F.col("l_quantity") * 40, F.round(F.col("l_extendedprice") / F.col("l_quantity"), 2)
    monthly = F.sum(shares).over(month.rowsBetween(ts.Window.unboundedPreceding, 0))
    trades = line.select(shares.alias("shares"), price.alias("price"), (F.col("l_returnflag") == "R").alias("sell"), monthly.alias("monthly"))
    own = trades.select("sell", (_c("shares") * _c("price")).alias("value"), bt.tiered_commission(_c("shares"), _c("price"), _c("monthly")).alias("commission"),
                        bt.regulatory_fees(_c("shares"), _c("price"), _c("sell")).alias("fees"))
    made = own.groupBy("sell").agg(F.count("*").alias("trades"), F.sum("commission").alias("c"), F.sum("fees").alias("f"), F.sum("value").alias("v"))
    return made.select("sell", "trades", F.round("c", 2).alias("commission"), F.round("f", 2).alias("fees"), F.round((_c("c") + _c("f")) / _c("v") * 1e4, 4).alias("bps"))


__all__ = ["QUERIES", "NAMED", "named_expressions"]
