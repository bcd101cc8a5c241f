"""Candle signals: columns over open, high, low, close, volume and taker volume of each instrument's bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions import timeseries as ts
from pelagos.functions.elementwise import div_fill, over


def _c(name: str) -> Column:
    return F.col(name)


def momentum(n: int) -> Column:
    return F.log(_c("close") / F.lag("close", n).over(ts.series()))


def body_ratio() -> Column:
    return div_fill(_c("close") - _c("open"), _c("high") - _c("low"))


def close_position(n: int) -> Column:
    low, high = ts.ts_min(_c("low"), n), ts.ts_max(_c("high"), n)
    return div_fill(_c("close") - low, high - low, 0.5)


def upper_shadow() -> Column:
    return div_fill(_c("high") - F.greatest("open", "close"), _c("high") - _c("low"))


def lower_shadow() -> Column:
    return div_fill(F.least("open", "close") - _c("low"), _c("high") - _c("low"))


def price_vs_mean(n: int) -> Column:
    """Missing where the window holds no price: a price that is not there is not at its mean."""
    mean = ts.ts_mean(_c("close"), n)
    return F.when(mean.isNotNull(), div_fill(_c("close"), mean, 1.0) - 1)


def macd(fast: int, slow: int) -> Column:
    """Difference of simple means, relative to price."""
    return div_fill(ts.ts_mean(_c("close"), fast) - ts.ts_mean(_c("close"), slow), _c("close"))


def volume_ratio(n: int) -> Column:
    return div_fill(_c("volume"), ts.ts_mean(_c("volume"), n), 1.0)


def parkinson(n: int) -> Column:
    """Volatility from the logarithm of high over low."""
    return F.sqrt(F.avg(F.pow(F.log(_c("high") / _c("low")), 2)).over(ts.trailing(n)) / (4 * F.log(F.lit(2.0))))


def rsi(gain: str, loss: str, n: int) -> Column:
    """From named columns of upward and downward changes; 50 without any change."""
    up, down = ts.ts_mean(_c(gain), n), ts.ts_mean(_c(loss), n)
    return F.when(up + down > 0, 100 * up / F.when(up + down > 0, up + down)).otherwise(50.0)


def bollinger(n: int, k: float = 2.0) -> Column:
    return div_fill(_c("close") - ts.ts_mean(_c("close"), n), k * ts.stddev(_c("close"), n))


def range_expansion(n: int) -> Column:
    return div_fill(_c("high") - _c("low"), ts.ts_mean(_c("high") - _c("low"), n), 1.0)


def obv_step() -> Column:
    """Signed volume; its running total is on-balance volume."""
    return F.signum(_c("close") - F.lag("close").over(ts.series())) * _c("volume")


def serial_correlation(x: str, lagged: str, n: int) -> Column:
    return ts.correlation(_c(x), _c(lagged), n)


def _rolling(x: Column, n: int, make=F.avg, least: int | None = None) -> Column:
    """Over the last ``n`` rows, from half of them (two at least) unless told otherwise."""
    w = ts.trailing(n)
    return ts.at_least(max(n // 2, 2) if least is None else least, x, w, make(x).over(w))


def library(bars: DataFrame, short: int = 6, long: int = 12, smooth: int = 3) -> DataFrame:
    """``bars`` with every signal of the library for one set of windows, delayed by one bar.

    Needs open, high, low, close, volume, dollars and taker (bought volume).  Signals are centred at zero; those named
    reversal are negated, so high means expected up.  Three stages of windows over one exchange.
    """
    spread, change = _c("high") - _c("low"), ts.delta(_c("close"), 1)
    made = bars.withColumns({
        "r": ts.pct_change(_c("close")), "d": change,
        "pos": div_fill(_c("close") - _c("low"), spread, 0.5) - 0.5, "body_now": body_ratio(), "upper_now": upper_shadow(),
        "lower_now": lower_shadow(), "bought": div_fill(_c("taker"), _c("volume"), 0.5), "lhl": F.pow(F.log(_c("high") / _c("low")), 2),
    })
    some = F.when(_c("d").isNotNull(), F.greatest(_c("d"), F.lit(0.0))), F.when(_c("d").isNotNull(), F.greatest(-_c("d"), F.lit(0.0)))
    made = made.withColumns({"obv": ts.running_total(F.signum("d") * _c("volume")), "up": some[0], "down": some[1]})
    close, r, volume = _c("close"), _c("r"), _c("volume")
    mean, deviation = _rolling(close, long), _rolling(close, long, F.stddev_samp)
    low, high = _rolling(_c("low"), long, F.min), _rolling(_c("high"), long, F.max)
    surge = div_fill(volume, _rolling(volume, long), 1.0)
    park = lambda n: F.sqrt(_rolling(_c("lhl"), n) / (4 * F.log(F.lit(2.0))))
    vwap = _rolling(_c("dollars"), long, F.sum, 2) / _rolling(volume, long, F.sum, 2)
    strength = div_fill(_rolling(_c("up"), long), _rolling(_c("down"), long), 1.0)
    signals = {
        "return_mean": _rolling(r, long), "return_z": over(close - mean, deviation), "place_in_range": _rolling(_c("pos"), smooth, least=1),
        "body": _rolling(_c("body_now"), smooth, least=1), "upper": -_rolling(_c("upper_now"), smooth, least=1),
        "lower": _rolling(_c("lower_now"), smooth, least=1), "above_mean": (close - mean) / mean, "donchian": div_fill(close - low, high - low, 0.5) - 0.5,
        "trend": div_fill(_rolling(r, long), _rolling(F.abs(r), long), 0.0), "macd": _rolling(r, short) - _rolling(r, long),
        "volume_ratio": surge - 1, "taker_ratio": _rolling(_c("bought"), short, least=1) - 0.5, "taker_delta": _c("bought") - _rolling(_c("bought"), short),
        "volume_confirms": r * surge, "obv_momentum": over(_c("obv") - _rolling(_c("obv"), long), F.abs(_rolling(_c("obv"), long))),
        "volatility_regime": div_fill(_rolling(r, short, F.stddev_samp), _rolling(r, long, F.stddev_samp), 1.0) - 1,
        "range_expansion": over(spread - _rolling(spread, long), _rolling(spread, long)), "parkinson_ratio": div_fill(park(short), park(long), 1.0) - 1,
        "bollinger_reversal": -over(close - mean, deviation), "rsi_reversal": -((100 - 100 / (1 + strength)) - 50) / 50,
        "momentum_taker": (over(close, F.lag("close", short).over(ts.series())) - 1) * _c("bought"), "vwap_deviation": (close - vwap) / vwap,
        "momentum_scaled": div_fill(_rolling(r, short), _rolling(r, long, F.stddev_samp), 0.0),
    }
    made = made.select("*", *(c.alias(f"now_{n}") for n, c in signals.items()))
    return made.select(*bars.columns, *(F.lag(f"now_{n}").over(ts.series()).alias(n) for n in signals))
