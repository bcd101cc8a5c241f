"""Streaming candles: closed bars, duplicates, windows and settlement; keyed weights with state are in ``warm``.

The source is any streaming DataFrame with a JSON ``value``; a watermark bounds every state but that of
``running_accuracy``, which keeps a row per symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDLE = "k struct<s:string,t:long,o:string,h:string,l:string,c:string,v:string,q:string,n:long,x:boolean>"
LATE = "10 minutes"


def parse(raw: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Closed candles of known symbols from messages ``{"k": {...}}``; open bars and malformed messages are dropped."""
    k = F.from_json(F.col("value").cast("string"), CANDLE)["k"]
    made = raw.select(k.alias("k")).where("k.x AND k.s IS NOT NULL AND k.t IS NOT NULL")
    if symbols:
        made = made.where(F.col("k.s").isin(symbols))
    price = [F.col(f"k.{a}").try_cast("double").alias(b) for a, b in zip("ohlcvq", ("open", "high", "low", "close", "volume", "quote_volume"), strict=True)]
    return made.select(F.col("k.s").alias("symbol"), F.timestamp_millis("k.t").alias("ts"), *price, F.col("k.n").alias("trades"))


def deduplicated(candles: DataFrame, late: str = LATE) -> DataFrame:
    """One candle per symbol and bar; events later than the watermark are dropped."""
    return candles.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "ts"])


def windowed(ticks: DataFrame, every: str, late: str = LATE, slide: str | None = None) -> DataFrame:
    """Open, high, low, close and volume per symbol and tumbling (or sliding) window of (symbol, ts, price, size).

    Ticks of equal time follow each other by ``event`` if there is such a column, else by price.
    """
    order = F.struct("ts", "event" if "event" in ticks.columns else "price")
    w = F.window("ts", every, slide) if slide else F.window("ts", every)
    made = ticks.withWatermark("ts", late).groupBy("symbol", w.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("size").alias("volume"),
    )
    return made.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sessions(ticks: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    made = ticks.withWatermark("ts", late).groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("ticks"))
    return made.select("symbol", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "ticks")


def settled(positions: DataFrame, outcomes: DataFrame, late: str = LATE) -> DataFrame:
    """Positions opened at a bar with the outcome of the next: a stream-stream join on (symbol, settle_ts)."""
    a = positions.withWatermark("settle_ts", late)
    b = outcomes.withWatermark("ts", late).select(F.col("symbol").alias("of"), F.col("ts").alias("at"), "outcome")
    same = (a["symbol"] == b["of"]) & (a["settle_ts"] == b["at"])
    return a.join(b, same).select("symbol", "settle_ts", "side", "outcome", (F.col("side") * F.col("outcome")).alias("pnl"))


def running_accuracy(results: DataFrame) -> DataFrame:
    """Per symbol: results, wins and win rate; for update or complete mode."""
    return results.groupBy("symbol").agg(F.count("*").alias("n"), F.sum((F.col("pnl") > 0).cast("int")).alias("wins"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))
