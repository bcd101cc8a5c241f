"""Streams that begin warm: keyed state filled from a batch table, and dropped for keys that fall silent.

A key's state is its last outcomes, in order of event time.  The initial state comes from history that a batch job has
reduced to what the state holds, so a stream that starts, or starts anew without its checkpoint, goes on as if it had
seen that history.  An event-time timer ``idle`` after a key's last row drops its state, so keys that stay away cost
nothing; should they come back, they begin anew.  State needs the RocksDB store: call ``use_keyed_state`` once.

Edge cases
    late rows       a row behind the watermark, or not newer than the key's last one, is left out
    equal times     of a key: ordered by alpha, each counted
    null symbol     one key; a null time or outcome is left out
    repeated seed   history rows are ordered by time and alpha; only the last ``lookback`` of each alpha are kept
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE = "10 minutes"
_OUT = "symbol string, ts timestamp, alpha string, weight double"


def use_keyed_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def weights_of(past: dict[str, list[float]], top: int) -> dict[str, float]:
    """Positive means scaled to one; where there is none, equal shares of the ``top`` best, ties by name."""
    means = {n: sum(s) / len(s) for n, s in past.items() if s}
    raw = {n: m for n, m in means.items() if m > 0} or {n: 1.0 for n in sorted(means, key=lambda n: (-means[n], n))[:top]}
    total = sum(raw.values())
    return {n: w / total for n, w in sorted(raw.items())}


class _Weights(StatefulProcessor):
    def __init__(self, lookback: int, top: int, idle_ms: int):
        self.lookback, self.top, self.idle_ms = lookback, top, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.past = handle.getMapState("past", "alpha string", "nets array<double>")
        self.last = handle.getValueState("last", "micros long")

    def _seen(self, last: pd.Timestamp) -> None:
        """The key's last row, and a timer from there instead of the one before."""
        self.last.update((last.value // 1000,))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(last.value // 1_000_000 + self.idle_ms)

    def _add(self, rows: pd.DataFrame) -> dict[str, list[float]]:
        past = {k[0]: list(v[0]) for k, v in self.past.iterator()}
        for alpha, net in zip(rows["alpha"], rows["net"], strict=True):
            past[alpha] = [*past.get(alpha, []), float(net)][-self.lookback :]
        for alpha in set(rows["alpha"]):
            self.past.updateValue((alpha,), (past[alpha],))
        return past

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = initialState.sort_values(["ts", "alpha"], kind="stable")
        self._add(rows)
        self._seen(rows["ts"].max().as_unit("ns"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).dropna(subset=["ts", "alpha", "net"]).sort_values(["ts", "alpha"], kind="stable")
        if self.last.exists():
            fresh = fresh[fresh["ts"] > pd.Timestamp(self.last.get()[0], unit="us")]
        if len(fresh):
            past = self._add(fresh)
            self._seen(fresh["ts"].max().as_unit("ns"))
            made = weights_of(past, self.top)
            yield pd.DataFrame([(key[0], fresh["ts"].max(), n, w) for n, w in made.items()], columns=["symbol", "ts", "alpha", "weight"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.past.clear()
        self.last.clear()
        yield pd.DataFrame([(key[0], pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), None, None)], columns=["symbol", "ts", "alpha", "weight"])

    def close(self) -> None:
        pass


def seed(history: DataFrame, lookback: int) -> DataFrame:
    """The rows of a batch history (symbol, ts, alpha, net) that a state of ``lookback`` outcomes holds."""
    newest = Window.partitionBy("symbol", "alpha").orderBy(F.desc("ts"))
    made = history.select("symbol", "ts", "alpha", "net").where("ts IS NOT NULL AND alpha IS NOT NULL AND net IS NOT NULL")
    return made.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= lookback).drop("place")


def warm_weights(outcomes: DataFrame, history: DataFrame | None = None, lookback: int = 50, top: int = 3, idle: str = "7 days", late: str = LATE) -> DataFrame:
    """Weights of a symbol's alphas after each batch of its outcomes; a row without alpha tells that its state was dropped.

    ``outcomes`` is a stream of symbol, ts, alpha and net; ``history`` a batch table of the same columns.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = outcomes.select("symbol", "ts", "alpha", "net").withWatermark("ts", late)
    first = seed(history, lookback).groupBy("symbol") if history is not None else None
    return rows.groupBy("symbol").transformWithStateInPandas(
        _Weights(lookback, top, idle_ms), _OUT, "Update", "EventTime", initialState=first
    )
