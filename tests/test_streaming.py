import datetime as dt
import json

from pyspark.sql import functions as F

from pelagos.streaming import candles, warm


def message(symbol, minute, close, closed=True):
    k = {"s": symbol, "t": minute * 60_000, "T": 0, "o": "1", "h": "2", "l": "0.5", "c": str(close), "v": "3", "q": "4", "n": 5, "x": closed}
    return json.dumps({"k": k})


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def stream(spark, path, lines):
    path.mkdir()
    (path / "a.txt").write_text("\n".join(lines))
    return spark.readStream.text(str(path))


def test_closed_candles_without_duplicates(spark, tmp_path):
    lines = [message("A", 1, 10), message("A", 1, 10), message("A", 2, 11, closed=False), message("Z", 1, 9), "no json"]
    made = candles.deduplicated(candles.parse(stream(spark, tmp_path / "in", lines), ["A"]))
    assert [(r.symbol, r.close, r.trades) for r in run(made, "closed")] == [("A", 10.0, 5)]


def test_windows(spark, tmp_path):
    (tmp_path / "t").mkdir()
    rows = [("A", dt.datetime(2024, 1, 1, 0, m), float(m), 1) for m in (0, 1, 4, 6)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size int").write.parquet(str(tmp_path / "t" / "x"))
    ticks = spark.readStream.schema("symbol string, ts timestamp, price double, size int").parquet(str(tmp_path / "t" / "x"))
    made = run(candles.windowed(ticks, "5 minutes"), "bars", "complete")
    assert sorted((r.ts.minute, r.open, r.close, r.volume) for r in made) == [(0, 0.0, 4.0, 3), (5, 6.0, 6.0, 1)]


def test_adaptive_weights_keep_state(spark, tmp_path):
    rows = [("A", 1, "p", 1.0), ("A", 2, "p", 3.0), ("A", 1, "q", -1.0), ("A", 1, "r", 2.0)]
    df = spark.createDataFrame(rows, "symbol string, n int, alpha string, net double").withColumn("ts", F.timestamp_seconds("n"))
    df.select("symbol", "ts", "alpha", "net").write.parquet(str(tmp_path / "o"))
    outcomes = spark.readStream.schema("symbol string, ts timestamp, alpha string, net double").parquet(str(tmp_path / "o"))
    warm.use_keyed_state(spark)
    made = run(warm.warm_weights(outcomes, lookback=10), "weights", "update")
    assert {(r.alpha, r.weight) for r in made} == {("p", 0.5), ("r", 0.5)}


OUTCOME = "symbol string, ts timestamp, alpha string, net double"


def hour(i):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)


def outcomes(begin, end):
    return [(s, hour(i), a, float((i * 7 + 3 * k) % 11 - 2)) for i in range(begin, end) for k, a in enumerate("pqr") for s in ("A", None)]


def final(rows):
    """Last weights per symbol."""
    last = {}
    for r in rows:
        last[r.symbol] = max(last.get(r.symbol, r.ts), r.ts)
    return {(r.symbol, r.alpha): round(r.weight, 12) for r in rows if r.ts == last[r.symbol] and r.alpha}


def fed(spark, folder, parts, name, history=None, checkpoint=None, **rules):
    """Result of a stream that gets the parts one after the other, stopped and started anew between them."""
    warm.use_keyed_state(spark)
    (folder / "in").mkdir(parents=True, exist_ok=True)
    made = []
    for n, part in enumerate(parts):
        spark.createDataFrame(part, OUTCOME).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        stream = spark.readStream.schema(OUTCOME).parquet(str(folder / "in"))
        put = lambda batch, i: made.extend(batch.collect())
        q = warm.warm_weights(stream, history, lookback=4, **rules).writeStream.outputMode("update").option("checkpointLocation", str(checkpoint or folder / "state"))
        q.foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return made


def test_warm_start_and_restart_equal_one_run(spark, tmp_path):
    whole = final(fed(spark, tmp_path / "whole", [outcomes(0, 12)], "whole"))
    assert len(whole) > 2
    history = spark.createDataFrame(outcomes(0, 6) + [("A", None, "p", 1.0), ("A", hour(1), "p", None)], OUTCOME)
    warmed = fed(spark, tmp_path / "warm", [outcomes(6, 12)], "warm", history)
    assert final(warmed) == whole
    restarted = fed(spark, tmp_path / "again", [outcomes(6, 9), outcomes(9, 12)], "again", history)
    assert final(restarted) == whole
    cold = fed(spark, tmp_path / "cold", [outcomes(9, 12)], "cold")
    assert final(cold) != whole


def test_late_rows_are_left_out_and_idle_keys_dropped(spark, tmp_path):
    parts = [
        [("A", hour(1), "p", 1.0), ("B", hour(1), "p", 3.0)],
        [("A", hour(1), "p", 50.0), ("A", hour(0), "q", 50.0), ("A", hour(30), "q", 2.0)],  # neither newer than the last row of A
        [("A", hour(31), "q", 2.0)],
        [("B", hour(32), "q", 1.0)],
    ]
    made = fed(spark, tmp_path, parts, "idle", idle="10 hours")
    dropped = [(r.symbol, r.ts) for r in made if r.alpha is None]
    assert ("B", hour(11)) in dropped
    assert final([r for r in made if r.symbol == "B"]) == {("B", "q"): 1.0}  # began anew without p
    assert {r.weight for r in made if r.symbol == "A" and r.ts == hour(1)} == {1.0}


def test_sessions_settlement_and_accuracy(spark, tmp_path):
    ticks = [("A", hour(0) + dt.timedelta(minutes=m), 1.0, 1) for m in (0, 2, 3, 30, 31, 200)]
    spark.createDataFrame(ticks, "symbol string, ts timestamp, price double, size int").write.parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("symbol string, ts timestamp, price double, size int").parquet(str(tmp_path / "t"))
    made = run(candles.sessions(stream, "5 minutes"), "sessions", "complete")
    assert sorted((r.begin.hour * 60 + r.begin.minute, r.ticks) for r in made) == [(0, 3), (30, 2), (200, 1)]
    slid = run(candles.windowed(stream, "10 minutes", slide="5 minutes"), "slid", "complete")
    assert sum(r.volume for r in slid) == 2 * len(ticks)
    spark.createDataFrame([("A", hour(1), 1.0), ("A", hour(2), -1.0), ("B", hour(1), 1.0)], "symbol string, settle_ts timestamp, side double").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("A", hour(1), 0.5), ("A", hour(2), 0.25), ("A", hour(3), 1.0)], "symbol string, ts timestamp, outcome double").write.parquet(str(tmp_path / "o"))
    positions = spark.readStream.schema("symbol string, settle_ts timestamp, side double").parquet(str(tmp_path / "p"))
    known = spark.readStream.schema("symbol string, ts timestamp, outcome double").parquet(str(tmp_path / "o"))
    pnl = run(candles.settled(positions, known), "settled")
    assert sorted((r.symbol, r.settle_ts.hour, r.pnl) for r in pnl) == [("A", 1, 0.5), ("A", 2, -0.25)]
    spark.createDataFrame([("A", 0.5), ("A", -0.25), ("B", 1.0)], "symbol string, pnl double").write.parquet(str(tmp_path / "r"))
    rates = run(candles.running_accuracy(spark.readStream.schema("symbol string, pnl double").parquet(str(tmp_path / "r"))), "rates", "complete")
    assert sorted((r.symbol, r.n, r.wins, r.win_rate) for r in rates) == [("A", 2, 1, 0.5), ("B", 1, 1, 1.0)]
