"""Candle signals over windows without prices, against their SQL."""

import datetime as dt

import duckdb

from pelagos.plans.queries import ORACLE_SQL, QUERIES


def test_windows_without_any_price(spark, tmp_path):
    # twelve bars of six hours: ten of them hold a zero and so have no price, and the first window has none at all
    rows = [(4 * i + k, dt.datetime(2024, 1, 1) + dt.timedelta(hours=6 * i, minutes=k), kind, 0.0 if k == 2 and i not in (9, 10) else 5.0 + i + k)
            for kind in ("a", "b") for i in range(12) for k in range(4)]
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = QUERIES["candle_signals"](spark, str(tmp_path))
    columns = sorted(found.columns)
    wanted = duck.sql(ORACLE_SQL["candle_signals"]).select(*(f'"{c}"' for c in columns)).fetchall()
    rows = found.select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, wanted))
    by_place = sorted((r.inst, r["at"], r.above_mean) for r in rows)
    assert [r[2] is None for r in by_place[:12]] == [True] * 9 + [False, False, True]
