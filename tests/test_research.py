"""Joins split by time, out-of-sample samples, text sources and the F test on small frames."""

import datetime as dt
import math

import pytest

from pelagos.operators import joins
from pelagos.plans import evaluation as ev
from pelagos.sources import files


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_asof_over_spans(spark):
    left = spark.createDataFrame([(1, "a", at(0)), (2, "a", at(400)), (3, "b", at(5)), (4, None, at(5)), (5, "a", at(10))], "id int, k string, ts timestamp")
    right = spark.createDataFrame([("a", at(1), 1.0), ("a", at(10), None), ("a", at(10), 2.0), (None, at(1), 9.0), ("b", at(6), 3.0), ("b", None, 4.0)], "k string, ts timestamp, v double")
    for span in (joins.DAY, 30 * joins.DAY, 10_000 * joins.DAY):
        found = {r["id"]: r["v"] for r in joins.asof_backward(left, right, ["k"], "ts", ["v"], span).collect()}
        assert found == {1: None, 2: 2.0, 3: None, 4: None, 5: 2.0}
    none = joins.asof_backward(left, right.where("false"), ["k"], "ts", ["v"]).collect()
    assert len(none) == 5 and all(r["v"] is None for r in none)


def test_intervals_over_spans(spark):
    left = spark.createDataFrame([(i, i % 2, at(i * 7 % 90)) for i in range(60)], "id int, k int, ts timestamp")
    spans = [(j, j % 2, at(3 * j - 20), None if j % 7 == 0 else at(3 * j - 20 + j % 11)) for j in range(40)]
    right = spark.createDataFrame(spans, "j int, k int, since timestamp, until timestamp")
    wanted = sorted((i, j) for i in range(60) for j, k, a, b in spans if i % 2 == k and at(i * 7 % 90) >= a and (b is None or at(i * 7 % 90) < b))
    for span in (joins.DAY, 7 * joins.DAY, 10_000 * joins.DAY):
        made = joins.interval_join(left, right, ["k"], "ts", "since", "until", span)
        assert made.columns == ["id", "k", "ts", "j", "since", "until"]
        assert sorted((r["id"], r["j"]) for r in made.collect()) == wanted
    assert joins.interval_join(left.where("false"), right, ["k"], "ts", "since", "until").count() == 0


def test_walk_forward_lays_folds_from_the_end(spark):
    series = spark.createDataFrame([("a", at(i), float(i)) for i in range(50)] + [("short", at(i), 1.0) for i in range(10)], "alpha string, ts timestamp, r double")
    rows = ev.walk_forward(series, 20, 10, 5).collect()
    assert {r["alpha"] for r in rows} == {"a"}
    samples = {}
    for r in rows:
        samples.setdefault((r["fold"], r["sample"]), []).append(int(r["r"]))
    assert sorted(samples[3, "out"]) == list(range(40, 50)) and sorted(samples[3, "in"]) == list(range(20, 40))
    assert sorted(samples[1, "out"]) == list(range(20, 30)) and sorted(samples[1, "in"]) == list(range(20))
    assert ev.fixed_split(series, 0.7, 60).count() == 0


def test_f_tail():
    for f, d in ((0.3, 1), (4.0, 1), (1.0, 2), (6.0, 2), (50.0, 2)):
        t = math.sqrt(f)
        plain = 1 - 2 / math.pi * math.atan(t) if d == 1 else 1 - t / math.sqrt(2 + f)
        assert ev.f_tail(f, d) == pytest.approx(plain, abs=1e-9)
    assert ev.f_tail(3.8415, 10_000_000) == pytest.approx(0.05, abs=1e-5)
    assert ev.f_tail(0.0, 5) == 1.0


def test_granger_finds_the_leader(spark):
    x = [math.sin(i * 1.7) + (i * 37 % 11) / 5 for i in range(60)]
    y = [0.0] + [v * 0.9 + (i * 53 % 7) / 50 for i, v in enumerate(x[:-1])]
    rows = spark.createDataFrame([("led", at(i), y[i], x[i]) for i in range(60)] + [("flat", at(i), 1.0, x[i]) for i in range(60)], "k string, ts timestamp, y double, x double")
    made = {r["k"]: r for r in ev.granger(rows, "y", "x", ["k"]).collect()}
    assert made["led"]["p"] < 1e-6 and made["flat"]["f"] is None and made["flat"]["p"] is None


def test_text_round_trips(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "AAA.csv").write_text("ts,close\n2024-01-01,1.5\n2024-01-02,oops\n,3\n")
    (folder / "B.C.csv").write_text("ts,close\n2024-01-01,2.5\n")
    rows = files.read_csv(spark, str(folder), "ts date, close double", "ts")
    assert sorted((r["inst"], r["ts"].day, r["close"]) for r in rows.where("close IS NOT NULL").collect()) == [("AAA", 1, 1.5), ("B.C", 1, 2.5)]
    assert rows.count() == 3
    made = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 4.0), (4, None)], "id int, x double")
    files.write_json(made, str(tmp_path / "json"))
    files.append_log(made.where("id = 3"), str(tmp_path / "json"))
    read = files.read_json(spark, str(tmp_path / "json"), "id int, x double")
    assert sorted((r["id"], -1 if r["x"] is None else r["x"]) for r in read.collect()) == [(1, 0.0), (2, 0.0), (3, 4.0), (3, 4.0), (4, -1)]


def test_membership_and_time_range(spark):
    panel = spark.createDataFrame([(at(0), 1, 5.0), (at(0), 2, None), (at(1), 1, 5.0)], "ts timestamp, inst int, close double")
    mask = spark.createDataFrame([(at(0), 1, False)], "ts timestamp, inst int, member boolean")
    made = files.filled_membership(panel, mask).orderBy("ts", "inst").collect()
    assert [r["member"] for r in made] == [False, False, True]
    assert files.between(panel, "ts", "2024-01-02").count() == 1 and files.between(panel, "ts", None, "2024-01-02").count() == 2
