"""Generations of keyed tables: crashes, second writers, keys."""

import pytest

from pelagos.plans import catalog
from pelagos.sources.keyed import KeyedTable, StaleWriter


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "alphas"), ["expression", "interval"])


def frame(spark, *rows):
    return spark.createDataFrame(rows, "expression string, interval string, sharpe double")


def content(table, generation=None):
    return sorted(tuple(r) for r in table.read(generation).collect())


def test_upsert_and_generations(spark, table):
    assert table.generation() == 0
    with pytest.raises(LookupError):
        table.read()
    assert table.upsert(frame(spark, ("a", "1d", 1.0), ("b", "1d", 2.0))) == 1
    assert table.upsert(frame(spark, ("b", "1d", 3.0), ("b", "4h", 4.0))) == 2
    assert content(table) == [("a", "1d", 1.0), ("b", "1d", 3.0), ("b", "4h", 4.0)]
    assert content(table, 1) == [("a", "1d", 1.0), ("b", "1d", 2.0)]
    table.upsert(frame(spark, ("c", "1d", 5.0)).selectExpr("*", "'new' AS notes"))
    assert [r for r in content(table) if r[3]] == [("c", "1d", 5.0, "new")]
    assert table.replace(frame(spark)) == 4 and content(table) == []


def test_a_crash_before_publication_changes_nothing(spark, table):
    table.replace(frame(spark, ("a", "1d", 1.0)))
    table.write(frame(spark, ("a", "1d", 9.0)))  # written, never published
    assert table.generation() == 1 and content(table) == [("a", "1d", 1.0)]
    assert table.upsert(frame(spark, ("b", "1d", 2.0))) == 2


def test_the_second_writer_fails_cleanly(spark, table):
    table.replace(frame(spark, ("a", "1d", 1.0)))
    mine, theirs = table.write(frame(spark, ("a", "1d", 2.0))), table.write(frame(spark, ("a", "1d", 3.0)))
    assert table.publish(theirs, 1) == 2
    with pytest.raises(StaleWriter):
        table.publish(mine, 1)
    assert table.generation() == 2 and content(table) == [("a", "1d", 3.0)]
    assert table.publish(mine, 2) == 3


@pytest.mark.parametrize("rows", [[("a", "1d", 1.0), ("a", "1d", 2.0)], [("a", None, 1.0)]])
def test_bad_keys_are_refused(spark, table, rows):
    table.replace(frame(spark, ("z", "1d", 1.0)))
    with pytest.raises(ValueError, match="key"):
        table.upsert(frame(spark, *rows))
    assert content(table) == [("z", "1d", 1.0)]


def test_selection_history_and_correlations(spark):
    alphas = spark.createDataFrame([(1, "x", "m"), (2, "y", "r")], "id int, expression string, category string")
    rows = [(7, 0, 1, 0.2), (7, 0, 2, 0.8), (7, 5, 1, None), (8, 0, 1, 1.0), (7, 5, 99, 1.0)]
    found = catalog.selection_history(spark.createDataFrame(rows, "run_id int, bar_index int, alpha_id int, weight double"), alphas, 7)
    assert sorted((r.bar_index, r.place, r.expression) for r in found.collect()) == [(0, 1, "y"), (0, 2, "x"), (5, 1, "x")]
    pairs = spark.createDataFrame([(1, 2, 0.5, 1), (2, 1, 0.7, 2), (3, 3, 1.0, 1), (3, 1, None, 1)], "alpha_a int, alpha_b int, correlation double, computed_at int")
    assert sorted((r.a, r.b, r.correlation) for r in catalog.as_pairs(pairs).collect()) == [(1, 2, 0.7), (1, 3, None)]
