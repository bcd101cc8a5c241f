"""Sources and sinks of long panels: (ts, inst, field, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pelagos.scratch import written


def monthly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months by suppliers from order lines, dense: open, high, low, close, volume, dollars, vwap and groups.

    The unit price is the price; open and close are the first and last of the month by day, order, line number and the
    low bits of the price, packed into one long so that the aggregate stays hash-based.  The bars are written once: the
    grid needs their first and last month, and the order lines are then scanned a single time.
    """
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long") % (1 << 15)
    packed = F.shiftleft(F.shiftleft(F.dayofmonth("l_shipdate").cast("long"), 40) + F.col("l_orderkey"), 3) + F.col("l_linenumber")
    packed = F.shiftleft(packed, 15) + cents
    ticks = line.select(
        F.date_trunc("month", "l_shipdate").alias("ts"), F.col("l_suppkey").alias("inst"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), packed.alias("o"),
        F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("d"),
    )
    bars = ticks.groupBy("ts", "inst").agg(
        F.min_by("p", "o").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "o").alias("close"),
        F.sum("q").alias("volume"), F.sum("d").alias("dollars"),
    )
    bars = written(bars.withColumn("vwap", F.col("dollars") / F.col("volume")), "bars")
    return densify(bars, groups(spark, sf_dir), "1 month")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inst, industry (nation) and sector (region)."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    found = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    return found.select(F.col("s_suppkey").alias("inst"), F.col("s_nationkey").alias("industry"), F.col("n_regionkey").alias("sector"))


def densify(facts: DataFrame, instruments: DataFrame, step: str) -> DataFrame:
    """Every instrument at every time from the first fact to the last, ``step`` apart; missing where there is no fact.

    ``facts`` has unique (inst, ts); facts of other instruments are left out.  The times are made in each instrument's
    row, the only thing that reaches the driver is the first and the last one, and grid and facts meet in one exchange
    by instrument, which the windows along an instrument then find in place.
    """
    first, last = facts.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    at = lambda micros: F.timestamp_micros(F.lit(micros).cast("long"))
    times = F.explode(F.sequence(at(first), at(last), F.expr(f"INTERVAL {step}")))
    grid = instruments.select("*", F.lit(1).alias("on_grid"), times.alias("ts"))
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: windows cost more than their bytes tell
    both = grid.unionByName(facts, allowMissingColumns=True).repartition(tasks, "inst")
    values = [c for c in both.columns if c not in ("inst", "ts")]
    made = both.groupBy("inst", "ts").agg(*(F.max(c).alias(c) for c in values))
    return made.where(F.col("on_grid").isNotNull()).drop("on_grid")


def from_wide(wide: DataFrame, field: str, time: str = "ts") -> DataFrame:
    """(ts, inst, field) from a matrix with one column per instrument; missing cells are dropped."""
    names = [c for c in wide.columns if c != time]
    return wide.unpivot(time, names, "inst", field).where(F.col(field).isNotNull() & ~F.isnan(field))


def to_wide(panel: DataFrame, field: str, instruments: list) -> DataFrame:
    return panel.groupBy("ts").pivot("inst", instruments).agg(F.first(field, ignorenulls=True))


def read_matrices(spark: SparkSession, folder: str, fields: list[str]) -> DataFrame:
    """One long panel from one Parquet matrix per field."""
    parts = [from_wide(spark.read.parquet(f"{folder}/{f}.parquet"), f) for f in fields]
    return reduce(lambda a, b: a.join(b, ["ts", "inst"], "full"), parts)


def keep_last(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the last in ``order``."""
    last = Window.partitionBy(*keys).orderBy(*(c.desc_nulls_last() for c in order))
    return rows.withColumn("place", F.row_number().over(last)).where("place = 1").drop("place")


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key is not refreshed, and the fresh ones."""
    return stored.join(fresh.select(keys).distinct(), keys, "left_anti").unionByName(fresh)


def pivot_facts(facts: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One column per field from (keys, field, value) rows."""
    return facts.groupBy(*keys).pivot("field", fields).agg(F.first("value", ignorenulls=True))


def write_panel(panel: DataFrame, path: str) -> None:
    """Partitioned by year, so a time filter prunes files."""
    panel.withColumn("year", F.year("ts")).write.mode("overwrite").partitionBy("year").parquet(path)
