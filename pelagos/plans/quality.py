"""Data-quality rules over a panel: repaired values, flags and a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions import timeseries as ts
from pelagos.functions.elementwise import clip, over


def clean_price(x: Column, most: float = 1e6) -> Column:
    return F.when((x > 0) & (x <= most), x)


def clean_return(x: Column) -> Column:
    return F.when(F.abs(x) <= 1, x)


def clean_volume(panel: DataFrame, field: str = "volume") -> DataFrame:
    """Negative volumes and those over ten times the instrument's 99.9th percentile become missing."""
    top = panel.groupBy("inst").agg(F.percentile(field, F.lit(0.999)).alias("top"))
    bad = (F.col(field) < 0) | (F.col(field) > 10 * F.col("top"))
    return panel.join(top, "inst").withColumn(field, F.when(~bad, F.col(field))).drop("top")


def winsorize_by_instrument(panel: DataFrame, field: str, low: float = 0.01, high: float = 0.99, least: int = 50) -> DataFrame:
    """Clipped to the instrument's own quantiles where it has more than ``least`` values."""
    edges = panel.groupBy("inst").agg(
        F.percentile(field, F.lit(low)).alias("lo"), F.percentile(field, F.lit(high)).alias("hi"), F.count(field).alias("k")
    )
    clipped = F.when(F.col("k") > least, clip(F.col(field), F.col("lo"), F.col("hi"))).otherwise(F.col(field))
    return panel.join(edges, "inst").withColumn(field, clipped).drop("lo", "hi", "k")


def stale_runs(panel: DataFrame, field: str = "close") -> DataFrame:
    """``panel`` with ``run``, how many rows in a row the field has had this value; missing values break runs."""
    same = F.col(field) == F.lag(field).over(ts.series())
    made = panel.withColumn("starts", (~F.coalesce(same, F.lit(False))).cast("int"))
    made = made.withColumn("island", F.sum("starts").over(ts.so_far()))
    within = Window.partitionBy("inst", "island").orderBy("ts")
    return made.withColumn("run", F.when(F.col(field).isNotNull(), F.row_number().over(within))).drop("starts", "island")


def signed_streak(panel: DataFrame, field: str) -> DataFrame:
    """``panel`` with ``streak``: rows in a row of one sign, with that sign."""
    own = F.signum(F.col(field))
    same = own == F.lag(own).over(ts.series())
    made = panel.withColumn("starts", (~F.coalesce(same, F.lit(False))).cast("int"))
    made = made.withColumn("island", F.sum("starts").over(ts.so_far()))
    within = Window.partitionBy("inst", "island").orderBy("ts")
    return made.withColumn("streak", own * F.row_number().over(within)).drop("starts", "island")


def resumption_jumps(panel: DataFrame, field: str = "close", most: float = 0.5) -> DataFrame:
    """First rows after a gap whose value is more than ``most`` away from the last one before it."""
    line = ts.series()
    made = panel.withColumn("gap", F.lag(F.col(field).isNull()).over(line))
    made = made.withColumn("prior", F.last(field, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    jump = F.abs(over(F.col(field), F.col("prior")) - 1)
    return made.where(F.col("gap")).withColumn("jump", jump).where(F.col("jump") > most)


def time_gaps(rows: DataFrame, keys: list[str], time: str, expected_seconds: float, multiple: float = 1.5) -> DataFrame:
    """Rows that follow their predecessor by more than ``multiple`` of the expected step."""
    step = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    made = rows.withColumn("step", step - F.lag(step).over(Window.partitionBy(*keys).orderBy(time)))
    return made.where(F.col("step") > multiple * expected_seconds)


def integrity_report(panel: DataFrame, fields: list[str], warn: float = 0.02, fail: float = 0.2) -> DataFrame:
    """One row per field: rows, missing share, non-positive count, extremes, and PASS, WARN or FAIL; one pass."""
    stats = panel.agg(F.count("*").alias("rows"), *(F.struct(
        F.avg(F.col(f).isNull().cast("double")).alias("missing"), F.sum((F.col(f) <= 0).cast("int")).alias("bad"),
        F.min(f).alias("low"), F.max(f).alias("high")).alias(f) for f in fields))
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("s")) for f in fields)))
    flat = stats.select("rows", each.alias("x")).select("x.field", "rows", "x.s.*")
    status = F.when((F.col("missing") > fail) | (F.col("bad") > 0), "FAIL").when(F.col("missing") > warn, "WARN").otherwise("PASS")
    return flat.withColumn("status", status)


def cross_checks(panel: DataFrame) -> DataFrame:
    """Counts of bars that break the order of open, high, low and close, or carry no volume; one pass."""
    broken = {
        "high_below_low": F.col("high") < F.col("low"),
        "close_outside": (F.col("close") > F.col("high")) | (F.col("close") < F.col("low")),
        "open_outside": (F.col("open") > F.col("high")) | (F.col("open") < F.col("low")),
        "no_volume": F.col("close").isNotNull() & (F.coalesce("volume", F.lit(0.0)) <= 0),
    }
    counts = panel.agg(*(F.count_if(c).alias(n) for n, c in broken.items()))
    return counts.unpivot([], list(broken), "rule", "n")
