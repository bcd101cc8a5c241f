"""Panels from and to text files: CSV with a schema, JSON lines, append logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, folder: str, schema: str, time: str, header: bool = True) -> DataFrame:
    """Rows of all CSV files of ``folder``, one file per instrument, with ``inst`` from the file's name.

    Fields that do not fit the schema are missing.  Rows without a time are left out.
    """
    rows = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").csv(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)\.[^.]*$", 1)
    return rows.withColumn("inst", name).where(F.col(time).isNotNull())


def finite(df: DataFrame) -> DataFrame:
    """``df`` with zero in place of NaN and infinities, which JSON has no form for."""
    number = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    clean = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(F.col(c)) for c in number}
    return df.withColumns(clean) if clean else df


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; missing fields are kept as null."""
    finite(df).write.mode(mode).option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Add rows to a folder of JSON lines; earlier files stay as they are."""
    write_json(df, path, "append")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def between(rows: DataFrame, time: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with ``begin`` <= time < ``end``; plain comparisons, so they reach the scan."""
    if begin is not None:
        rows = rows.where(F.col(time) >= F.lit(begin).cast(rows.schema[time].dataType))
    if end is not None:
        rows = rows.where(F.col(time) < F.lit(end).cast(rows.schema[time].dataType))
    return rows


def filled_membership(panel: DataFrame, mask: DataFrame, price: str = "close") -> DataFrame:
    """``panel`` with ``member`` from ``mask``; where the mask says nothing, instruments with a price are members."""
    said = mask.select("ts", "inst", F.col("member").alias("said"))
    made = panel.join(said, ["ts", "inst"], "left")
    return made.withColumn("member", F.coalesce("said", F.col(price).isNotNull())).drop("said")


def profile_reason(name: Column, listed: Column, today: Column, days: int = 365) -> Column:
    """Why an instrument is left out: no profile, a fund, a property trust, a shell or a late listing; null where it stays."""
    return (
        F.when(name.isNull(), "no_profile").when(name.rlike(r"(?i)\b(etf|fund|trust units)\b"), "fund").when(name.ilike("%reit%"), "reit")
        .when(name.rlike(r"(?i)\b(shell|blank check|acquisition corp)\b"), "shell").when(F.datediff(today, listed) < days, "new")
    )


def plain_ticker(symbol: Column) -> Column:
    """Whether a symbol looks like a common share: one to five capital letters, of five not ending as a unit or warrant."""
    return symbol.rlike("^[A-Z]{1,4}$") | symbol.rlike("^[A-Z]{4}[^QRUWXYZ\\W\\d_a-z]$")


def group_levels(code: Column) -> list[Column]:
    """sector, group, industry and sub_industry: the first 2, 4, 6 and 8 digits of a classification code."""
    names = ("sector", "group", "industry", "sub_industry")
    return [F.when(F.length(code) >= 2 * k, F.substring(code, 1, 2 * k)).alias(n) for k, n in enumerate(names, 1)]


def slug(*parts: Column) -> Column:
    """Lower-case words and digits of the parts, joined by hyphens."""
    plain = F.regexp_replace(F.lower(F.concat_ws(" ", *parts)), "[^a-z0-9]+", "-")
    return F.regexp_replace(plain, "^-|-$", "")


def is_weekday(time: Column) -> Column:
    return F.weekday(time) < 5


def rebalance_days(days: DataFrame, time: str = "ts") -> DataFrame:
    """The first present day of each month."""
    return days.groupBy(F.trunc(time, "month").alias("month")).agg(F.min(time).alias(time)).select(time)


def ladder_fill(levels: Column, size: Column) -> Column:
    """Struct of ``filled`` and ``cost`` of taking ``size`` from (price, size) levels, cheapest first."""
    start = F.struct(F.lit(0.0).alias("filled"), F.lit(0.0).alias("cost"))

    def take(done: Column, level: Column) -> Column:
        part = F.greatest(F.least(level["size"], size - done["filled"]), F.lit(0.0))
        return F.struct((done["filled"] + part).alias("filled"), (done["cost"] + part * level["price"]).alias("cost"))

    return F.aggregate(F.array_sort(levels), start, take)


#: Ratio, numerator, denominator and the bounds it is clipped to.
RATIOS = [
    ("sharesout", "market_cap", "close", 0.001, None),
    ("pe_ratio", "close", "eps", -500, 500),
    ("pb_ratio", "market_cap", "equity", -100, 100),
    ("ev_to_ebitda", "enterprise_value", "ebitda", -200, 200),
    ("return_equity", "income", "equity", -5, 5),
    ("return_assets", "income", "assets", -2, 2),
    ("debt_to_equity", "debt", "equity", -20, 20),
]


def fundamental_ratios(panel: DataFrame) -> DataFrame:
    """``panel`` with each ratio whose two fields it has; a zero denominator gives no ratio."""
    made = {}
    for name, top, bottom, low, high in RATIOS:
        if {top, bottom} <= set(panel.columns):
            value = F.try_divide(F.col(top).cast("double"), F.col(bottom).cast("double"))
            low, high = (F.lit(None if b is None else float(b)).cast("double") for b in (low, high))
            made[name] = F.when(value.isNotNull(), F.least(F.greatest(value, low), high))
    return panel.withColumns(made) if made else panel
