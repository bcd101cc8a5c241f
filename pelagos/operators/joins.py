"""As-of and interval joins whose keys are split by time, so that no task walks or compares a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def time_bucket(time: str, seconds: int) -> Column:
    """Number of the span of ``seconds`` that holds ``time``."""
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], span: int = 90 * DAY) -> DataFrame:
    """Each left row with the values of the latest right row of its keys whose time is not later.

    The values of one right row stay together even where some are missing.  Right rows of equal time: the greatest
    values win.  A missing key or right time matches nothing.  Rows meet by key and span of time; the last values of
    each span are carried to the later ones by a window over spans, of which a key has as many as ``span`` seconds fit
    into its history, whatever number of rows it holds.
    """
    side = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    a = left.select(F.struct(*left.columns).alias("row"), *keys, time, F.lit(1).alias("side"), *side)
    none = F.lit(None).cast(a.schema["row"].dataType).alias("row")
    b = right.dropna(subset=[*keys, time]).select(none, *keys, time, F.lit(0).alias("side"), *values)
    merged = a.unionByName(b).withColumn("bucket", time_bucket(time, span))
    is_right = F.col("side") == 0
    order = Window.partitionBy(*keys, "bucket").orderBy(time, "side", *values).rowsBetween(Window.unboundedPreceding, 0)
    near = merged.withColumn("near", F.last(F.when(is_right, F.struct(*values)), ignorenulls=True).over(order))
    ends = merged.groupBy(*keys, "bucket").agg(F.max(F.when(is_right, F.struct(F.col(time).alias("at"), F.struct(*values).alias("v")))).alias("end"))
    spans = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "bucket", F.last("end", ignorenulls=True).over(spans)["v"].alias("far"))
    joined = near.where("side = 1").select("row", "near", *keys, "bucket").join(carried, [*keys, "bucket"], "left")
    found = F.coalesce("near", "far")
    return joined.select("row.*", *(found[v].alias(v) for v in values))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, begin: str, end: str, span: int = 90 * DAY) -> DataFrame:
    """Left rows with the right rows of equal keys whose [begin, end) holds their time; an open end never ends.

    An interval is repeated once for each span of ``span`` seconds that it touches between the first and the last left
    time (the two values that the driver reads), and rows meet by key and span.  A pair is found in one span only.
    """
    first, last = left.agg(F.min(time_bucket(time, span)), F.max(time_bucket(time, span))).first()
    low = F.greatest(time_bucket(begin, span), F.lit(first))
    high = F.least(F.coalesce(time_bucket(end, span), F.lit(last)), F.lit(last))
    touched = right.withColumn("span", F.explode(F.when(low <= high, F.sequence(low, high))))
    a = left.withColumn("left_span", time_bucket(time, span))
    condition = a["left_span"] == touched["span"]
    for k in keys:
        condition = condition & (a[k] == touched[k])
    inside = (a[time] >= touched[begin]) & (touched[end].isNull() | (a[time] < touched[end]))
    return a.join(touched, condition & inside).drop(*(touched[k] for k in keys), "span", "left_span")


def validity(changes: DataFrame, keys: list[str], time: str) -> DataFrame:
    """``changes`` with ``until``, the time of the next change of the key."""
    return changes.withColumn("until", F.lead(time).over(Window.partitionBy(*keys).orderBy(time)))


def known_from(period: str, filed: str, accepted: str, wait: int = 90) -> Column:
    """Day from which a statement may be used: accepted, else the day after filing, else ``wait`` days after the period."""
    return F.coalesce(F.to_date(accepted), F.date_add(F.to_date(filed), 1), F.date_add(F.to_date(period), wait))


def higher_timeframe(bars: DataFrame, slow: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """``bars`` with ``slow_`` values of the last slower bar that was complete when the bar began."""
    line = Window.partitionBy(*keys).orderBy(time)
    shifted = slow.select(*keys, time, *(F.lag(v).over(line).alias(f"slow_{v}") for v in values))
    return asof_backward(bars, shifted, keys, time, [f"slow_{v}" for v in values])


def contract_end(time: str, seconds: int) -> Column:
    """Unix second at which the contract that trades at ``time`` ends."""
    return (F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds) + 1) * seconds
