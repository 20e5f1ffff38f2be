"""Series tables out of raw fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import bucket_date


def series_from_log(
    log: DataFrame, group: Column, series: Column, ts: str, value: Column | None = None, bucket: str = "day"
) -> DataFrame:
    """Sum ``value`` (or count rows) per series and bucket of time.

    This is the step that makes (group, series, ds) unique. It combines on the
    map side, so a series that holds a third of the log arrives at the shuffle as
    one row per bucket and task. Rows without a key or time belong to no series.

    They are left out here, in so many words: otherwise the optimizer infers the
    filter from later joins, on one side only, and a plan that uses the table
    twice cannot share its shuffle.
    """
    ds = bucket_date(ts, bucket)
    total = F.count("*") if value is None else F.sum(value)
    summed = (
        log.where(group.isNotNull() & series.isNotNull() & F.col(ts).isNotNull())
        .groupBy(group.alias("group_id"), series.alias("series_id"), ds.alias("ds"))
        .agg(total.alias("y"))
    )
    # Keys turn into text once per result row, not once per log row.
    return summed.select(
        F.col("group_id").cast("string"), F.col("series_id").cast("string"), "ds", F.col("y").cast("double")
    )


def normalize_geo(log: DataFrame, column: str = "geo") -> DataFrame:
    """Country codes as the operators compare them: trimmed, in upper case. Apply when a log is landed."""
    return log.withColumn(column, F.upper(F.trim(column)))
