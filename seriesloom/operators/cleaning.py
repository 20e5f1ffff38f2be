"""Missing and malformed values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import known
from ..schema import check_series, in_time

PARTIAL_FLAG = "isPartial"  # fixed value: marker column of an unfinished period


def drop_partial(df: DataFrame) -> DataFrame:
    """Drop the marker column; rows and nulls stay."""
    return df.drop(PARTIAL_FLAG)


def clean(df: DataFrame, column: str = "y") -> DataFrame:
    """Drop the marker column, turn text that is no number, and nulls, into 0."""
    numbers = drop_partial(df).withColumn(column, F.col(column).try_cast("double"))
    return numbers.withColumn(column, F.coalesce(known(column), F.lit(0.0)))


def missing_count(df: DataFrame) -> DataFrame:
    """Missing values per group."""
    return df.groupBy("group_id").agg(F.count_if(known("y").isNull()).alias("missing"))


def fill_time(df: DataFrame) -> DataFrame:
    """Fill nulls linearly in elapsed time; edges take the nearest known value.

    The known neighbours come from one sort: the last one seen so far, and the
    next one by ``lead … ignore nulls``. A frame that runs to the end of the
    series would be re-read for every row.
    """
    over = "over (partition by group_id, series_id order by ds"
    numbers = check_series(df).withColumn("y", known("y"))
    seen = numbers.withColumn("seen", F.when(F.col("y").isNotNull(), F.struct("ds", "y")))
    walked = seen.withColumn(
        "before", F.expr(f"last(seen, true) {over} rows between unbounded preceding and current row)")
    ).withColumn("after", F.expr(f"lead(seen, 1) ignore nulls {over})"))
    elapsed = F.datediff("ds", "before.ds").cast("double")
    span = F.datediff("after.ds", "before.ds").cast("double")
    between = F.col("before.y") + (F.col("after.y") - F.col("before.y")) * elapsed / span
    filled = F.coalesce("y", between, "before.y", "after.y")
    return walked.withColumn("y", filled).drop("seen", "before", "after")


def drop_missing(df: DataFrame) -> DataFrame:
    """Drop a date for every series of a group if one of them lacks a value on it.

    Only the dates with a null are gathered, so the table removed from is not
    sorted or windowed by date.
    """
    holes = df.where(known("y").isNull()).select("group_id", "ds").distinct()
    return df.join(holes, ["group_id", "ds"], "left_anti").select(*df.columns)


def smooth(df: DataFrame, window: int = 7, causal: bool = False) -> DataFrame:
    """Moving mean over ``window`` rows, shorter at the edges; keeps ``y_original``.

    The frame is centered; an even width looks one row further back than ahead.
    ``causal`` looks back only.
    """
    if window <= 1:
        return df
    ahead = 0 if causal else (window - 1) // 2
    frame = in_time().rowsBetween(ahead + 1 - window, ahead)
    return check_series(df).withColumn("y_original", F.col("y")).withColumn("y", F.avg("y").over(frame))
