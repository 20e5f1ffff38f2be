"""Additive seasonal decomposition by moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window, WindowSpec

from ..functions.calendar import known
from ..schema import by_series, check_series, in_time

# Fixed values: (more rows than, period), first match wins; period 7 otherwise.
DEFAULT_PERIODS = ((730, 365), (60, 30))
SHORTEST_PERIOD = 7


def running_mean(period: int, over: WindowSpec | None = None) -> Column:
    """Mean over one period around the row, out of running totals ``__total`` of the values less ``__mean``.

    An even period is the mean of two frames shifted by one row. Costs a constant
    per row, where the frame of a 365-row mean would be re-added for each row.
    """
    half, over = period // 2, over or in_time()
    total = F.col("__total")

    def span(back: int, ahead: int) -> Column:
        return F.lead(total, ahead).over(over) - F.lag(total, back + 1, 0.0).over(over)

    if period % 2:
        return F.col("__mean") + span(half, half) / period
    return F.col("__mean") + (span(half, half - 1) + span(half - 1, half)) / (2 * period)


def seasonal_decompose(df: DataFrame, period: int | None = None) -> DataFrame:
    """Add ``trend``, ``seasonal``, ``resid``, ``period`` and ``status``.

    Without a period it follows from the length of the series: 365, 30 or 7 rows.
    Trend and residual are null where a full period does not fit around the row.
    A series with missing values or under two full periods is not decomposed;
    its status says which, and its components are null.
    """
    count = F.count("*").over(by_series())
    rows = (
        check_series(df).withColumn("__n", count)
        .withColumn("__nulls", F.count_if(known("y").isNull()).over(by_series()))
        .withColumn("__at", F.row_number().over(in_time()) - 1)
        .withColumn("__mean", F.avg("y").over(by_series()))
        .withColumn("__total", F.sum(F.col("y") - F.col("__mean")).over(in_time().rowsBetween(Window.unboundedPreceding, 0)))
    )
    if period is None:
        chosen = F.lit(SHORTEST_PERIOD)
        for longer_than, length in reversed(DEFAULT_PERIODS):
            chosen = F.when(F.col("__n") > longer_than, length).otherwise(chosen)
        candidates = [length for _, length in DEFAULT_PERIODS] + [SHORTEST_PERIOD]
    else:
        chosen, candidates = F.lit(period), [period]
    rows = rows.withColumn("period", chosen)
    status = (
        F.when(F.col("__nulls") > 0, "missing values")
        .when(F.col("__n") < 2 * F.col("period"), "too short")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    half = F.floor(F.col("period") / 2)
    inside = (F.col("status") == "ok") & (F.col("__at") >= half) & (F.col("__at") + half < F.col("__n"))
    trend = F.lit(None).cast("double")
    for length in candidates:
        trend = F.when(F.col("period") == length, running_mean(length)).otherwise(trend)
    rows = rows.withColumn("trend", trend).withColumn("trend", F.when(inside, F.col("trend")))

    phase = by_series("__phase")
    rows = (
        rows.withColumn("__phase", F.col("__at") % F.col("period"))
        .withColumn("__level", F.avg(F.col("y") - F.col("trend")).over(phase))
        .withColumn("__share", F.col("__level") / F.count("*").over(phase))
        # Each phase counts once in the mean, however many rows it has.
        .withColumn("__center", F.sum("__share").over(by_series()) / F.col("period"))
        .withColumn("seasonal", F.when(F.col("status") == "ok", F.col("__level") - F.col("__center")))
        .withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal"))
    )
    return rows.select(*df.columns, "period", "status", "trend", "seasonal", "resid")
