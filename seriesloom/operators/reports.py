"""The tables behind a report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import known
from ..schema import KEYS, by_series


def overview(df: DataFrame) -> DataFrame:
    """Keywords, dates, first and last date and missing values of each group."""
    return df.groupBy("group_id").agg(
        F.countDistinct("series_id").alias("keywords"),
        F.countDistinct("ds").alias("data_points"),
        F.min("ds").alias("first_date"),
        F.max("ds").alias("last_date"),
        F.count_if(known("y").isNull()).alias("missing"),
    )


def last_n(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` dates of each series."""
    newest = by_series().orderBy(F.col("ds").desc())
    return df.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= n).drop("__r")


def distribution(df: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of each series, empty bins included, with mean and median.

    The bins are counted as one array per series. A constant series gets the
    range half a unit to both sides of its value.
    """
    ranged = (
        df.where(known("y").isNotNull())
        .withColumn("low", F.min("y").over(by_series()))
        .withColumn("high", F.max("y").over(by_series()))
    )
    flat = F.col("low") == F.col("high")
    ranged = ranged.withColumns(
        {"low": F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")),
         "high": F.when(flat, F.col("high") + 0.5).otherwise(F.col("high"))}
    )
    at = F.least(F.lit(bins - 1), F.floor((F.col("y") - F.col("low")) * bins / (F.col("high") - F.col("low"))))
    placed = ranged.withColumn("__bin", at.cast("int"))
    counts = F.array(*[F.count_if(F.col("__bin") == i) for i in range(bins)])
    per_series = placed.groupBy(*KEYS).agg(
        F.first("low").alias("low"),
        F.first("high").alias("high"),
        F.avg("y").alias("mean"),
        F.median("y").alias("median"),
        counts.alias("counts"),
    )
    width = (F.col("high") - F.col("low")) / bins
    return per_series.select(*KEYS, "low", "high", "mean", "median", F.posexplode("counts").alias("bin", "n")).select(
        *KEYS,
        "bin",
        (F.col("low") + F.col("bin") * width).alias("bin_from"),
        (F.col("low") + (F.col("bin") + 1) * width).alias("bin_to"),
        "n",
        "mean",
        "median",
    )


def forecast_summary(forecasts: DataFrame, digits: int | None = 1) -> DataFrame:
    """Mean, change from first to last and direction of each forecast."""
    change = F.max_by("yhat", "ds") - F.min_by("yhat", "ds")
    table = forecasts.groupBy(*KEYS, "model").agg(F.avg("yhat").alias("average"), change.alias("change"))
    table = table.withColumn("direction", F.when(F.col("change") > 0, "up").otherwise("down"))
    if digits is None:
        return table
    return table.withColumns({c: F.round(c, digits) for c in ("average", "change")})


def forecast_context(df: DataFrame, forecasts: DataFrame, n: int = 100) -> DataFrame:
    """The last ``n`` actual values, each model's forecast and its bounds, as one table.

    ``kind`` is 'actual' or the model's name; ``forecast_start`` is the first
    forecast date of the series.
    """
    columns = [*KEYS, "kind", "ds", "value", "lower", "upper"]
    none = F.lit(None).cast("double")
    lower, upper = (F.col(c) if c in forecasts.columns else none for c in ("yhat_lower", "yhat_upper"))
    actual = last_n(df.select(*KEYS, "ds", "y"), n).select(
        *KEYS, F.lit("actual").alias("kind"), "ds", F.col("y").alias("value"), none.alias("lower"), none.alias("upper")
    )
    ahead = forecasts.select(
        *KEYS, F.col("model").alias("kind"), "ds", F.col("yhat").alias("value"), lower.alias("lower"), upper.alias("upper")
    )
    first = F.min(F.when(F.col("kind") != "actual", F.col("ds"))).over(by_series())
    return actual.unionByName(ahead).select(*columns, first.alias("forecast_start"))


def report_tables(df: DataFrame, forecasts: DataFrame | None = None, metrics: DataFrame | None = None) -> dict:
    """The tables of one report: history, correlations, forecasts in context, rmse."""
    from .correlation import correlation_matrix

    tables = {"history": df, "correlation": correlation_matrix(df)}
    if forecasts is not None:
        tables["forecast"] = forecast_context(df, forecasts)
    if metrics is not None:
        tables["rmse"] = metrics.where(F.col("metric") == "rmse").select(*KEYS, "model", "value")
    return tables
