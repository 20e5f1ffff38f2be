"""Forecast accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..schema import KEYS

METRICS = ["mae", "mse", "rmse", "mape", "r2"]
HIGHER_IS_BETTER = ("r2", "accuracy")  # fixed value: every other metric is a loss
MAPE_FLOOR = 1e-7  # fixed value: least divisor in test_mape


def metric_columns(y: str = "y", yhat: str = "yhat") -> dict[str, Column]:
    """The five metrics as aggregates.

    mape is a percentage over the rows with a non-zero actual and NaN without
    any. r2 of constant actuals is 1 for perfect forecasts and 0 otherwise.
    """
    actual, error = F.col(y), F.col(y) - F.col(yhat)
    mse = F.avg(error * error)
    spread = F.var_pop(actual)
    mape = F.avg(F.when(actual != 0, F.abs(error / actual))) * 100
    return {
        "mae": F.avg(F.abs(error)),
        "mse": mse,
        "rmse": F.sqrt(mse),
        "mape": F.coalesce(mape, F.lit(float("nan"))),
        "r2": F.when(spread != 0, 1 - mse / spread).otherwise(F.when(mse == 0, 1.0).otherwise(0.0)),
    }


def regression_metrics(df: DataFrame, by=(*KEYS, "model"), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row of metrics per key; rows without an actual or a forecast are left out."""
    scored = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    return scored.groupBy(*by).agg(*[c.alias(name) for name, c in metric_columns(y, yhat).items()])


def to_long_metrics(wide: DataFrame, names=METRICS, by=(*KEYS, "model")) -> DataFrame:
    """metrics(…, metric, value), one row per metric."""
    return wide.unpivot(list(by), list(names), "metric", "value")


def metrics_table(
    metrics: DataFrame, names: list[str] | None = None, digits: int | None = 4, by=(*KEYS, "model")
) -> DataFrame:
    """Model × metric matrix; a missing or NaN metric is null.

    Without ``names`` the columns are all metrics that occur, sorted, which costs a
    job to find them; names that are given are the columns, and no others.
    """
    usable = metrics.where(~F.isnan("value"))
    names = metric_names(metrics) if names is None else list(names)
    table = usable.groupBy(*by).pivot("metric", names).agg(F.first("value"))
    if digits is None:
        return table
    return table.withColumns({n: F.round(n, digits) for n in names})


def metric_names(metrics: DataFrame) -> list[str]:
    """Sorted names that occur: a handful, set by the models and not by the data."""
    return [r["metric"] for r in metrics.select("metric").distinct().orderBy("metric").collect()]


def rank_models(metrics: DataFrame) -> DataFrame:
    """Rank 1 is the best model of a series on a metric; NaN takes no part."""
    better_high = F.lower("metric").rlike("|".join(HIGHER_IS_BETTER))
    order = F.when(better_high, -F.col("value")).otherwise(F.col("value"))
    best_first = Window.partitionBy(*KEYS, "metric").orderBy(order)
    return metrics.where(~F.isnan("value")).withColumn("rank", F.rank().over(best_first))


def backtest_table(test: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Actual and forecast side by side, for the dates that have both."""
    actual = test.select(*KEYS, "ds", F.col("y").alias("actual"))
    return actual.join(forecasts, [*KEYS, "ds"]).select(*KEYS, "model", "ds", "actual", F.col("yhat").alias("predicted"))
