"""Results of a run: predictions and the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS


def predictions_wide(forecasts: DataFrame, models: list[str] | None = None) -> DataFrame:
    """One column per model, aligned by date; a date one model lacks is null.

    Without ``models`` all that occur, sorted: a handful, but a job to find them.
    """
    if models is None:
        models = [r["model"] for r in forecasts.select("model").distinct().orderBy("model").collect()]
    return forecasts.groupBy(*KEYS, "ds").pivot("model", list(models)).agg(F.first("yhat"))


def write_predictions(forecasts: DataFrame, path: str, models: list[str] | None = None) -> None:
    predictions_wide(forecasts, models).write.mode("overwrite").option("header", True).csv(path)


def results_summary(raw: DataFrame, metrics: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row per series: what went in, the models that were scored, their metrics.

    Only finite numeric metrics appear, keyed model.metric.
    """
    inputs = raw.groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"), F.min("ds").alias("first_date"), F.max("ds").alias("last_date")
    )
    usable = metrics.where(F.col("value").isNotNull() & ~F.isnan("value"))
    entry = F.struct(F.concat_ws(".", "model", "metric").alias("key"), F.col("value"))
    scored = usable.groupBy(*KEYS).agg(
        F.array_sort(F.collect_set("model")).alias("models"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("metrics"),
    )
    ahead = forecasts.groupBy(*KEYS).agg(F.countDistinct("ds").alias("prediction_periods"))
    return inputs.join(scored, KEYS, "left").join(ahead, KEYS, "left")


def write_summary(summary: DataFrame, path: str) -> None:
    stamped = summary.withColumn("timestamp", F.current_timestamp())
    text = F.to_json(F.struct(*[F.col(c) for c in stamped.columns]))
    stamped.select(text.alias("value")).write.mode("overwrite").text(path)
