"""Series tables derived from the star schema and the event log.

Money is rounded per row and summed as integers: such sums do not depend on the
order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEYS, in_time
from ..sources.logs import series_from_log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column: str) -> Column:
    return F.floor(F.col(column) + 0.5)


def orders_series(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    """Revenue by order priority; the order status is the request they belong to."""
    orders = table(spark, sf_dir, "orders")
    return series_from_log(
        orders, F.col("o_orderstatus"), F.col("o_orderpriority"), "o_orderdate", whole("o_totalprice"), bucket
    )


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day by type."""
    return series_from_log(table(spark, sf_dir, "events"), F.lit("events"), F.col("event_type"), "ts")


def nation_series(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """Line revenue by customer nation, five nations to a group.

    Lines are summed per order before they meet the orders: the sum uses the
    distribution the join needs anyway.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(whole("l_extendedprice")).alias("amount"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sold = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    group = F.floor(F.col("n_nationkey") / 5)
    return series_from_log(sold, group, F.col("n_name"), "o_orderdate", F.col("amount"), bucket)


def supplier_series(spark: SparkSession, sf_dir: str, bucket: str = "week") -> DataFrame:
    """Shipped revenue by supplier; the suppliers of a nation are a group.

    Lines are summed per supplier and week before they meet the suppliers, which
    shrinks them to the size of the result.
    """
    lines = table(spark, sf_dir, "lineitem")
    by_key = series_from_log(lines, F.lit(""), F.col("l_suppkey"), "l_shipdate", whole("l_extendedprice"), bucket)
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("string").alias("group_id"), F.col("s_suppkey").cast("string").alias("series_id")
    )
    return by_key.drop("group_id").join(suppliers, "series_id").select(*KEYS, "ds", "y")


def lagged_forecasts(series: DataFrame) -> DataFrame:
    """Two plain forecasts of each day, yesterday's and last week's value, to score."""
    row = in_time()
    return (
        series.withColumn("lag1", F.lag("y", 1).over(row))
        .withColumn("lag7", F.lag("y", 7).over(row))
        .unpivot([*KEYS, "ds", "y"], ["lag1", "lag7"], "model", "yhat")
        .where(F.col("yhat").isNotNull())
    )


def plain_forecasts(series: DataFrame, periods: int) -> DataFrame:
    """Two plain forecasts of the days after the last: hold the last value, and drift."""
    ends = series.groupBy(*KEYS).agg(
        F.max("ds").alias("last_ds"),
        F.max_by("y", "ds").alias("y1"),
        F.min_by("y", "ds").alias("y0"),
        F.count("*").alias("n"),
    )
    slope = (F.col("y1") - F.col("y0")) / (F.col("n") - 1)
    return (
        ends.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
        .select(
            *KEYS,
            F.date_add("last_ds", F.col("step")).alias("ds"),
            F.col("y1").alias("hold"),
            (F.col("y1") + slope * F.col("step")).alias("drift"),
        )
        .unpivot([*KEYS, "ds"], ["hold", "drift"], "model", "yhat")
    )


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour by type, on all hours from the first to the last; an hour without one has no value."""
    counted = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ds")).agg(
        F.count("*").cast("double").alias("y")
    )
    span = counted.groupBy("series_id").agg(F.min("ds").alias("low"), F.max("ds").alias("high"))
    hours = span.select("series_id", F.explode(F.expr("sequence(low, high, interval 1 hour)")).alias("ds"))
    full = hours.join(counted, ["series_id", "ds"], "left")
    return full.select(F.lit("events").alias("group_id"), "series_id", "ds", "y")
