"""The long series table and the tables derived from it.

A series table holds one row per (group_id, series_id, ds). ``group_id`` is one
request: the keywords that were fetched, and are cleaned, together. ``ds`` is a
DATE, and the key is unique, so one series can never hold more rows than there
are calendar days in its span (36,525 in a century). Windows partitioned by
series and grouped pandas functions rely on that bound; raw logs, whose keys may
be arbitrarily hot, are aggregated to it first (``sources.logs``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["group_id", "series_id"]

SERIES_SCHEMA = T.StructType(
    [
        T.StructField("group_id", T.StringType()),
        T.StructField("series_id", T.StringType()),
        T.StructField("ds", T.DateType()),
        T.StructField("y", T.DoubleType()),
    ]
)

SCALER_SCHEMA = T.StructType(
    [
        T.StructField("group_id", T.StringType()),
        T.StructField("series_id", T.StringType()),
        T.StructField("column", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("shift", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
    ]
)

# Model input columns next to the target, in the order windows are flattened.
CALENDAR_FEATURES = [
    "year",
    "month",
    "day",
    "day_of_week",
    "week_of_year",
    "month_sin",
    "month_cos",
    "day_sin",
    "day_cos",
]
DOW_FEATURES = ["dow_sin", "dow_cos"]


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def check_series(df: DataFrame) -> DataFrame:
    """Refuse a table whose ``ds`` is finer than a day: its series have no size bound."""
    kind = df.schema["ds"].dataType
    if not isinstance(kind, T.DateType):
        raise ValueError(f"ds must be a date, not {kind.simpleString()}: bucket it first (sources.logs)")
    return df


def is_fine(df: DataFrame) -> bool:
    """Whether ``ds`` is a point in time and not a date."""
    return isinstance(df.schema["ds"].dataType, (T.TimestampType, T.TimestampNTZType))


def check_fine(df: DataFrame) -> DataFrame:
    """Refuse a table whose ``ds`` is no point in time: its operators are those for dates."""
    if not is_fine(df):
        raise ValueError(f"ds must be a timestamp, not {df.schema['ds'].dataType.simpleString()}")
    return df


def by_series(*extra: str):
    """Window over one series (plus ``extra`` columns), without an order."""
    return Window.partitionBy(*KEYS, *extra)


def in_time(*extra: str):
    """Window over one series (plus ``extra`` columns) in date order."""
    return by_series(*extra).orderBy("ds")
