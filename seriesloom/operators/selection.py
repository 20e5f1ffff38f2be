"""Which rows of an extract a request reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DataConfig
from ..functions.calendar import parse_timeframe


def filter_timeframe(
    df: DataFrame, timeframe: str | None = None, today: dt.date | None = None, column: str = "ds"
) -> DataFrame:
    """Rows dated within the timeframe, both ends included.

    The bounds are literals on the stored column, so they reach the scan. A
    timestamp column is compared with the start of the following day instead of
    being truncated, which would keep the filter out of the scan.
    """
    first, last = (dt.date.fromisoformat(d) for d in parse_timeframe(timeframe or DataConfig.timeframe, today))
    kind = df.schema[column].dataType
    lower = F.col(column) >= F.lit(first).cast(kind)
    if isinstance(kind, T.DateType):
        return df.where(lower & (F.col(column) <= F.lit(last)))
    return df.where(lower & (F.col(column) < F.lit(last + dt.timedelta(days=1)).cast(kind)))


def filter_geo(df: DataFrame, geo: str | None = None, config: DataConfig = DataConfig()) -> DataFrame:
    """Rows of one region; '' is the worldwide extract and None asks the config."""
    return df.where(F.col("geo") == (config.geo if geo is None else geo))


def resolve_target(df: DataFrame, target: str | None) -> str | None:
    """``target`` if the table has it, else None, which stands for every series.

    Ask this of the stored table: the lookup is a pushed-down filter that stops
    at the first row.
    """
    if target is None or df.where(F.col("series_id") == target).select("series_id").isEmpty():
        return None
    return target


def select_series(df: DataFrame, target: str | None) -> DataFrame:
    """Rows of one series, or of all with None."""
    return df if target is None else df.where(F.col("series_id") == target)
