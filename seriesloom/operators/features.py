"""Calendar features and target selection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.calendar import calendar_columns, cycle_columns
from ..schema import CALENDAR_FEATURES, DOW_FEATURES, KEYS
from .selection import select_series


def calendar_features(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_columns())


def cyclical_features(df: DataFrame) -> DataFrame:
    return df.withColumns(cycle_columns())


def select_target(df: DataFrame, target: str | None = None, include_dow: bool = False) -> DataFrame:
    """One series (or all, with None) with the ten model input columns.

    The weekday circle is left out unless asked for. The scaler columns a frame
    may carry stay with it.
    """
    carried = [c for c in ("y_shift", "y_scale") if c in df.columns]
    extra = DOW_FEATURES if include_dow else []
    return select_series(df, target).select(*KEYS, "ds", "y", *CALENDAR_FEATURES, *extra, *carried)
