"""Scaling per series, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS, by_series

VALUE_COLUMNS = ("y", "y_original")
METHODS = ("minmax", "standard")


def _statistics(column: str, method: str, fit: Column | None) -> tuple[Column, Column]:
    """(shift, raw scale) as aggregates of ``column`` over the rows ``fit`` selects."""
    value = F.col(column) if fit is None else F.when(fit, F.col(column))
    if method == "minmax":
        return F.min(value), F.max(value) - F.min(value)
    if method == "standard":
        return F.avg(value), F.stddev_pop(value)
    raise ValueError(f"Unknown scaling method: {method}. Known: {list(METHODS)}")


def _divisor(scale: Column) -> Column:
    # A constant series scales by 1, so it becomes 0 rather than undefined.
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def _present(df: DataFrame, columns) -> list[str]:
    return [c for c in columns if c in df.columns]


def fit_scaler(
    df: DataFrame, method: str = "minmax", columns=VALUE_COLUMNS, fit: Column | None = None
) -> DataFrame:
    """The scaler table: one (shift, scale) row per series and value column."""
    found = _present(df, columns)
    aggregates = []
    for name in found:
        shift, scale = _statistics(name, method, fit)
        aggregates += [shift.alias(f"{name}_shift"), scale.alias(f"{name}_scale")]
    wide = df.groupBy(*KEYS).agg(*aggregates)
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("column"),
                F.lit(method).alias("method"),
                F.col(f"{name}_shift").alias("shift"),
                _divisor(F.col(f"{name}_scale")).alias("scale"),
            )
            for name in found
        ]
    )
    return wide.select(*KEYS, F.explode(entries).alias("s")).select(*KEYS, "s.*")


def scale_series(
    df: DataFrame,
    method: str = "minmax",
    columns=VALUE_COLUMNS,
    fit: Column | None = None,
    keep_scalers: bool = False,
) -> DataFrame:
    """Scale in place, as windows over the series.

    After other per-series windows this needs no further shuffle or join. With
    ``keep_scalers`` each row carries its shift and scale, from which
    ``scalers_of`` recovers the scaler table.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown scaling method: {method}. Known: {list(METHODS)}")
    found = _present(df, columns)
    out = df
    for name in found:
        if method == "minmax":
            value = F.col(name) if fit is None else F.when(fit, F.col(name))
            low, high = F.min(value).over(by_series()), F.max(value).over(by_series())
            out = out.withColumn(f"{name}_shift", low).withColumn(f"{name}_scale", high)
        else:
            shift, scale = _statistics(name, method, fit)
            out = out.withColumn(f"{name}_shift", shift.over(by_series()))
            out = out.withColumn(f"{name}_scale", scale.over(by_series()))
    for name in found:
        shift, raw = F.col(f"{name}_shift"), F.col(f"{name}_scale")
        scale = _divisor(raw - shift if method == "minmax" else raw)
        out = out.withColumn(f"{name}_scale", scale).withColumn(name, (F.col(name) - shift) / F.col(f"{name}_scale"))
    if keep_scalers:
        return out
    return out.drop(*[f"{name}_{part}" for name in found for part in ("shift", "scale")])


def scalers_of(scaled: DataFrame, method: str = "minmax", columns=VALUE_COLUMNS) -> DataFrame:
    """The scaler table of a frame made with ``keep_scalers``."""
    found = [c for c in columns if f"{c}_shift" in scaled.columns]
    tables = [
        scaled.groupBy(*KEYS)
        .agg(F.first(f"{name}_shift").alias("shift"), F.first(f"{name}_scale").alias("scale"))
        .select(*KEYS, F.lit(name).alias("column"), F.lit(method).alias("method"), "shift", "scale")
        for name in found
    ]
    return reduce(DataFrame.unionByName, tables)


def _with_scaler(df: DataFrame, scalers: DataFrame, columns: list[str]) -> DataFrame:
    """Join one wide scaler row per series.

    No broadcast hint: the table grows with the number of series. Adaptive
    execution broadcasts it when its measured size allows.
    """
    wide = scalers.groupBy(*KEYS).agg(
        *[
            F.max(F.when(F.col("column") == c, F.col(part))).alias(f"__{c}_{part}")
            for c in columns
            for part in ("shift", "scale")
        ]
    )
    return df.join(wide, KEYS, "left")


def apply_scaler(df: DataFrame, scalers: DataFrame, columns=VALUE_COLUMNS) -> DataFrame:
    """Scale with a fitted table; a series or column without an entry stays as it is."""
    found = _present(df, columns)
    joined = _with_scaler(df, scalers, found)
    scaled = {
        c: (F.col(c) - F.coalesce(f"__{c}_shift", F.lit(0.0))) / F.coalesce(f"__{c}_scale", F.lit(1.0)) for c in found
    }
    return joined.withColumns(scaled).select(*df.columns)


def inverse_scale(
    df: DataFrame, scalers: DataFrame, columns=None, scaler_column: dict[str, str] | None = None
) -> DataFrame:
    """Back to original units.

    ``columns`` defaults to every value column present. ``scaler_column`` names
    the scaler entry of a column called otherwise (a forecast uses that of y).
    Anything without an entry stays as it is.
    """
    alias = scaler_column or {}
    found = _present(df, VALUE_COLUMNS if columns is None else columns)
    found = list(dict.fromkeys(found + [c for c in alias if c in df.columns]))
    entries = list(dict.fromkeys(alias.get(c, c) for c in found))
    joined = _with_scaler(df, scalers, entries)
    restored = {
        c: F.col(c) * F.coalesce(f"__{alias.get(c, c)}_scale", F.lit(1.0))
        + F.coalesce(f"__{alias.get(c, c)}_shift", F.lit(0.0))
        for c in found
    }
    return joined.withColumns(restored).select(*df.columns)
