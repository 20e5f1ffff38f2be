"""Lag windows: the supervised form of a series.

A series is packed into one row of arrays in date order, and each window is a
slice of them. A ``collect_list`` over a moving frame builds the same windows by
re-adding every row of the frame for every row of the series, about thirty times
the work. What is packed is bounded by the calendar, see ``schema``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CALENDAR_FEATURES, KEYS, check_series

MAX_LENGTH = 30  # fixed value: longest lookback of the adaptive rule


def _inputs(df: DataFrame, features: list[str] | None, target: str = "y") -> list[str]:
    return features or [target, *[c for c in CALENDAR_FEATURES if c in df.columns]]


def _pack(df: DataFrame, inputs: list[str], target: str, by: tuple[str, ...], *aggregates: Column) -> DataFrame:
    """One row per series with the arrays ``at`` (dates), ``v`` (target) and ``f`` (feature rows)."""
    cell = F.struct(
        F.col("ds").alias("at"),
        F.col(target).cast("float").alias("v"),
        F.array(*[F.col(c).cast("float") for c in inputs]).alias("f"),
    )
    packed = check_series(df).groupBy(*KEYS, *by).agg(F.sort_array(F.collect_list(cell)).alias("rows"), *aggregates)
    return packed.select("*", "rows.at", "rows.v", "rows.f", F.size("rows").alias("n")).drop("rows")


def _positions(first: Column, last: Column) -> Column:
    """The whole numbers from first to last; none if they are the wrong way round."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def make_sequences(
    df: DataFrame,
    length: int = 30,
    steps: int = 1,
    target: str = "y",
    features: list[str] | None = None,
    within: tuple[str, ...] = (),
) -> DataFrame:
    """Windows of the ``length`` rows before each row, and the values from it on.

    ``x`` is array<array<float>>, oldest row first; the target is the first
    feature. ``yt`` is the value at the row, or with ``steps`` > 1 the array of
    the next ``steps`` values. Rows without a full window on both sides give
    none. ``within`` names columns a window must not cross.
    """
    if target not in df.columns:
        raise ValueError(f"No column {target!r} to predict")
    packed = _pack(df, _inputs(df, features, target), target, within)
    # The dates are listed before they are exploded: the explode itself then stays
    # inside generated code, which passes the arrays on without copying them.
    listed = packed.withColumn("positions", _positions(F.lit(length), F.col("n") - steps))
    at = listed.withColumn("i", F.explode("positions"))
    values = F.element_at("v", F.col("i") + 1) if steps == 1 else F.slice("v", F.col("i") + 1, F.lit(steps))
    return at.select(
        *KEYS,
        *within,
        F.element_at("at", F.col("i") + 1).alias("ds"),
        F.slice("f", F.col("i") - length + 1, F.lit(length)).alias("x"),
        values.alias("yt"),
    )


def adaptive_length(split_df: DataFrame, longest: int = MAX_LENGTH) -> DataFrame:
    """Lookback per series: a quarter of its training rows, at most ``longest``."""
    trained = F.count_if(F.col("split") == "train")
    return split_df.groupBy(*KEYS).agg(
        trained.alias("n_train"), F.least(F.lit(longest), F.floor(trained / 4)).cast("int").alias("length")
    )


def split_sequences(
    split_df: DataFrame,
    longest: int = MAX_LENGTH,
    features: list[str] | None = None,
    steps: tuple[int, ...] | None = None,
) -> DataFrame:
    """Flat windows for the lag-window model, each inside one split, with adaptive length.

    ``x`` is array<float>: ``longest`` feature rows one after the other. A series
    with a shorter lookback has zero rows in front, so one model serves all
    series; ``length`` keeps the lookback used. If the val rows of a series are
    too few for a window, the last fifth of its training windows take their
    place. ``split`` must be contiguous, as ``temporal_split`` makes it.

    With ``steps`` a window comes once per step, with the value that many rows
    ahead (in the same split) and the step as a last feature row.
    """
    inputs = _inputs(split_df, features)
    width = len(inputs)
    packed = _pack(
        split_df,
        inputs,
        "y",
        (),
        F.count_if(F.col("split") == "train").cast("int").alias("n_train"),
        F.count_if(F.col("split") == "val").cast("int").alias("n_val"),
    )
    length, val_from = F.col("length"), F.col("n_train")
    test_from = F.col("n_train") + F.col("n_val")
    listed = (
        packed.withColumn("length", F.least(F.lit(longest), F.floor(F.col("n_train") / 4)).cast("int"))
        .where(length > 0)
        .withColumn("flat", F.flatten("f"))
        .withColumn(
            "positions",
            F.concat(
                _positions(length, val_from - 1),
                _positions(val_from + length, test_from - 1),
                _positions(test_from + length, F.col("n") - 1),
            ),
        )
        .select(*KEYS, "at", "v", "n", "n_train", "n_val", "length", "flat", "positions")
    )
    i = F.col("i")
    split = F.when(i < val_from, "train").when(i < test_from, "val").otherwise("test")
    window = F.concat(
        F.array_repeat(F.lit(0.0).cast("float"), (F.lit(longest) - length) * width),
        F.slice("flat", (i - length) * width + 1, length * width),
    )
    at = listed.withColumn("i", F.explode("positions"))
    relabelled = F.when(_late_window(i, length), "val").otherwise(split)
    if steps is None:
        return at.select(
            *KEYS,
            F.element_at("at", i + 1).alias("ds"),
            relabelled.alias("split"),
            "length",
            window.alias("x"),
            F.element_at("v", i + 1).alias("yt"),
        )
    end = F.when(i < val_from, val_from).when(i < test_from, test_from).otherwise(F.col("n"))
    each = at.withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps]))).where(i + F.col("step") <= end)
    return each.select(
        *KEYS,
        F.element_at("at", i + 1).alias("ds"),
        relabelled.alias("split"),
        "length",
        with_step(window, F.col("step"), width).alias("x"),
        F.element_at("v", i + F.col("step")).alias("yt"),
        "step",
    )


def _late_window(i: Column, length: Column) -> Column:
    """Whether a training window serves for validation: the val split has no room for one."""
    windows = F.col("n_train") - length
    return (i < F.col("n_train")) & (F.col("n_val") <= length) & (i - length >= F.floor(windows * F.lit(0.8)))


def with_step(x: Column, step: Column, width: int) -> Column:
    """The flat window with the step ahead as one more feature row."""
    return F.concat(x, F.array_repeat(step.cast("float"), width))
