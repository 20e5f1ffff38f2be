"""Temporal splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import by_series, check_series, in_time


def temporal_split(df: DataFrame, test_size: float = 0.2, validation_size: float = 0.1) -> DataFrame:
    """Add ``split``: the last rows of a series are test, those before them val.

    ``validation_size`` is a share of the rows that are not test rows.
    """
    placed = check_series(df).withColumn("__at", F.row_number().over(in_time()) - 1).withColumn("__n", F.count("*").over(by_series()))
    test_from = F.floor(F.col("__n") * F.lit(1 - test_size))
    val_from = F.floor(test_from * F.lit(1 - validation_size))
    split = F.when(F.col("__at") < val_from, "train").when(F.col("__at") < test_from, "val").otherwise("test")
    return placed.withColumn("split", split).drop("__at", "__n")
