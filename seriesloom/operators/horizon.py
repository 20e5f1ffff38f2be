"""Step of a series, and the dates that follow it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.calendar import step_date
from ..schema import KEYS, in_time


# Days between dates a month, a quarter or a year apart.
SPANS = {"M": (28, 31), "Q": (89, 92), "Y": (365, 366)}


def infer_freq(df: DataFrame) -> DataFrame:
    """Most common gap between dates, the shorter one on a tie, and its class.

    7 days are a week (W), 28 to 31 a month (M), 89 to 92 a quarter (Q), 365 or
    366 a year (Y); ME, QE and YE if every date is the last of its month.
    Anything else is D, steps of ``gap_days`` days; a single row has no gap.
    """
    gap = F.datediff("ds", F.lag("ds").over(in_time()))
    ends = F.col("ds") == F.last_day("ds")
    counted = (
        df.select(*KEYS, gap.alias("gap"), ends.alias("ends"))
        .groupBy(*KEYS, "gap")
        .agg(F.count("*").alias("n"), F.bool_and("ends").alias("ends"))
        .withColumn("ends", F.bool_and("ends").over(Window.partitionBy(*KEYS)))
    )
    # A single-row series only has the null gap, which sorts last.
    common_first = Window.partitionBy(*KEYS).orderBy(
        F.col("gap").isNull(), F.col("n").desc(), F.col("gap")
    )
    top = counted.withColumn("__r", F.row_number().over(common_first)).where("__r = 1")
    freq = F.when(F.col("gap") == 7, "W")
    for name, (least, most) in SPANS.items():
        freq = freq.when(F.col("gap").between(least, most), F.when(F.col("ends"), f"{name}E").otherwise(name))
    return top.select(*KEYS, F.col("gap").alias("gap_days"), freq.otherwise("D").alias("freq"))


def future_dates(df: DataFrame, periods: int, freq: str | None = None) -> DataFrame:
    """The ``periods`` dates after the last one of each series, by its own step.

    ``freq`` (D, W, M, Q, Y, or one of the last three with E) overrides the inferred step.
    """
    last = df.groupBy(*KEYS).agg(F.max("ds").alias("last"))
    if freq:
        stepped = last.withColumns({"freq": F.lit(freq), "gap_days": F.lit(1)})
    else:
        stepped = last.join(infer_freq(df), KEYS)
    return (
        stepped.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
        .withColumn("ds", step_date(F.col("last"), F.col("freq"), F.col("step"), F.col("gap_days")))
        .select(*KEYS, "step", "ds")
    )
