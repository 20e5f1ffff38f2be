"""Landed extracts: wide files of one column per keyword, and the long form."""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import PARTIAL_FLAG
from ..schema import KEYS, SERIES_SCHEMA, quoted

log = logging.getLogger(__name__)


def wide_schema(keywords: list[str], index: str = "date", partial: bool = True, kind: str = "double") -> T.StructType:
    """Schema of an extract: the date, a column per keyword, the marker column."""
    schema = T.StructType().add(index, T.DateType())
    for word in keywords:
        schema = schema.add(word, kind)
    return schema.add(PARTIAL_FLAG, T.BooleanType()) if partial else schema


def read_trends(spark: SparkSession, path, fmt: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    """A typed table out of landed files. The schema is given, never inferred."""
    if schema is None:
        schema = SERIES_SCHEMA
    reader = spark.read.schema(schema)
    if fmt == "csv":
        # Matching by position would shift every column of a file that lacks the marker.
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    return reader.format(fmt).load(path)


def to_long(
    wide: DataFrame, keywords: list[str] | None = None, group_id: str | None = None, index: str = "date", kind: str = "double"
) -> DataFrame:
    """One row per date and keyword. Pass kind='string' to keep text for ``clean``.

    The request is the column ``group_id``, or the given one. Without ``keywords``
    every column but the date, the request and the marker of partial rows is one.
    """
    if keywords is None:
        keywords = [c for c in wide.columns if c not in (index, "group_id", "isPartial")]
    group = F.col("group_id") if group_id is None else F.lit(group_id)
    values = [quoted(k).cast(kind).alias(k) for k in keywords]
    narrow = wide.select(group.alias("group_id"), F.col(index).cast("date").alias("ds"), *values)
    long = narrow.unpivot(["group_id", "ds"], [quoted(k) for k in keywords], "series_id", "y")
    return long.select(*KEYS, "ds", "y")


def to_wide(long: DataFrame, keywords: list[str] | None = None, keys=("ds",)) -> DataFrame:
    """One column per keyword.

    Without ``keywords`` all that occur, sorted, which costs a job to find them;
    keywords that are given are the columns, and the others are left out.
    """
    if keywords is None:
        keywords = [r["series_id"] for r in long.select("series_id").distinct().orderBy("series_id").collect()]
    return long.groupBy(*keys).pivot("series_id", list(keywords)).agg(F.first("y"))


def read_periods(spark: SparkSession, paths: list[str], fmt: str = "csv", schema: T.StructType | None = None) -> list:
    """Extracts of successive periods for ``merge_periods``; one that never landed is skipped."""
    found = []
    for path in paths:
        try:
            found.append(read_trends(spark, path, fmt, schema))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("No extract at %s", path)
    return found


def extract_metadata(df: DataFrame, timeframe: str, geo: str, collected_at: dt.datetime | None = None) -> DataFrame:
    """The one-row description of an extract, of what was asked for."""
    facts = df.agg(
        F.countDistinct("ds").alias("n_dates"),
        F.countDistinct("series_id").alias("n_keywords"),
        F.min("ds").alias("first_date"),
        F.max("ds").alias("last_date"),
    )
    return facts.select(
        "*",
        F.lit(timeframe).alias("timeframe"),
        F.lit(geo or "Worldwide").alias("geo"),
        F.lit((collected_at or dt.datetime.now(dt.timezone.utc)).isoformat()).alias("collected_at"),
    )


def extract_keywords(df: DataFrame) -> DataFrame:
    """The keywords of an extract, as a table: there may be more than fit in a row."""
    return df.select(*KEYS).distinct()


def write_raw(df: DataFrame, path: str, timeframe: str, geo: str, fmt: str = "parquet") -> None:
    """Write an extract by region, with its description and keywords next to it."""
    tagged = df.withColumn("geo", F.lit(geo or "Worldwide"))
    writer = tagged.write.mode("overwrite").partitionBy("geo").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(f"{path}/data")
    extract_keywords(df).write.mode("overwrite").json(f"{path}/keywords")
    extract_metadata(df, timeframe, geo).write.mode("overwrite").json(f"{path}/metadata")
