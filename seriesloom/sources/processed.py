"""Processed series with their scalers."""

from __future__ import annotations

import uuid
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DataConfig
from ..schema import KEYS


def processed_metadata(df: DataFrame, scalers: DataFrame | None, config: DataConfig) -> DataFrame:
    """Shape, columns, span, settings and scaled columns of a processed table."""
    spark = df.sparkSession
    facts = df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min("ds").alias("first_date"),
        F.max("ds").alias("last_date"),
    )
    if scalers is None:
        names = spark.range(1).select(F.array().cast("array<string>").alias("scalers"))
    else:
        names = scalers.agg(F.array_sort(F.collect_set("column")).alias("scalers"))
    settings = {k: v for k, v in asdict(config).items() if k in ("normalize", "interpolate_missing", "smoothing_window")}
    # Both sides are one aggregate row.
    return facts.crossJoin(names).select(
        "*",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.struct(*[F.lit(v).alias(k) for k, v in settings.items()]).alias("config"),
        F.current_timestamp().alias("processed_at"),
    )


def write_processed(
    df: DataFrame, scalers: DataFrame | None, path: str, config: DataConfig = DataConfig(), buckets: int | None = None
) -> None:
    """Data, scalers and metadata, in folders of ``path``.

    With ``buckets`` the data lie in that many files by a hash of the series key, each
    sorted by series and date: ``read_processed`` then tells Spark so, and windows,
    decompositions and fits by series read them without a shuffle. About 128 MB to a
    bucket is a good size, and at least as many buckets as there are cores.
    """
    if buckets is None:
        df.write.mode("overwrite").parquet(f"{path}/data")
    else:
        # Spark takes a bucketed table by name only; the name goes again, the files stay.
        name = f"processed_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, *KEYS).write.bucketBy(buckets, *KEYS).sortBy(*KEYS, "ds")
        dealt.mode("overwrite").option("path", f"{path}/data").format("parquet").saveAsTable(name)
        df.sparkSession.sql(f"DROP TABLE {name}")
    if scalers is not None:
        scalers.write.mode("overwrite").parquet(f"{path}/scalers")
    about = processed_metadata(df, scalers, config).withColumn("buckets", F.lit(buckets).cast("int"))
    about.write.mode("overwrite").json(f"{path}/metadata")


def read_processed(spark: SparkSession, path: str, with_scalers: bool = True):
    """(data, scalers); scalers is None if not asked for or never written."""
    data = _read_data(spark, path)
    if not with_scalers:
        return data, None
    try:
        return data, spark.read.parquet(f"{path}/scalers")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return data, None
        raise


def _read_data(spark: SparkSession, path: str) -> DataFrame:
    data = spark.read.parquet(f"{path}/data")
    try:
        about = spark.read.schema("buckets int").json(f"{path}/metadata").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        about = None
    if about is None or about.buckets is None:
        return data
    # A table of this session that names the files and how they are dealt; dropping it leaves the files.
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    place = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()
    name = f"processed_{uuid.uuid5(uuid.NAMESPACE_URL, place).hex}"
    keys = ", ".join(KEYS)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(
        f"CREATE TABLE {name} ({data.schema.toDDL()}) USING parquet CLUSTERED BY ({keys}) "
        f"SORTED BY ({keys}, ds) INTO {about.buckets} BUCKETS LOCATION '{place.replace(chr(39), chr(92) + chr(39))}'"
    )
    return spark.table(name)
