"""Session defaults and the one way this library cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .schema import KEYS

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("seriesloom")
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        # Small tables still use every core: partitions are merged up to 128 KB only.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def spread_series(df: DataFrame) -> DataFrame:
    """Place whole series over all shuffle partitions.

    For stages that fit models: a series costs them processor time and few bytes,
    while adaptive execution merges partitions by their bytes. This takes the
    place of the shuffle a grouping by series would need; it adds none.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *KEYS)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session may fall back to a temporary folder: on a cluster that
    would be private to one machine and gone with it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="seriesloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_STAGED: list[str] = []


@contextmanager
def staging(spark: SparkSession):
    """Delete the tables staged inside, when what was made of them has been written elsewhere.

    >>> with staging(spark):
    ...     run(series)["forecasts"].write.parquet(path)
    """
    before = len(_STAGED)
    try:
        yield
    finally:
        made = _STAGED[before:]
        del _STAGED[before:]
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in made:
            place = hadoop(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stage_table(df: DataFrame, name: str, by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back, in a folder for each value of the columns ``by``.

    For a result several later jobs read: the written table survives the loss of
    executors, keeps column pruning and filter pushdown, and ends the lineage.
    Without ``codec`` it is compressed as the session says.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/seriesloom/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path, compression=codec)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns) if by else spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """``rows`` with ``number``: 0, 1, … in the order of columns whose values are unique together.

    With ``within`` each combination of those columns counts from 0; they come first
    in the order. Rows are ranged and written once, numbered inside each range and
    shifted by the ranges before it, so no task holds all of them, or all of a group.
    """
    keys = [*(within or []), *order]
    ranged = rows.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id())
    ranged = stage_table(ranged, "ranged")
    own = ["__range", *(within or [])]
    sizes = ranged.groupBy(*own).agg(F.count("*").alias("__size"))
    # One row per range, and group in it.
    before = Window.partitionBy(*(within or [])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0))).drop("__size")
    inside = F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1
    out = ranged.withColumn("__inside", inside).join(shifts, own)
    return out.withColumn("number", F.col("__inside") + F.col("__before")).select(*rows.columns, "number")
