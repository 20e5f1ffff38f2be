"""Search interest out of an event log: what a trends service would return.

Logs are unbounded and their keys are skewed. Every operator here first
aggregates with map-side combining, on a key that is as fine as the result
allows, so that a hot key arrives at a shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.calendar import bucket_date
from ..schema import KEYS
from ..session import numbered
from .merging import MAX_KEYWORDS


def interest_over_time(
    log: DataFrame, key: str, ts: str, bucket: str = "day", group: str | None = None, size: int = MAX_KEYWORDS
) -> DataFrame:
    """Counts per key and bucket, scaled so that the peak of the group is 100.

    The result is a series table. Without a ``group`` column the keys are taken
    in name order, ``size`` to a request.
    """
    found = [F.col(group).cast("string").alias("group_id")] if group else []
    day = bucket_date(ts, bucket)
    complete = F.col(key).isNotNull() & F.col(ts).isNotNull()
    counts = (
        log.where(complete & F.col(group).isNotNull() if group else complete)
        .select(*found, F.col(key).cast("string").alias("series_id"), day.alias("ds"))
        .groupBy(*[c for c in ("group_id",) if group], "series_id", "ds")
        .agg(F.count("*").alias("n"))
    )
    if not group:
        names = numbered(counts.select("series_id").distinct(), ["series_id"])
        requests = names.select("series_id", F.floor(F.col("number") / size).cast("string").alias("group_id"))
        counts = counts.join(requests, "series_id")
    peaks = counts.groupBy("group_id").agg(F.max("n").alias("peak"))
    scaled = F.round(F.col("n") * 100 / F.col("peak"))
    return counts.join(peaks, "group_id").select(*KEYS, "ds", scaled.alias("y"))


def related_queries(
    log: DataFrame,
    keywords: list[str],
    k: int = 25,
    user: str = "user_id",
    query: str = "query",
    ts: str = "ts",
    span: tuple | None = None,
) -> DataFrame:
    """Queries of the users who searched for a keyword: ``top`` by count, ``rising`` by growth.

    Growth compares the second half of the log's span with the first, in percent
    of the first (of one search where there was none). A keyword nobody searched
    for has no rows. A user is marked with those of the request's keywords that it
    searched for, instead of being paired with itself. ``span`` (first, last) saves
    looking the ends of the log up.
    """
    wanted = list(keywords)
    columns = ["series_id", "kind", "query", "value"]
    # One time, fetched so that it is a literal in the next scan. It travels as
    # text, which the session's time zone reads as it wrote it.
    if span is None:
        first, last = F.min(ts), F.max(ts)
        middle = log.agg((first + (last - first) / 2).cast("string")).first()[0]
    else:
        middle = str(span[0] + (span[1] - span[0]) / 2)
    if middle is None:
        return log.sparkSession.createDataFrame([], "series_id string, kind string, query string, value bigint")
    late = F.col(ts) > F.lit(middle).cast(log.schema[ts].dataType)
    searches = (
        log.groupBy(F.col(user).alias("user"), F.col(query).alias("query"))
        .agg(F.count("*").alias("n"), F.count_if(late).alias("n_late"))
    )
    marked = (
        searches.where(F.col("query").isin(wanted)).groupBy("user").agg(F.collect_set("query").alias("searched"))
    )
    related = (
        searches.join(marked, "user")
        .withColumn("series_id", F.explode("searched"))
        .where(F.col("query") != F.col("series_id"))
        .groupBy("series_id", "query")
        .agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late"))
    )
    early = F.col("n") - F.col("n_late")
    growth = F.round((F.col("n_late") - early) * 100.0 / F.greatest(early, F.lit(1))).cast("bigint")
    kinds = F.array(
        F.struct(F.lit("top").alias("kind"), F.col("n").alias("value")),
        F.struct(F.lit("rising").alias("kind"), growth.alias("value")),
    )
    listed = related.select("series_id", "query", F.explode(kinds).alias("e")).select("series_id", "query", "e.*")
    best = Window.partitionBy("series_id", "kind").orderBy(F.col("value").desc(), "query")
    return listed.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k).select(*columns)


def landed_related_queries(related: DataFrame, keyword: str, k: int = 25) -> DataFrame:
    """The best ``k`` of each kind from a landed related(series_id, kind, query, value) table."""
    best = Window.partitionBy("series_id", "kind").orderBy(F.col("value").desc(), "query")
    mine = related.where((F.col("series_id") == keyword) & F.col("kind").isin("top", "rising"))
    return mine.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k).drop("__r")


def trending(
    log: DataFrame, geo: str, k: int = 20, query: str = "query", ts: str = "ts", bucket: str = "day"
) -> DataFrame:
    """Most frequent queries of one country in the latest bucket of its log.

    Country codes are compared in upper case, as ``sources.logs.normalize_geo``
    lands them; so a plain predicate reaches the scan. The latest time is fetched
    first, so the counting scan reads one bucket only. There is no worldwide
    list: '' is no country and gives no rows.
    """
    here = log.where(F.col("geo") == geo.strip().upper())
    latest = here.agg(F.date_trunc(bucket, F.max(ts)).cast("string")).first()[0]
    schema = f"geo string, query {log.schema[query].dataType.simpleString()}, n bigint, rank int"
    if not geo or latest is None:
        return log.sparkSession.createDataFrame([], schema)
    counted = (
        here.where(F.col(ts) >= F.lit(latest).cast(log.schema[ts].dataType))
        .groupBy(F.col("geo"), F.col(query).alias("query"))
        .agg(F.count("*").alias("n"))
    )
    # Each task keeps its best k, and only those are ranked.
    best = [F.col("n").desc(), F.col("query")]
    top = counted.orderBy(*best).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy("geo").orderBy(*best)))
