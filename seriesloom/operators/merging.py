"""Putting separately fetched extracts together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS, check_series, quoted

MAX_KEYWORDS = 5  # fixed value: keywords of a request, where no other size is asked for
GROUP_PARTS = 64  # parts a group's series are dealt to when they meet its dates


def _stack(frames: list[DataFrame]) -> DataFrame:
    if not frames:
        raise ValueError("Nothing to merge")
    return reduce(DataFrame.unionByName, frames)


def merge_periods(periods: list[DataFrame]) -> DataFrame:
    """One table out of extracts of successive periods.

    Where periods overlap, the earliest period in the list gives the value, null
    or not. ``min_by`` combines on the map side, so overlapping copies of a day
    meet before the shuffle.
    """
    tagged = [p.select(*KEYS, "ds", "y", F.lit(i).alias("period")) for i, p in enumerate(periods)]
    return _stack(tagged).groupBy(*KEYS, "ds").agg(F.min_by("y", "period").alias("y"))


def merge_batches(batches: list[DataFrame], group_id: str | None = None) -> DataFrame:
    """One request out of batches of keywords: a full outer join on the date.

    Each series gets a row for every date any series of the request has; a date
    its batch lacked has a null value. With ``group_id`` all batches become that
    one request.
    """
    stacked = _stack([b.select(*KEYS, "ds", "y") for b in batches])
    if group_id is not None:
        stacked = stacked.withColumn("group_id", F.lit(group_id))
    return complete_grid(stacked)


def merge_wide(batches: list[DataFrame], index: str = "date") -> DataFrame:
    """Batches with one column per keyword as one table: a full outer join on the date.

    Columns come batch by batch; a date a batch lacks has nulls in its columns. A name
    that an earlier batch has already gets the number of its batch behind it (``word_2``
    in the second; once more, if that is taken too). Rows without a date are left out; a
    date that occurs twice in a batch is an error when the result is read. The batches
    are stacked and grouped by date, so each row is shuffled once however many batches
    there are, where a chain of joins would shuffle the growing table again and again.
    """
    if not batches:
        raise ValueError("Nothing to merge")
    counts = [f"__n{i}" for i in range(1, len(batches) + 1)]
    taken, narrow, kept = {index.lower(), "__batch", *counts}, [], []
    for i, batch in enumerate(batches, 1):
        values = []
        for name in (c for c in batch.columns if c != index):
            new = name
            while new.lower() in taken:
                new = f"{new}_{i}"
            taken.add(new.lower())
            kept.append(new)
            values.append(quoted(name).alias(new))
        narrow.append(batch.select(quoted(index).alias(index), F.lit(i).alias("__batch"), *values))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), narrow)
    # One row per date and batch: the largest value is the only one.
    merged = stacked.where(quoted(index).isNotNull()).groupBy(quoted(index)).agg(
        *[F.max(quoted(c)).alias(c) for c in kept],
        *[F.count_if(F.col("__batch") == i).alias(n) for i, n in enumerate(counts, 1)],
    )
    twice = reduce(Column.__or__, [F.col(n) > 1 for n in counts])
    told = F.raise_error(F.concat(F.lit("A batch has this date twice: "), quoted(index).cast("string")))
    once = F.when(twice, told.cast(merged.schema[index].dataType)).otherwise(quoted(index))
    return merged.select(once.alias(index), *[quoted(c) for c in kept])


def complete_grid(df: DataFrame) -> DataFrame:
    """Make the dates a series lacks, but its group has, explicit nulls.

    A series travels as one array (one element per calendar day at most), meets
    its group's distinct dates, and gains the missing ones when it is exploded
    again. The dates meet the series by group and a part of the group, so that a
    group of very many series, or the only group there is, spreads over the parts.
    If the dates are small enough to broadcast, the (group, series) distribution
    stays the one later windows need; otherwise those shuffle once more.
    """
    part = F.pmod(F.xxhash64("series_id"), F.lit(GROUP_PARTS)).cast("int")
    packed = check_series(df).groupBy(*KEYS).agg(F.collect_list(F.struct("ds", "y")).alias("seen"))
    packed = packed.withColumn("part", part)
    dates = (
        packed.select("group_id", "part", F.explode("seen.ds").alias("ds"))
        .groupBy("group_id")
        .agg(F.collect_set("ds").alias("dates"), F.collect_set("part").alias("parts"))
        .select("group_id", "dates", F.explode("parts").alias("part"))
    )
    gaps = F.transform(
        F.array_except("dates", F.col("seen.ds")),
        lambda d: F.struct(d.alias("ds"), F.lit(None).cast("double").alias("y")),
    )
    return (
        packed.join(dates, ["group_id", "part"])
        .select(*KEYS, F.explode(F.concat("seen", gaps)).alias("cell"))
        .select(*KEYS, "cell.ds", "cell.y")
    )


def batch_keywords(keywords: DataFrame, size: int = MAX_KEYWORDS, order: str = "ordinal") -> DataFrame:
    """Add ``batch``, the request a keyword travels in; ``size`` keywords to a request."""
    if size < 1:
        raise ValueError(f"A request takes at least one keyword, not {size}")
    return keywords.withColumn("batch", F.floor(F.col(order) / size).cast("int"))


def check_request(keywords: list[str], size: int = MAX_KEYWORDS) -> list[str]:
    """A single request with more keywords than ``size`` is an error."""
    if len(keywords) > size:
        raise ValueError(f"A request takes at most {size} keywords, got {len(keywords)}")
    return keywords


def split_keywords(text: str) -> list[str]:
    """The keywords of a comma-separated list, stripped; empty ones are dropped."""
    return [word for word in (part.strip() for part in text.split(",")) if word]
