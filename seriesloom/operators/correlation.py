"""Correlation between the series of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import known
from ..schema import KEYS, check_series
from ..session import numbered, stage_table

# A task holds two blocks of a group's series. More series share a block where their calendar is shorter: about this many
# values, so that a large group has few blocks and a series is sent to few tasks.
BLOCK_VALUES = 1 << 21
# A group has as many blocks as that takes, or up to this many of at least 64 series where groups are too few to keep tasks busy.
BLOCK, BLOCKS = 64, 4
TILE = 1 << 19  # pairs that a task makes at a time

_SCHEMA = "group_id string, a string, b string, corr double"
_NO_DAY = -(2**31)  # a null date counts as one more day


def correlation_matrix(
    df: DataFrame, digits: int | None = None, size: int | None = None, top_k: int | None = None
) -> DataFrame:
    """Pearson correlation of series with one another, over the dates both have a value.

    Every two series of a group meet, however many it has: in name order they are cut
    into blocks, a series goes, packed, to each pair of blocks it takes part in, and a task
    turns one pair into matrix products, tile by tile; no row per (pair, date) exists. Only where a
    ``size`` is asked for is a group cut into requests of that many series, each with a
    matrix of its own. With ``top_k`` all series of a group meet, in blocks of ``size`` or more,
    and a series keeps its ``top_k`` strongest partners (by size of the correlation, then
    by name; itself left out), so a large group gives that many rows a series and not
    its square.
    """
    pairs = _by_block(df, size, None, size is None or top_k is not None).applyInArrow(_correlate(False, top_k), _SCHEMA)
    if top_k is not None:
        best = Window.partitionBy("group_id", "a").orderBy(F.abs("corr").desc_nulls_last(), "b")
        pairs = pairs.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= top_k).drop("__r")
    if digits is None:
        return pairs
    return pairs.withColumn("corr", F.round("corr", digits))


def correlation_lower(
    df: DataFrame, digits: int | None = None, size: int | None = None, order: list[str] | None = None
) -> DataFrame:
    """The strictly lower triangle of the matrix of a group, or of each request of ``size``: ``a`` comes after ``b``.

    Series come in the ``order`` they were asked for, those not named behind by name;
    without it in name order. Only the triangle is made.
    """
    pairs = _by_block(df, size, order, size is None).applyInArrow(_correlate(True, None), _SCHEMA)
    return pairs if digits is None else pairs.withColumn("corr", F.round("corr", digits))


def days_of_groups(packed: DataFrame) -> DataFrame:
    """``group_id, dates``: on how many dates the series of a group have rows."""
    dates = packed.select("group_id", F.explode("days").alias("day")).distinct()
    return dates.groupBy("group_id").agg(F.count("*").alias("dates"))


def blocks_of(series: Column, dates: Column, least: int = BLOCK, tasks: Column | None = None) -> Column:
    """Blocks of a group of so many series, on so many dates, of ``least`` series or more.

    A series is sent once for each block, so a group that is to have only so many
    ``tasks`` has no more blocks than make so many pairs, or than its size takes.
    """
    held = F.greatest(F.floor(F.lit(BLOCK_VALUES) / dates), F.lit(least))
    busy = F.least(F.lit(BLOCKS), F.ceil(series / F.lit(least)))
    if tasks is not None:
        busy = F.least(busy, F.ceil((F.sqrt(8 * tasks + 1) - 1) / 2))
    return F.greatest(F.ceil(series / held), busy, F.lit(1)).cast("int")


def routed(df: DataFrame, size: int | None, order: list[str] | None, meet: bool) -> DataFrame:
    """A packed row of each series, once for each block it is compared with: its own or, if they ``meet``, all of its group."""
    cell = F.struct(F.coalesce(F.unix_date("ds"), F.lit(_NO_DAY)).alias("day"), known("y").alias("y"))
    packed = check_series(df).groupBy(*KEYS).agg(F.sort_array(F.collect_list(cell)).alias("c"), F.avg(known("y")).alias("mean"))
    packed = stage_table(packed.select(*KEYS, F.col("c.day").alias("days"), F.col("c.y").alias("ys"), "mean"), "packed")
    asked = F.array(*[F.lit(s) for s in order or []]).cast("array<string>")
    place = F.array_position(asked, F.col("series_id"))
    series = packed.select(*KEYS, F.when(place > 0, place).otherwise(F.lit(len(order or []) + 1)).alias("place"))
    placed = numbered(series, ["place", "series_id"], ["group_id"]).select(*KEYS, "number")
    if meet:
        count = F.col("count").cast("double")
        groups = packed.groupBy("group_id").count().join(days_of_groups(packed), "group_id")
        # Of the tasks that can run at once a group gets its share by pairs; large groups alone need several.
        every = packed.groupBy("group_id").count().agg(F.sum(count * count)).first()[0]
        tasks = count * count * df.sparkSession.sparkContext.defaultParallelism / F.lit(every)
        groups = groups.select("group_id", "count", blocks_of(count, F.col("dates"), size or BLOCK, tasks).alias("blocks"))
        placed = placed.join(groups, "group_id").select(
            *KEYS, "number", "blocks", F.floor(F.col("number") * F.col("blocks") / F.col("count")).cast("int").alias("block")
        )
        others = F.sequence(F.lit(0), F.col("blocks") - 1)
    else:
        placed = placed.select(*KEYS, "number", F.floor(F.col("number") / (size or BLOCK)).cast("int").alias("block"))
        others = F.array("block")
    # A series is repeated behind the join, which thus moves it once.
    met = packed.join(placed, KEYS).select("*", F.explode(others).alias("other"))
    return met.select(
        *KEYS, "number", "days", "ys", "mean", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )


def _by_block(df: DataFrame, size: int | None, order: list[str] | None, meet: bool):
    # A task's time is that of its pairs, not of its bytes, by which adaptive execution would merge them.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return routed(df, size, order, meet).repartition(tasks, "group_id", "i", "j").groupBy("group_id", "i", "j")


def _correlate(lower: bool, top_k: int | None) -> Callable:
    """Task side: the pairs of a block with another, or of those the strongest of each series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("series_id")
        group = rows.column("group_id")[0].as_py()
        home, number = rows.column("block").to_numpy(), rows.column("number").to_numpy()
        first, second = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        names = rows.column("series_id").combine_chunks()
        # Centered first: raw moments of a large, flat series cancel badly.
        series, day, y = unnested(rows.column("days"), rows.column("ys"))
        if np.any((series[1:] == series[:-1]) & (day[1:] == day[:-1])):
            raise ValueError("A series has two rows for a date: merge them first (operators.merging)")
        values = on_calendar(series, day, y - rows.column("mean").to_numpy()[series], len(rows))
        left, right = np.flatnonzero(home == first), np.flatnonzero(home == second)
        z = values[:, right]
        back = []
        step = max(1, TILE // max(1, len(right)))
        for own in np.split(left, range(step, len(left), step)):
            corr = pairwise(values[:, own], z)
            if top_k is not None:
                # Pairs without a correlation come last; a series is no partner of its own.
                sizes = np.where(np.isnan(corr), -1.0, np.abs(corr))
                sizes[own[:, None] == right] = -2.0
                a, b = strongest(sizes, top_k)
                yield pairs_batch(group, names, own[a], right[b], corr[a, b])
                if first != second:
                    b, a = strongest(sizes.T, top_k)
                    back.append((b, own[a], corr[a, b], sizes[a, b]))
                continue
            a, b = np.repeat(own, len(right)), np.tile(right, len(own))
            if not lower:
                yield pairs_batch(group, names, a, b, corr.ravel())
                if first != second:
                    yield pairs_batch(group, names, b, a, corr.ravel())
            elif first != second:
                # Of two blocks, the series of the second come after those of the first.
                yield pairs_batch(group, names, b, a, corr.ravel())
            else:
                under = number[a] > number[b]
                yield pairs_batch(group, names, a[under], b[under], corr.ravel()[under])
        if back:
            a, b, corr = strongest_of_tiles(back, top_k)
            yield pairs_batch(group, names, right[a], b, corr)

    return run


def unnested(days: pa.ChunkedArray, values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists of days and values of series: series, day and value (NaN for null) of each."""
    days, values = days.combine_chunks(), values.combine_chunks()
    series = np.repeat(np.arange(len(days)), pc.list_value_length(days).to_numpy(zero_copy_only=False).astype(np.int64))
    day = days.flatten().to_numpy(zero_copy_only=False)
    return series, day, values.flatten().to_numpy(zero_copy_only=False).astype(float)


def on_calendar(series: np.ndarray, day: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """A row per date that any of the ``count`` series has, a column per series; of several values the last."""
    calendar, at = np.unique(day, return_inverse=True)
    grid = np.full((len(calendar), count), np.nan)
    grid[at, series] = values
    return grid


def strongest(sizes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``count`` largest of each row, ties to the first column; -2 is never taken."""
    if not sizes.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(sizes, -count, axis=1)[:, -count:][:, :1] if count < sizes.shape[1] else -1.0
    a, b = np.nonzero((sizes >= least) & (sizes > -2.0))
    return _leading(a, b, sizes[a, b], count)[:2]


def _leading(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a`` and ``b`` of the ``count`` largest of each ``a``, ties to the smaller ``b``; where they were."""
    order = np.lexsort((b, -sizes, a))
    ranked = a[order]
    new = np.flatnonzero(np.diff(ranked, prepend=-1))
    place = np.arange(len(ranked)) - np.repeat(new, np.diff(np.append(new, len(ranked))))
    order = order[place < count]
    return a[order], b[order], order


def strongest_of_tiles(found: list[tuple], count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strongest of each ``a`` among ``a, b, corr, size`` of several tiles."""
    a, b, corr, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b, at = _leading(a, b, sizes, count)
    return a, b, corr[at]


def pairs_batch(group: str, names: pa.Array, a: np.ndarray, b: np.ndarray, corr: np.ndarray) -> pa.RecordBatch:
    """Pairs of series by their places in ``names``; no correlation is null."""
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(group, pa.string()), len(a)), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(corr, pa.float64(), from_pandas=True)],
        names=["group_id", "a", "b", "corr"],
    )


def pairwise(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Correlations of the columns of x with those of z, where both have values."""
    mx, mz = ~np.isnan(x), ~np.isnan(z)
    x, z = np.where(mx, x, 0.0), np.where(mz, z, 0.0)
    mx, mz = mx.astype(float), mz.astype(float)
    n = mx.T @ mz
    sx, sz = x.T @ mz, mx.T @ z
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = x.T @ z - sx * sz / n
        var_x = (x * x).T @ mz - sx * sx / n
        var_z = mx.T @ (z * z) - sz * sz / n
        corr = cov / np.sqrt(var_x * var_z)
    corr[(n < 2) | (var_x <= 0) | (var_z <= 0)] = np.nan
    return np.clip(corr, -1.0, 1.0)
