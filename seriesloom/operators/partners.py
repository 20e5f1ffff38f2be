"""The strongest partners of each series of a large group, without comparing every two blocks of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import dot
from ..functions.calendar import known
from ..schema import KEYS, check_series
from ..session import numbered, stage_table
from .correlation import TILE, blocks_of, days_of_groups, on_calendar, pairs_batch, pairwise, strongest, strongest_of_tiles, unnested
from .merging import GROUP_PARTS

BLOCK = 128  # series of a block; a task holds two runs of blocks
PIVOTS = 32  # series of a group, at most, that all others are measured against
DRAWN = 4  # series that are drawn for each pivot, from which those far from one another are taken
NEAR = 0.5  # a series at less than this angle to a pivot is none itself
# Room for rounding, in radians (an arc cosine near 1 loses half the digits) and in units of a correlation.
ANGLE_ROOM, CORR_ROOM = 1e-6, 1e-9
TIE_DIGITS = 10  # correlations that agree so far are ties

_PAIRS = "group_id string, a string, b string, corr double"


def strongest_partners(
    df: DataFrame, top_k: int, size: int = BLOCK, pivots: int = PIVOTS, digits: int | None = None
) -> DataFrame:
    """``group_id, a, b, corr``: the ``top_k`` partners of each series that correlate most with it, either way.

    The result is that of comparing every two series of the group over the dates both
    have a value: strongest first by size of the correlation, ties by name. Pairs
    without a correlation (a flat series, fewer than two common dates) are no partners,
    so a series may have fewer than ``top_k``, or no row.

    Centered series of one length are directions, whose angles obey the triangle
    inequality. Each is measured against a few pivots, far from one another, and those near the same pivot
    share a block. A block's own pairs give every member a correlation its partners must
    reach; two blocks whose angles to some pivot lie too far apart for that are not
    compared. This holds for the series that have the dates most series of the
    group have; blocks with any other are compared with all. A task brings two runs of
    blocks together, so that a large group has few pairs of runs and a block is sent to few tasks.
    """
    blocks = measured_blocks(df, top_k, size, pivots)
    runs = _runs(blocks)
    spans = runs.groupBy("group_id", "run").agg(
        F.bool_and("whole").alias("whole"), _span(F.min, "low", pivots).alias("low"), _span(F.max, "high", pivots).alias("high"),
        F.array(F.min(F.array_min("reach"))).alias("reach"),
    )
    needed = block_pairs(spans.withColumnRenamed("run", "block")).where("needed").select("group_id", "i", "j")
    sides = needed.select("*", F.col("i").alias("run")).unionByName(needed.where("i < j").select("*", F.col("j").alias("run")))
    # A task's time is that of its pairs, not of its bytes, by which adaptive execution would merge them.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = runs.join(sides, ["group_id", "run"]).repartition(tasks, "group_id", "i", "j")
    pairs = met.groupBy("group_id", "i", "j").applyInArrow(_compare(top_k), _PAIRS)
    best = Window.partitionBy("group_id", "a").orderBy(F.round(F.abs("corr"), TIE_DIGITS).desc(), "b")
    pairs = pairs.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= top_k).drop("__r")
    return pairs if digits is None else pairs.withColumn("corr", F.round("corr", digits))


def measured_blocks(df: DataFrame, top_k: int, size: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """A row per block: its members, the span of their angles to each pivot, and the least correlation that can matter."""
    series = _angles(_packed(df), pivots)
    placed = numbered(series, ["angle", "series_id"], ["group_id", "near"])
    # A block holds series near one pivot only, and those of a pivot are alike in size, so that none has a few members
    # only, which would have to meet all. A group has a row per pivot here.
    full = series.groupBy("group_id", "near").agg(F.count("*").alias("of")).withColumn("n", F.ceil(F.col("of") / size))
    before = Window.partitionBy("group_id").orderBy("near").rowsBetween(Window.unboundedPreceding, -1)
    full = full.select("group_id", "near", "of", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    placed = placed.join(full, ["group_id", "near"])
    placed = placed.withColumn("block", (F.col("first") + F.floor(F.col("number") * F.col("n") / F.col("of"))).cast("int"))
    member = F.struct("number", "series_id", "days", "dev", "angles")
    blocks = placed.groupBy("group_id", "block").agg(
        F.bool_and("whole").alias("whole"), F.sort_array(F.collect_list(member)).alias("m")
    )

    def span(pick) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(F.col("m.angles")[0]) - 1), lambda p: pick(F.transform("m.angles", lambda a: F.get(a, p)))
        )

    blocks = blocks.select(
        "group_id", "block", "whole", F.col("m.series_id").alias("names"), "m.days", F.col("m.dev").alias("devs"),
        F.when(F.col("whole"), span(F.array_min)).alias("low"),
        F.when(F.col("whole"), span(F.array_max)).alias("high"),
    )
    reach = T.StructField("reach", T.ArrayType(T.DoubleType()))
    return stage_table(blocks.mapInArrow(_reaches(top_k), T.StructType([*blocks.schema.fields, reach])), "blocks")


def _reaches(top_k: int) -> Callable:
    """Task side: blocks with the correlation each member has with its ``top_k``-th partner in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                side = _members(pa.Table.from_batches([batch.slice(i, 1)]))
                every = np.arange(len(side["names"]))
                sizes = np.abs(_between(side, every, every))
                np.fill_diagonal(sizes, np.nan)
                sizes = np.where(np.isnan(sizes), 0.0, sizes)
                # With fewer than top_k others here, any partner matters.
                own = np.partition(sizes, -top_k, axis=1)[:, -top_k] if top_k < len(sizes) else np.zeros(len(sizes))
                found.append(own.tolist())
            yield batch.append_column("reach", pa.array(found, pa.list_(pa.float64())))

    return run


def block_pairs(blocks: DataFrame) -> DataFrame:
    """``group_id, i, j, needed`` for every two blocks of a group, i up to j: whether a partner may lie across them."""
    about = blocks.select("group_id", "block", "whole", "low", "high", F.array_min("reach").alias("least"))
    last = about.groupBy("group_id").agg(F.max("block").alias("last"))
    left = about.join(last, "group_id").select(
        "group_id", F.col("block").alias("i"), "whole", "low", "high", "least", F.explode(F.sequence("block", "last")).alias("j")
    )
    names = {c: F.col(c).alias(f"{c}_j") for c in ("whole", "low", "high", "least")}
    both = left.join(about.select("group_id", F.col("block").alias("j"), *names.values()), ["group_id", "j"])
    apart = F.array_max(
        F.concat(F.zip_with("low", "high_j", lambda x, y: x - y), F.zip_with("low_j", "high", lambda x, y: x - y))
    )
    at_most = F.cos(F.greatest(apart - ANGLE_ROOM, F.lit(0.0)))
    needed = (F.col("i") == F.col("j")) | ~F.col("whole") | ~F.col("whole_j")
    needed = needed | (at_most >= F.least("least", "least_j") - CORR_ROOM)
    return both.select("group_id", "i", "j", needed.alias("needed"))


def _packed(df: DataFrame) -> DataFrame:
    """A row per series that is not flat: its days, its values less their mean, and whether it has the usual days."""
    seen = check_series(df).withColumn("y", known("y")).where("y is not null and ds is not null")
    cells = F.sort_array(F.collect_list(F.struct(F.unix_date("ds").alias("day"), "y")))
    packed = seen.groupBy(*KEYS).agg(cells.alias("c"), F.avg("y").alias("mean"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    packed = packed.where("lo < hi").select(
        *KEYS, F.col("c.day").alias("days"), F.transform("c.y", lambda y: y - F.col("mean")).alias("dev")
    )
    packed = packed.withColumn("length", F.sqrt(dot(F.col("dev"), F.col("dev"))))
    packed = stage_table(packed.withColumn("part", F.pmod(F.xxhash64("series_id"), F.lit(GROUP_PARTS)).cast("int")), "packed")
    calendars = packed.groupBy("group_id", "days").agg(F.count("*").alias("n"))
    usual = calendars.groupBy("group_id").agg(F.max(F.struct("n", "days"))["days"].alias("usual"))
    # A group's days meet its series part by part, so that one large group spreads.
    parts = packed.select("group_id", "part").distinct()
    return packed.join(parts.join(usual, "group_id"), ["group_id", "part"]).select(
        *packed.columns, (F.col("days") == F.col("usual")).alias("whole")
    )


def _angles(packed: DataFrame, pivots: int) -> DataFrame:
    """Angles, up to a right one, between the line of each whole series and those of its group's pivots; the nearest."""
    whole = packed.where("whole")
    drawn = Window.partitionBy("group_id").orderBy(F.xxhash64("series_id"), "series_id")
    names = whole.select(*KEYS).withColumn("r", F.row_number().over(drawn)).where(F.col("r") <= DRAWN * pivots).drop("r")
    lines = whole.join(names, KEYS).select("group_id", "series_id", F.transform("dev", lambda v: v / F.col("length")).alias("line"))

    def far_apart(rows: pa.Table) -> pa.Table:
        drawn = sorted(rows.to_pylist(), key=lambda r: r["series_id"])
        table = np.array([r["line"] for r in drawn])
        taken, near = [0], np.abs(table @ table[0])
        while len(taken) < pivots and near.min() < np.cos(NEAR):
            taken.append(int(near.argmin()))
            near = np.maximum(near, np.abs(table @ table[taken[-1]]))
        return pa.table({"group_id": [drawn[0]["group_id"]], "lines": [[drawn[i]["line"] for i in taken]]})

    drawn_lines = lines.groupBy("group_id").applyInArrow(far_apart, "group_id string, lines array<array<double>>")
    parts = whole.select("group_id", "part").distinct()
    met = packed.join(parts.join(drawn_lines, "group_id"), ["group_id", "part"], "left")
    cosine = F.transform("lines", lambda line: F.least(F.abs(dot(F.col("dev"), line)) / F.col("length"), F.lit(1.0)))
    angles = F.when(F.col("whole"), F.transform(cosine, F.acos))
    met = stage_table(met.select(*KEYS, "days", "dev", "whole", angles.alias("angles")), "angles")
    angle = F.array_min("angles")
    return met.select(
        *KEYS, "days", "dev", "whole", "angles", F.coalesce(angle, F.lit(0.0)).alias("angle"),
        F.when(F.col("whole"), F.array_position("angles", angle)).otherwise(pivots + 1).alias("near"),
    )


def _runs(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``run``: neighbouring blocks of a group, in number, that go to a task together."""
    dates = days_of_groups(blocks.select("group_id", F.explode("days").alias("days")))
    groups = blocks.groupBy("group_id").agg(F.sum(F.size("names")).cast("double").alias("series"), F.count("*").alias("of"))
    groups = groups.join(dates, "group_id")
    count = F.least(blocks_of(F.col("series"), F.col("dates")), F.col("of"))
    run = F.floor(F.col("block") * count / F.col("of")).cast("int")
    return blocks.join(groups, "group_id").select(*blocks.columns, run.alias("run"))


def _span(pick: Callable, column: str, pivots: int) -> Column:
    """The least or largest of each place of an array; places that no row has are left out."""
    return F.array_compact(F.array(*[pick(F.get(F.col(column), F.lit(p))) for p in range(pivots)]))


def _members(rows: pa.Table) -> dict:
    """The members of blocks: as they are those that have the usual days, and if others are here all on one calendar."""
    blocks = rows.column("names").combine_chunks()
    home = np.repeat(np.arange(len(rows)), blocks.value_lengths().to_numpy())
    names = blocks.flatten()
    series, day, dev = unnested(*(pa.chunked_array([rows.column(c).combine_chunks().flatten()]) for c in ("days", "devs")))
    whole = rows.column("whole").to_numpy()[home]
    side = {"names": names, "home": home, "whole": whole, "line": np.cumsum(whole) - 1}
    if whole.any():
        side["lines"] = dev[whole[series]].reshape(whole.sum(), -1)
    if not whole.all():
        side["values"] = on_calendar(series, day, dev, len(names))
    return side


def _between(side: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Correlations of some members with others."""
    if not (side["whole"][left].all() and side["whole"][right].all()):
        return pairwise(side["values"][:, left], side["values"][:, right])
    x, z = side["lines"][side["line"][left]], side["lines"][side["line"][right]]
    return np.clip((x @ z.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(z, axis=1)), -1.0, 1.0)


def _compare(top_k: int) -> Callable:
    """Task side: of two runs of blocks the strongest partners of each member in the other run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by([("run", "ascending"), ("block", "ascending")])
        group, first, second = (rows.column(c)[0].as_py() for c in ("group_id", "i", "j"))
        side = _members(rows)
        # Ties go by name: the first in this order.
        rank = np.empty(len(side["names"]), np.int64)
        rank[pc.sort_indices(side["names"]).to_numpy()] = np.arange(len(rank))
        by_rank = np.argsort(rank)
        reach = rows.column("reach").combine_chunks().flatten().to_numpy() - CORR_ROOM
        of = rows.column("run").to_numpy()
        mine, others = np.flatnonzero(of == first), np.flatnonzero(of == second)
        meets = _needed(rows.select(["whole", "low", "high", "reach"]).to_pylist(), mine, others)
        back, start = [], 0
        while start < len(mine):
            # Blocks that meet the same blocks are compared at once, as many as make a tile.
            met = others[meets[start]]
            columns = by_rank[np.isin(side["home"][by_rank], met)]
            stop, members = start + 1, np.flatnonzero(side["home"] == mine[start])
            while stop < len(mine) and np.array_equal(meets[stop], meets[start]) and (len(members) + 1) * len(columns) < TILE:
                members = np.append(members, np.flatnonzero(side["home"] == mine[stop]))
                stop += 1
            start = stop
            if not len(columns):
                continue
            corr = _between(side, members, columns)
            sizes = np.where(np.isnan(corr), -2.0, np.abs(corr))
            sizes[members[:, None] == columns] = -2.0
            ties = np.round(sizes, TIE_DIGITS)
            a, b = strongest(np.where(sizes >= reach[members][:, None], ties, -2.0), top_k)
            yield pairs_batch(group, side["names"], members[a], columns[b], corr[a, b])
            if first != second:
                b, a = strongest(np.where(sizes >= reach[columns], ties, -2.0).T[:, np.argsort(rank[members])], top_k)
                a = np.argsort(rank[members])[a]
                back.append((columns[b], rank[members[a]], corr[a, b], ties[a, b]))
        if back:
            a, b, corr = strongest_of_tiles(back, top_k)
            yield pairs_batch(group, side["names"], a, by_rank[b], corr)

    return run


def _needed(blocks: list[dict], mine: np.ndarray, others: np.ndarray) -> np.ndarray:
    """The rule of ``block_pairs`` for the blocks of two runs."""
    least = np.array([min(b["reach"]) for b in blocks])
    whole = np.array([b["whole"] for b in blocks])
    needed = (mine[:, None] == others) | ~whole[mine][:, None] | ~whole[others]
    if whole[mine].any() and whole[others].any():
        count = max(len(b["low"]) for b in blocks if b["whole"])
        low, high = (np.array([b[c] if b["whole"] else [np.nan] * count for b in blocks]) for c in ("low", "high"))
        apart = np.full(needed.shape, -np.inf)
        for p in range(count):
            apart = np.fmax(apart, np.subtract.outer(low[mine, p], high[others, p]))
            apart = np.fmax(apart, np.subtract.outer(low[others, p], high[mine, p]).T)
        at_most = np.cos(np.maximum(apart - ANGLE_ROOM, 0.0))
        needed |= at_most >= np.minimum.outer(least[mine], least[others]) - CORR_ROOM
    return needed
