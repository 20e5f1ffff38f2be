"""Mixing sources to target weights: water-filled targets, copies by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .words import WORD_PATTERN, mix

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_COPIES = 2
# Residuals that meet in one group of the reduction tree, and documents of a leaf of it.
FAN, LEAF = 64, 4096


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``source, place, source_size, target`` of every source of ``sized(source, size)``.

    Sources in code point order, null last, take the weights in turn. Together they get
    ``share`` of all sizes by weight; a target stops at MAX_COPIES times its source's
    size, and what is above goes to the others by weight, until none is above.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = totals.orderBy(F.col("source").asc_nulls_last())
    numbered = order.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    sources = spark.createDataFrame(numbered, "source string, source_size long, place long")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(MAX_COPIES))
    sources = stage_table(sources, "sources")
    # The level at which weight times level fills the mix; it only rises as sources reach their most.
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("most")
        whole, capped, rest, count = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(above, 1)),
        ).first()
        if count == full or not rest:
            break
        level, full = (share * whole - capped) / rest, count
    return sources.select("source", "place", "source_size", F.least("most", F.col("weight") * level).alias("target"))


def _pivot(size: np.ndarray, part: np.ndarray, chance: np.ndarray) -> int:
    """Round ``part`` in place, pair by pair; the place of the item that is left fractional.

    A pair moves size-weighted mass from one to the other until one part is 0 or 1; which
    way is drawn so that each keeps its expectation, and their common mass stays.
    """
    held = 0
    s, p = size.tolist(), part.tolist()
    for i in range(1, len(s)):
        a, b = held, i
        up = min((1 - p[a]) * s[a], p[b] * s[b])
        down = min(p[a] * s[a], (1 - p[b]) * s[b])
        if up + down <= 0:
            rises = p[a] >= p[b]
        else:
            rises = chance[i] * (up + down) < down
        if not rises:
            a, b = b, a
            up = down
        # a takes mass from b.
        if (1 - p[a]) * s[a] <= p[b] * s[b]:
            p[b] = min(1.0, max(0.0, p[b] - up / s[b]))
            p[a] = 1.0
            held = b
        else:
            p[a] = min(1.0, max(0.0, p[a] + up / s[a]))
            p[b] = 0.0
            held = a
    part[:] = p
    return held


def _reduce(seed: int, last: bool):
    """Round each group of rows (sorted by place and bucket); one row of a group stays open, unless ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            size = rows.column("size").to_numpy().astype(float)
            part = rows.column("part").to_numpy().copy()
            with np.errstate(over="ignore"):
                own = mix(rows.column("id").to_numpy().view(np.uint64) ^ mix(rows.column("tie").to_numpy().view(np.uint64)))
                own = mix(own + np.uint64(seed))
                chance = mix(own ^ np.roll(own, 1) * np.uint64(3)) >> np.uint64(11)
            chance = chance.astype(float) / 2**53
            open_row = _pivot(size, part, chance)
            if last:
                part[open_row] = float(chance[open_row] < part[open_row]) if 0 < part[open_row] < 1 else part[open_row]
            table = rows.set_column(rows.schema.get_field_index("part"), "part", pa.array(part))
            return table.combine_chunks().to_batches()[0]

        def groups(rows: pa.Table, closed: bool) -> Iterator[pa.RecordBatch]:
            place, bucket = (rows.column(c).to_numpy() for c in ("place", "bucket"))
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]) | (bucket[1:] != bucket[:-1])) + 1).tolist(), len(place)]
            for i in range(len(edges) - (1 if closed else 2)):
                yield done(rows.slice(edges[i], edges[i + 1] - edges[i]))
            held[:] = [] if closed else [rows.slice(edges[-2])]

        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
                yield from groups(pa.concat_tables(held), False)
        if held:
            yield from groups(pa.concat_tables(held), True)

    return run


def _rounded(items: DataFrame, seed: int) -> DataFrame:
    """``items`` with every ``part`` 0 or 1, through a reduction tree of groups of bounded size."""
    spark = items.sparkSession
    items = stage_table(items, "fractions")
    leaves, depth = 1, 0
    count = items.count()
    while leaves * LEAF < count:
        leaves, depth = leaves * FAN, depth + 1
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = items.withColumn("bucket", F.pmod(F.xxhash64("id", "tie", F.lit(seed)), F.lit(leaves)))
    settled = None
    for level in range(depth, -1, -1):
        rows = rest.repartition(tasks, "place", "bucket").sortWithinPartitions("place", "bucket", "id", "tie", "part")
        rows = stage_table(rows.mapInArrow(_reduce(seed + level, level == 0), rest.schema), "rounded")
        done = rows.where("part = 0 or part = 1")
        settled = done if settled is None else settled.unionByName(done)
        rest = rows.where("part > 0 and part < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
    return settled.drop("bucket")


def mix_copies(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    seed: int = 9,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
) -> DataFrame:
    """``key, tie, size, source_size, target, copies`` of every document.

    The size is the number of words of the whole text (null: none). A document of a
    source with target t and size s should be taken t / s times: the whole part as it
    is, the fraction by pivotal dependent rounding, which keeps the words a source
    gives within one document's size of its target. Draws depend on keys, a hash of the
    row and the seed alone, so reruns agree whatever the partitions.

    A document without words takes the whole part of its copies. Rows with a null source
    are a source of their own, the last. A null key is a key like any other. Equal rows
    are rounded each for itself. An empty table gives an empty one.
    """
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    sized = docs.select(
        F.col(key).alias("key"), F.xxhash64(*docs.columns).alias("tie"), F.col(source).cast("string").alias("source"), words.alias("size")
    )
    sized = stage_table(sized, "sizes")
    targets = source_targets(sized, weights, share)
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop("source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(copies)).withColumn("part", copies - F.floor(copies))
    rows = rows.withColumn("id", F.coalesce(F.xxhash64("key"), F.lit(0)))
    mixed = (F.col("part") > 0) & (F.col("size") > 0)
    plain = rows.where(~mixed).withColumn("part", F.lit(0.0))
    cols = ["key", "tie", "size", "place", "source_size", "target", "whole", "id", "part"]
    both = plain.select(*cols).unionByName(_rounded(rows.where(mixed).select(*cols), seed).select(*cols))
    return both.select(
        F.col("key").alias(key), "tie", "size", "source_size", "target", (F.col("whole") + F.col("part")).cast("long").alias("copies")
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with each row as often as ``mix_copies`` takes it, in the same columns.

    Rows equal in all columns can't be told apart; together they appear as often as they
    are taken together.
    """
    key = settings.get("key", "doc_id")
    taken = mix_copies(docs, **settings).groupBy(F.col(key).alias("_key"), F.col("tie").alias("_same")).agg(F.sum("copies").alias("_n"))
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.xxhash64(*docs.columns).alias("_tie"))
    held = held.join(taken.where("_n > 0"), (F.col("_tie") == F.col("_same")) & F.col("_row").getField(key).eqNullSafe(F.col("_key")))
    first = F.row_number().over(Window.partitionBy("_tie", "_key").orderBy("_tie"))
    held = held.withColumn("_nth", first).where("_nth = 1")
    return held.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_row.*")
