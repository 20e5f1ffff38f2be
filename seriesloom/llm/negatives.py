"""Hard negatives: clusters of anchors share a list of candidates, sorted by an angular upper bound."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

# Candidates and anchors that a task holds at a time; anchors of a cluster on average.
SHARD, ANCHORS, CLUSTER = 8192, 4096, 32
# Candidates of a list that are scored at a time: first few, then more.
FIRST_STEP, LAST_STEP = 128, 2048
ROUNDS = 4
# Components are rounded down to a multiple of 1 / SCALE. Scores are whole numbers below this bound, a hundred times which a double still holds.
SCALE = 256
HIGHEST = float(2**53 // 100 - 1)


@dataclass
class Asks:
    """What is searched: for the anchor ``member``, rows of its label or of others, with 100 times their score in ``low`` to ``high``."""

    member: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool

    def of(self, members: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(self.member, members))


@dataclass
class Vectors:
    """Rows with their whole-number vectors, directions and lengths."""

    ids: np.ndarray
    labels: np.ndarray
    whole: np.ndarray
    unit: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Vectors:
        whole = np.floor(SCALE * vectors.astype(np.float64))
        # Scaled by the largest component first, so that squares don't overflow.
        top = np.abs(whole).max(axis=1, keepdims=True, initial=0)
        unit = whole / np.where(top, top, 1)
        length = np.linalg.norm(unit, axis=1, keepdims=True)
        return cls(ids, labels, whole, unit / np.where(length, length, 1), (top * length)[:, 0])


def scores(left: Vectors, at: np.ndarray, right: Vectors, spots: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, of ``HIGHEST`` size at most."""
    a, b = left.whole[at], right.whole[spots]
    if len(a) and len(b) and left.norm[at].max() * right.norm[spots].max() > HIGHEST:
        exact = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
        return np.clip(exact, -int(HIGHEST), int(HIGHEST)).astype(np.float64)
    return a @ b.T


def _angles(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centre, -1.0, 1.0))


def clusters(unit: np.ndarray) -> np.ndarray:
    """A cluster for each direction: a few rounds of k-means on the sphere."""
    many = max(1, round(len(unit) / CLUSTER))
    centres = unit[np.random.default_rng(len(unit)).permutation(len(unit))[:many]]
    for _ in range(ROUNDS):
        owner = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return (unit @ centres.T).argmax(axis=1)


def cut(ask: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` rows of each ask: highest scores, then smallest ids."""
    order = np.lexsort((ids, -score, ask))
    ask, ids, score = ask[order], ids[order], score[order]
    head = np.maximum.accumulate(np.where(np.diff(ask, prepend=-1) != 0, np.arange(len(ask)), 0))
    first = np.arange(len(ask)) - head < k
    return ask[first], ids[first], score[first]


def walk(anchors: Vectors, candidates: Vectors, asks: Asks, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ask, id and score of the first ``k`` rows of every ask, and the number of scores taken.

    For a cluster with centre c and widest angle w, a candidate at angle t from c is at
    t - w or more from each member, so its score is at most the two lengths times
    cos(t - w). Candidates are sorted once by their length times that cosine; each
    member walks the list until its k-th score is above its own length times the bound
    of all that is left, or that bound is below the range asked for.
    """
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    taken = 0
    owner = clusters(anchors.unit) if len(anchors.ids) else np.zeros(0, np.int64)
    for cluster in np.unique(owner):
        members = np.flatnonzero(owner == cluster)
        centre = anchors.unit[members].sum(axis=0)
        centre /= np.linalg.norm(centre) or 1.0
        widest = _angles(anchors.unit[members], centre).max()
        # An arc cosine near 0 is off by 2e-8 or so.
        near = np.maximum(0.0, _angles(candidates.unit, centre) - widest - 1e-7)
        bound = candidates.norm * (np.cos(near) + 1e-12)
        order = np.argsort(-bound, kind="stable")
        bound = np.append(bound[order], -np.inf)
        live = asks.of(members)
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        worst = np.full(len(asks.member), -np.inf)
        at, step = 0, FIRST_STEP
        while len(live) and at < len(order):
            spots = order[at : at + step]
            at, step = at + len(spots), min(2 * step, LAST_STEP)
            who, back = np.unique(asks.member[live], return_inverse=True)
            score = scores(anchors, who, candidates, spots)
            taken += score.size
            fits = candidates.ids[spots][None, :] != anchors.ids[who][:, None]
            fits &= (candidates.labels[spots][None, :] == anchors.labels[who][:, None]) == asks.same
            score, fits = score[back], fits[back]
            fits &= (score >= worst[live][:, None]) & (100 * score >= asks.low[live][:, None]) & (100 * score <= asks.high[live][:, None])
            ask, spot = np.nonzero(fits)
            fresh = (live[ask], candidates.ids[spots][spot], score[ask, spot])
            best = cut(*(np.concatenate(x) for x in zip(best, fresh, strict=True)), k)
            full = np.flatnonzero(np.diff(best[0], prepend=-1, append=-1)[1:] != 0)
            full = full[np.bincount(best[0], minlength=len(worst))[best[0][full]] == k]
            worst[best[0][full]] = best[2][full]
            # Kept within the range of scores, as those are; a score equal to the bound may still win by its id.
            left = anchors.norm[asks.member[live]] * bound[at] if at < len(order) else np.full(len(live), -np.inf)
            left = np.clip(np.nan_to_num(left, nan=0.0), -HIGHEST, HIGHEST)
            live = live[(worst[live] <= left) & (100 * left >= asks.low[live])]
        held = tuple(np.concatenate(x) for x in zip(held, best, strict=True))
    return *held, taken


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks] or [np.zeros(0)]).reshape(len(column), size)


def _vectors(rows: pa.Table, size: int) -> Vectors:
    return Vectors.of(rows["id"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["vector"], size))


def _positives(k: int):
    """Task side: the first rows of each anchor's own label, among one shard's."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if anchors.num_rows and rows.num_rows:
            size = anchors["size"][0].as_py()
            count = anchors.num_rows
            asks = Asks(np.arange(count), np.full(count, -np.inf), np.full(count, np.inf), True)
            ask, found, score, _ = walk(_vectors(anchors, size), _vectors(rows, size), asks, k)
            name = anchors["anchor"].to_numpy()[ask]
        else:
            name, found, score = none, none, none
        return pa.table({"anchor": pa.array(name, pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(score.astype(np.int64))})

    return run


def _negatives(k: int, low: int, high: int):
    """Task side: for each positive of an anchor the first rows of other labels in its range, among one shard's."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        name, place, found, score = none, none, none, none
        if anchors.num_rows and rows.num_rows:
            size = anchors["size"][0].as_py()
            lists = anchors["positive_scores"].combine_chunks()
            many = np.diff(lists.offsets.to_numpy())
            positive = lists.flatten().to_numpy().astype(np.float64)
            member = np.repeat(np.arange(anchors.num_rows), many)
            nth = np.arange(len(member)) - np.repeat(np.cumsum(many) - many, many)
            asks = Asks(member, low * positive, high * positive, False)
            ask, found, score, _ = walk(_vectors(anchors, size), _vectors(rows, size), asks, k)
            name, place = anchors["anchor"].to_numpy()[member[ask]], nth[ask]
        return pa.table(
            {
                "anchor": pa.array(name, pa.int64()),
                "nth": pa.array(place.astype(np.int32)),
                "id": pa.array(found, pa.int64()),
                "score": pa.array(score.astype(np.int64)),
            }
        )

    return run


def _usable(vector: Column) -> Column:
    """Whether a vector has only finite components, which stay finite when scaled."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every row for which ``is_anchor`` holds.

    Components are rounded down to whole 256ths; a score is the inner product of two
    such vectors, in units of 1 / 65,536. An anchor's positives are the first
    ``positives`` other rows of its label, by score and then by smaller key. For each of
    them, the negatives are the first ``negatives`` rows of another label whose score is
    ``low`` to ``high`` hundredths of the positive's; none, if that has a negative score.

    Rows are dealt to shards and anchors to parts, both of bounded size, and each task
    gets one of each: anchors are clustered, and every cluster's members walk one list
    of the shard's rows (``walk``), which is exact. A stated set of anchors meets all
    rows in blocks, so the work grows with anchors times rows where the bounds don't
    end the walks; only the first rows of each shard leave a task.

    Rows with a null key, label or vector, or a null or non-finite component (also after
    scaling by 256) take no part; zero and empty vectors do, with score 0. Vectors of
    different lengths are not compared. Rows with an anchor's key are not its candidates;
    other repeated rows are candidates each, and repeated equal anchors are one. Scores
    beyond 9 * 10**13 count as that. Anchors without positives or negatives give no rows,
    as does an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = rows.where("id is not null and label is not null").where(_usable(F.col("vector"))).withColumn("size", F.size("vector"))
    asked = rows.where("asks").select("id", "label", "vector", "size").dropDuplicates(["id", "label", "vector"])
    asked = stage_table(asked.withColumn("anchor", F.xxhash64("id", "label", "vector")), "anchors")
    shards = max(1, -(-rows.count() // SHARD))
    parts = max(1, -(-asked.count() // ANCHORS))
    # By place as well as by key, so that a key of many rows is in all shards.
    dealt = rows.select("id", "label", "vector", "size", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cell = ["size", "part", "shard"]

    def meet(anchors: DataFrame, task, schema: str) -> DataFrame:
        anchors = anchors.withColumn("part", F.pmod(F.xxhash64("anchor", F.lit(3)), F.lit(parts)).cast("int"))
        anchors = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return anchors.groupBy(cell).cogroup(dealt.groupBy(cell)).applyInArrow(task, schema)

    found = meet(asked, _positives(positives), "anchor long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    found = found.withColumn("nth", place).where(F.col("nth") <= positives)
    lists = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("first"))
    asked = asked.join(lists, "anchor").withColumn("positive_scores", F.col("first.score"))
    asked = stage_table(asked, "positives")
    mined = meet(asked.drop("first"), _negatives(negatives, low, high), "anchor long, nth int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "id"))
    mined = mined.withColumn("rank", rank).where(F.col("rank") <= negatives).withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
    known = asked.select("anchor", F.col("id").alias("anchor_id"), "first")
    positive = F.col("first")[F.col("nth")]
    return mined.join(known, "anchor").select(
        "anchor_id",
        positive["id"].alias("positive_id"),
        "rank",
        "negative_id",
        positive["score"].alias("positive_score"),
        "negative_score",
    )
