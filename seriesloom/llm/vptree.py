"""Nearest vectors by cosine: a vantage-point tree for each shard, asked by blocks of queries."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

# Vectors of a shard, and of a leaf of its tree; queries that a job asks, and that a task asks at a time.
SHARD, LEAF = 8192, 128
QUERY_BLOCK, QUERIES_AT_ONCE = 32_768, 2048
# Pairs scored at a time, and components of vectors held for them.
PAIRS, COMPONENTS = 262_144, 4_194_304


def slack(size: int) -> float:
    """More than rounding can change a squared distance of unit vectors, or two of their cosines.

    A product of ``size`` terms is off by at most ``size`` units of rounding, whatever
    the order of the sum, and so is each vector's length.
    """
    return 8 * (size + 16) * float(np.finfo(np.float64).eps)


class Node:
    """A vantage point with the median distance of the vectors below it, or a leaf of vectors."""

    __slots__ = ("low", "high", "point", "radius", "inside", "outside")

    def __init__(self, low: int, high: int):
        self.low, self.high, self.inside = low, high, None


class VpTree:
    """Distinct vectors of a shard, ordered so that each subtree is a range.

    Distances are those of unit vectors, which order as the cosine does and keep the
    triangle inequality. Equal vectors are one, with their smallest ids: each ``k`` times
    at most, and ``2 * k`` in all, so that k are left for any query without its own id.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        run = new.copy()
        run[1:] |= ids[1:] != ids[:-1]
        nth = np.arange(len(ids)) - np.maximum.accumulate(np.where(run, np.arange(len(ids)), 0))
        kept = np.flatnonzero(nth < k)
        owner = (np.cumsum(new) - 1)[kept]
        kept = kept[np.arange(len(kept)) - np.searchsorted(owner, owner) < 2 * k]
        owner = (np.cumsum(new) - 1)[kept]
        self.ids, self.starts = ids[kept], np.searchsorted(owner, np.arange(len(heads) + 1))
        self.first = ids[heads]
        self.alone = ids[np.append(heads[1:], len(ids)) - 1] == self.first
        self.vectors = vectors[heads]
        self.unit = _unit(self.vectors)
        self.order = np.arange(len(heads))
        self.root = self._build(0, len(heads), np.random.default_rng(len(heads)))

    def _build(self, low: int, high: int, rng) -> Node:
        node = Node(low, high)
        if high - low <= LEAF:
            return node
        pick = int(rng.integers(low, high))
        self.order[[low, pick]] = self.order[[pick, low]]
        rest = self.order[low + 1 : high]
        far = np.linalg.norm(self.unit[rest] - self.unit[self.order[low]], axis=1)
        half = len(rest) // 2
        by = np.argpartition(far, half)
        self.order[low + 1 : high] = rest[by]
        node.point, node.radius = self.order[low], float(far[by[half]])
        middle = low + 1 + half
        node.inside, node.outside = self._build(low + 1, middle, rng), self._build(middle, high, rng)
        return node

    def _own(self, own: np.ndarray | None, spots: np.ndarray) -> np.ndarray | bool:
        """Whether a vector has no id but the query's own."""
        return False if own is None else self.alone[spots] & (self.first[spots] == own[:, None])

    def search(self, unit: np.ndarray, keep: int, factor: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the ``keep`` nearest vectors of each query found, those of its ``own`` id only left out.

        Of vectors equally far, any are kept.
        """
        best = np.full((len(unit), keep), np.inf)
        place = np.full((len(unit), keep), -1)
        margin = 3 * np.sqrt(slack(unit.shape[1]))

        def meet(asks: np.ndarray, spots: np.ndarray) -> np.ndarray:
            far = np.sqrt(np.maximum(0.0, 2 - 2 * (unit[asks] @ self.unit[spots].T)))
            mine = self._own(None if own is None else own[asks], spots)
            every = np.concatenate([best[asks], np.where(mine, np.inf, far)], axis=1)
            names = np.concatenate([place[asks], np.where(mine, -1, np.broadcast_to(spots, far.shape))], axis=1)
            cut = np.argpartition(every, keep - 1, axis=1)[:, :keep]
            best[asks] = np.take_along_axis(every, cut, axis=1)
            place[asks] = np.take_along_axis(names, cut, axis=1)
            return far

        def near(asks: np.ndarray, gap: np.ndarray) -> np.ndarray:
            # A vector beyond the border is at least |gap| away: with factor 1 none of the nearest is missed.
            worst = best[asks].max(axis=1)
            return asks[gap * factor <= worst + margin]

        def visit(node: Node, asks: np.ndarray) -> None:
            if not len(asks):
                return
            if node.inside is None:
                meet(asks, self.order[node.low : node.high])
                return
            gap = meet(asks, np.array([node.point]))[:, 0] - node.radius
            inner, outer = gap <= 0, gap > 0
            visit(node.inside, asks[inner])
            visit(node.outside, asks[outer])
            visit(node.outside, near(asks[inner], -gap[inner]))
            visit(node.inside, near(asks[outer], gap[outer]))

        visit(self.root, np.arange(len(unit)))
        return place, best

    def within(self, unit: np.ndarray, reach: np.ndarray, factor: float, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries and places of all vectors no further than ``reach`` and what rounding may hide, a leaf at a time."""
        wide = slack(unit.shape[1])
        limit = reach * reach + 3 * wide
        edge = np.sqrt(limit) + 3 * np.sqrt(wide)
        nodes = [(self.root, np.arange(len(unit)))]
        while nodes:
            node, asks = nodes.pop()
            if not len(asks):
                continue
            leaf = node.inside is None
            spots = self.order[node.low : node.high] if leaf else np.array([node.point])
            square = np.maximum(0.0, 2 - 2 * (unit[asks] @ self.unit[spots].T))
            query, at = np.nonzero((square <= limit[asks][:, None]) & ~self._own(own[asks], spots))
            if len(query):
                yield asks[query], spots[at]
            if not leaf:
                gap = np.sqrt(square[:, 0]) - node.radius
                nodes.append((node.inside, asks[(gap <= 0) | (gap * factor <= edge[asks])]))
                nodes.append((node.outside, asks[(gap > 0) | (-gap * factor <= edge[asks])]))

    def nearest(self, own: np.ndarray, vectors: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query number, id and score of the ``k`` best rows of each query, by score and then by id.

        The search gives the distance of the k-th vector only; every vector as near is
        scored, since which of them have the smaller ids is not known before.
        """
        unit = _unit(vectors)
        place, far = self.search(unit, k, factor, own)
        query, at = np.nonzero(place >= 0)
        held = [(query, place[query, at])]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for query, at in self.within(unit, far.max(axis=1), factor, own):
            fresh = (place[query] != at[:, None]).all(axis=1)
            held.append((query[fresh], at[fresh]))
            if sum(len(q) for q, _ in held) >= PAIRS:
                best, held = self._scored(best, held, own, vectors, k), []
        return self._scored(best, held, own, vectors, k) if held else best

    def _scored(self, best: tuple, held: list, own: np.ndarray, vectors: np.ndarray, k: int) -> tuple:
        query, at = (np.concatenate(x) for x in zip(*held, strict=True))
        step = max(1, COMPONENTS // vectors.shape[1])
        parts = [slice(low, low + step) for low in range(0, len(query), step)]
        score = np.concatenate([np.zeros(0), *[_cosine(vectors[query[p]], self.vectors[at[p]]) for p in parts]])
        many = self.starts[at + 1] - self.starts[at]
        row = np.repeat(self.starts[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        query, score, found = np.repeat(query, many), np.repeat(score, many), self.ids[row]
        other = found != own[query]
        return _cut(*(np.concatenate([x, y[other]]) for x, y in zip(best, (query, found, score), strict=True)), k)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, and all its components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines in double precision, each pair computed alike wherever it stands."""
    a, b = _in_range(query), _in_range(vectors)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _in_range(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to 0.5 or more and below 1.

    Exact, so the cosine of vectors whose squares are in range is the same to the last
    bit, and no square of others overflows or vanishes.
    """
    wide = vectors.astype(np.float64)
    return np.ldexp(wide, -np.frexp(np.abs(wide).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = _in_range(vectors)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _rows(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.concatenate([np.asarray(c.flatten()) for c in column.chunks] or [np.zeros(0)]).reshape(-1, size)


def _plant(k: int):
    """One shard's vectors become one row: its tree."""

    def run(rows: pa.Table) -> pa.Table:
        size = rows.column("size")[0].as_py()
        tree = VpTree(rows.column("id").to_numpy(), _rows(rows.column("vector"), size), k)
        return pa.table({"size": pa.array([size], pa.int32()), "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())})

    return run


def _ask(block, k: int, factor: float):
    """Task side: the k nearest of every query of the block in this task's trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores, asked = [], [], []
        for batch in batches:
            for size, packed in zip(batch.column("size").to_pylist(), batch.column("tree"), strict=True):
                if size not in block.value:
                    continue
                tree: VpTree = pickle.loads(packed.as_buffer())
                known, vectors = block.value[size]
                for low in range(0, len(known), QUERIES_AT_ONCE):
                    own, rows = known[low : low + QUERIES_AT_ONCE], vectors[low : low + QUERIES_AT_ONCE]
                    query, found, score = tree.nearest(own, rows, k, factor)
                    ids.append(found)
                    scores.append(score)
                    asked.append(own[query])
            if sum(map(len, ids)) > 500_000:
                yield _best(asked, ids, scores, k)
                ids, scores, asked = [], [], []
        if ids:
            yield _best(asked, ids, scores, k)

    return run


def _cut(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` rows of each query, by score and then by id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    head = np.maximum.accumulate(np.where(np.diff(query, prepend=query[:1] - 1) != 0, np.arange(len(query)), 0))
    keep = np.arange(len(query)) - head < k
    return query[keep], vec[keep], score[keep]


def _best(asked: list, ids: list, scores: list, k: int) -> pa.RecordBatch:
    best = _cut(*map(np.concatenate, (asked, ids, scores)), k)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["query_id", "vec_id", "score"])


def _block(asks: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a block's queries, by length of the vectors."""
    table = asks.select("id", "vector", "size").toArrow()
    held = {}
    for size in set(table.column("size").to_pylist()):
        own = table.filter(pc.equal(table.column("size"), size))
        held[size] = (own.column("id").to_numpy(), _rows(own.column("vector"), size))
    return held


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows of every row for which ``is_query`` holds.

    Nearness is the largest cosine in double precision, ties go to the smaller key. Rows
    are dealt to shards by a hash, and each shard's distinct vectors are a vantage-point
    tree. A subtree is left out if the triangle inequality, its bound multiplied by
    ``factor``, shows that it holds nothing nearer: factor 1 finds the nearest exactly, a
    larger one prunes more. Every vector as near as the k-th is scored, however many they
    are. Queries are asked in blocks of bounded size, one after the other, each of which
    all trees get; only a task's k best for a query leave it.

    Rows with a null key, or whose vector is null, zero or holds a null or non-finite
    component, take no part, as query or candidate. Vectors of different lengths are not
    compared. Rows with the same key as the query are not its candidates; other repeated
    rows are candidates each. An empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("size", F.size("vector"))
    count = rows.count()
    shards = max(1, -(-count // SHARD))
    dealt = rows.select("id", "vector", "size", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(shards)).cast("int").alias("shard"))
    trees = stage_table(dealt.groupBy("size", "shard").applyInArrow(_plant(k), "size int, tree binary"), "trees")
    asks = rows.where("asks").select("id", "vector", "size").dropDuplicates(["id", "vector"])
    blocks = max(1, -(-rows.where("asks").count() // QUERY_BLOCK))
    asks = stage_table(asks.withColumn("block", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(blocks)).cast("int")), "queries")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = trees.repartition(min(tasks, shards)) if shards > 1 else trees
    found = None
    for block in range(blocks):
        held = spark.sparkContext.broadcast(_block(asks.where(F.col("block") == block)))
        part = spread.mapInArrow(_ask(held, k, factor), "query_id long, vec_id long, score double")
        # Written before the next block is read: the driver and the executors hold one block at a time.
        part = stage_table(part, "nearest")
        held.destroy()
        found = part if found is None else found.unionByName(part)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
