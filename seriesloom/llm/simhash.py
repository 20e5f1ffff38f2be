"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and groups of linked documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_table
from .components import connected_components, smallest_labels
from .words import slices, text_bytes, words_between
from .xxhash64 import xxh64_spans

BITS = 64
# A shard has about this many fingerprints if bits are spread evenly; decides how many bits name a shard.
SHARD_SIZE = 64
# A larger shard is cut into several trees of about this size, each of which meets every fingerprint of the shard.
TREE_SIZE = 4096
# The fingerprints that ask a tree are cut into parts of about this size, each of which builds the tree again in a task of its own.
ASK_SIZE = 65_536
# Rows a task searches at a time, and pairs (fingerprint, tree node) it holds at a time.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 200_000, 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


SHINGLES_AT_ONCE = 32_768


def fingerprints_of(texts: pa.Array, shingle: int) -> np.ndarray:
    """64-bit SimHash of each text; zero for a text without words."""
    data, rows = text_bytes(texts)
    data = _LOWER[data]
    words = words_between(data, rows)
    # Words joined by one space: each word's bytes and the one byte behind it, which becomes a space.
    size = words.ends - words.starts
    begin = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
    spread = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    joined[spread] = data[np.repeat(words.starts - begin, size) + spread]
    counts, first = words.counts, words.first
    made = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    start_row = np.cumsum(made) - made
    nth = np.arange(int(made.sum())) - np.repeat(start_row, made)
    opening = np.repeat(first[:-1], made) + nth
    closing = np.minimum(opening + shingle, np.repeat(first[1:], made)) - 1
    hashes = xxh64_spans(joined, begin[opening], begin[closing] + size[closing])
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(made)
    if len(full):
        ones = np.zeros((len(counts), 64), np.int64)
        owner = np.repeat(np.arange(len(counts)), made)
        # In blocks: a shingle's bits take 64 bytes, and their sums eight times that.
        for low in range(0, len(hashes), SHINGLES_AT_ONCE):
            part, rows = hashes[low : low + SHINGLES_AT_ONCE], owner[low : low + SHINGLES_AT_ONCE]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.diff(rows, prepend=-1))
            ones[rows[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        over = (2 * ones[full] > made[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp``: the fingerprint of every whole text as a signed long. A null text counts as empty."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fp = fingerprints_of(part.column("text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(fp)], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(score, schema).withColumnRenamed("key", key)


class Forest:
    """BK-trees over the member fingerprints of many groups, built and searched level by level.

    The first fingerprint of a group is the root; each other one goes to the child
    whose key is its Hamming distance to the node, and becomes that child if there
    is none. ``compared`` holds every (item, node) met on the way within the radius.
    """

    def __init__(self, fp: np.ndarray, group: np.ndarray, radius: int):
        self.fp, self.radius = fp, radius
        groups, first = np.unique(group, return_index=True)
        self.root = dict(zip(groups.tolist(), first.tolist(), strict=True))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        near_a, near_b, keys, kids = [], [], [], []
        rest = np.delete(np.arange(len(fp)), first)
        node = first[np.searchsorted(groups, group[rest])]
        while len(rest):
            far = np.bitwise_count(fp[rest] ^ fp[node]).astype(np.int64)
            near = far <= radius
            near_a.append(rest[near])
            near_b.append(node[near])
            edge, at, back = np.unique(node * (BITS + 1) + far, return_index=True, return_inverse=True)
            child = rest[at]
            keys.append(edge)
            kids.append(child)
            self.levels.append((child, edge // (BITS + 1)))
            stays = child[back] != rest
            node, rest = child[back][stays], rest[stays]
        empty = np.zeros(0, np.int64)
        self.compared = (np.concatenate([empty, *near_a]), np.concatenate([empty, *near_b]))
        keys, kids = np.concatenate([empty, *keys]), np.concatenate([empty, *kids])
        order = np.argsort(keys)
        self.keys, self.kids = keys[order], kids[order]

    def mixed(self, label: np.ndarray) -> np.ndarray:
        """Nodes below which some fingerprint has another label than the node."""
        mixed = np.zeros(len(self.fp), bool)
        for child, parent in reversed(self.levels):
            mixed[parent[mixed[child] | (label[child] != label[parent])]] = True
        return mixed

    def search(self, fp: np.ndarray, root: np.ndarray, label: np.ndarray, skip: np.ndarray):
        """Pairs (query, node) within the radius whose labels differ.

        ``label`` has an entry for each node and each query behind them. Only children
        whose key is within the radius of the distance to their parent are followed,
        and none below which everything (``skip``) has the query's label already.
        """
        todo = [(np.arange(len(fp)), root)]
        size = len(self.fp)
        while todo:
            query, node = todo.pop()
            if len(query) > PAIRS_AT_ONCE:
                half = len(query) // 2
                todo += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            far = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            hit = (far <= self.radius) & (label[size + query] != label[node])
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.keys, node * (BITS + 1) + np.maximum(far - self.radius, 0))
            high = np.searchsorted(self.keys, node * (BITS + 1) + np.minimum(far + self.radius, BITS), side="right")
            many = high - low
            query = np.repeat(query, many)
            node = self.kids[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
            follow = ~skip[node] | (label[size + query] != label[node])
            if follow.any():
                todo.append((query[follow], node[follow]))


def _linked(fp: np.ndarray, group: np.ndarray, member: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of each group as all pairs within the radius would."""
    inside = np.flatnonzero(member)
    forest = Forest(fp[inside], group[inside], radius)
    label = smallest_labels(len(inside), *forest.compared)
    mixed = forest.mixed(label)
    # A member is a query with its own label; the others have none yet.
    place = np.full(len(fp), -1)
    place[inside] = np.arange(len(inside))
    known = np.where(member, label[place], len(inside) + np.arange(len(fp)))
    root = np.array([forest.root.get(g, -1) for g in group.tolist()])
    asks = np.flatnonzero(root >= 0)
    asks_label = np.concatenate([label, known[asks]])
    a, b = [inside], [inside[label]]
    for query, node in forest.search(fp[asks], root[asks], asks_label, ~mixed):
        pair = np.unique(np.stack([known[asks[query]], label[node]]), axis=1)
        # A label stands for its fingerprint: a member's by place, another query's by its row.
        left = np.where(pair[0] < len(inside), inside[np.minimum(pair[0], len(inside) - 1)], pair[0] - len(inside))
        a.append(left)
        b.append(inside[pair[1]])
    label = smallest_labels(len(fp), np.concatenate(a), np.concatenate(b))
    return np.arange(len(fp)), label


def _search_shards(radius: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            cols = [rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("place", "key", "tree", "part", "fp")]
            # Rows come sorted by shard, tree and part, so groups are runs.
            new = np.zeros(len(cols[0]), bool)
            for c in cols[:4]:
                new[1:] |= c[1:] != c[:-1]
            fp = cols[4].view(np.uint64)
            member = rows.column("member").combine_chunks().to_numpy(zero_copy_only=False)
            node, label = _linked(fp, np.cumsum(new), member, radius)
            apart = fp[node] != fp[label]
            return pa.RecordBatch.from_arrays([pa.array(cols[4][node][apart]), pa.array(cols[4][label][apart])], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS_AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            last = [rows.column(c)[-1] for c in ("place", "key", "tree", "part")]
            same = np.ones(rows.num_rows, bool)
            for c, v in zip(("place", "key", "tree", "part"), last, strict=True):
                same &= rows.column(c).to_numpy() == v.as_py()
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield done(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            if rows.num_rows:
                yield done(rows)

    return search


def shard_masks(count: int, radius: int) -> list[int]:
    """Bit masks of which two fingerprints within ``radius`` agree on one at least.

    The bits are cut into blocks; ``radius`` differing bits touch that many blocks at
    most, so some choice of the other blocks agrees. More blocks make shards smaller
    and choices more numerous; the fewest that give shards of about SHARD_SIZE are taken.
    """
    blocks = radius + 1
    while blocks < 2 * radius + 2 and count > SHARD_SIZE * 2 ** (BITS * (blocks - radius) // blocks):
        blocks += 1
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def fingerprint_links(known: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` that join distinct fingerprints ``fp`` as all pairs within ``radius`` bits would.

    A fingerprint goes to one shard for each mask. A shard is searched where it lies,
    through its own BK-tree. A shard of more than TREE_SIZE rows has several trees:
    each row is in one of them and asks all, in any number of tasks. A task gets a tree
    and a part of those that ask, however large the shard is.
    """
    spark = known.sparkSession
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in shard_masks(known.count(), radius)]
    keyed = known.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("place", "key")
    )
    large = keyed.groupBy("place", "key").count().where(F.col("count") > TREE_SIZE)
    cut = [F.ceil(F.col("count") / size).cast("int").alias(name) for name, size in (("trees", TREE_SIZE), ("parts", ASK_SIZE))]
    rows = keyed.join(large.select("place", "key", *cut), ["place", "key"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(1)) for c in ("trees", "parts")})
    rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    rows = rows.withColumn("member", F.pmod(F.xxhash64("fp"), F.col("trees")) == F.col("tree"))
    own = F.array(F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("member"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("place", "key", "tree", "part", "member", "fp").repartition(tasks, "place", "key", "tree", "part")
    rows = rows.sortWithinPartitions("place", "key", "tree", "part", "fp")
    return rows.mapInArrow(_search_shards(radius), "a long, b long")


def fingerprint_groups(prints: DataFrame, max_bits: int) -> DataFrame:
    """``fp, group_fp`` for the distinct fingerprints of ``prints``: equal group_fp where linked directly or through others."""
    known = stage_table(prints.select("fp").distinct(), "distinct-fingerprints")
    groups = connected_components(fingerprint_links(known, max_bits))
    found = known.join(groups, known["fp"] == groups["node"], "left")
    return stage_table(found.select("fp", F.coalesce("component", "fp").alias("group_fp")), "fingerprint-groups")


def near_duplicates(
    docs: DataFrame, shingle: int = 4, max_bits: int = 4, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, fingerprint, component_id`` for every document.

    Texts are lower-cased (A-Z), cut into words and ``shingle``-word sequences; a bit of
    the fingerprint is the majority of the shingles' XXH64 bits. Documents whose
    fingerprints differ in at most ``max_bits`` bits are linked; a component is named by
    its smallest key.

    A null or wordless text has fingerprint zero and is linked like any other. Rows with
    a null key are in their component but never name it; a component of such rows only
    has a null name. Repeated rows and keys stay, each with its own result. An empty
    table gives an empty table. Other columns are not looked at.
    """
    prints = stage_table(fingerprints(docs, shingle, text, key), "fingerprints")
    groups = fingerprint_groups(prints, max_bits)
    least = prints.groupBy("fp").agg(F.min(key).alias("least")).join(groups, "fp")
    names = least.groupBy("group_fp").agg(F.min("least").alias("component_id"))
    table = stage_table(groups.join(names, "group_fp").select("fp", "component_id"), "fingerprint-names")
    return prints.join(table, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component of ``near_duplicates``, that with the smallest key.

    Among rows of that key a hash of the whole row decides, and of equal rows one stays.
    A null key comes after all others. Columns and their order are those of ``docs``.
    """
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(*docs.columns).alias("tie"))
    marked = docs.select(row.alias("row"), F.col(text).alias("text"))
    prints = stage_table(fingerprints(marked, shingle, "text", "row"), "fingerprints")
    # At most one row of a fingerprint and task is shuffled, however many copies there are.
    least = prints.groupBy("fp").agg(F.min("row").alias("row"))
    least = least.join(fingerprint_groups(prints, max_bits), "fp").groupBy("group_fp").agg(F.min("row").alias("row"))
    chosen = least.select(F.col("row.tie").alias("_same"), F.col("row.key").alias("_key"))
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.xxhash64(*docs.columns).alias("_tie"))
    held = held.join(chosen, (F.col("_tie") == F.col("_same")) & F.col("_row").getField(key).eqNullSafe(F.col("_key")))
    first = F.row_number().over(Window.partitionBy("_tie", "_key").orderBy("_tie"))
    return held.select("_row", first.alias("_nth")).where("_nth = 1").select("_row.*")
