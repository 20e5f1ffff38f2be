"""Training-order shards: a keyed permutation gives every sequence a slot; shards hold slots at a fixed stride."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, stage_table
from .bpe import coder
from .words import mix, slices

ROUNDS = 8
# Tokens of a sequence, and sequences of a shard.
LENGTH, PER_SHARD = 1024, 8192
# Bytes for words whose codes a worker remembers: nothing else of this size is held beside them.
KNOWN_BYTES = 128_000_000


def feistel(index: np.ndarray, count: int, seed: int) -> np.ndarray:
    """A keyed permutation of 0 ... count - 1.

    A balanced Feistel network permutes the smallest even number of bits that holds
    ``count``; a value outside walks on along its cycle until it is inside. The domain
    is less than four times ``count``, so a walk has four steps on average at most.
    """
    half = max(1, ((max(count, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for key in keys:
            left, right = right, left ^ (mix(right ^ key) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= count]
    return out.astype(np.int64)


def _pack_sequences(path: str, end: int, length: int):
    """Task side: this task's tokens as packed sequences; the last one is filled up with end marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, pack, part = coder(path, KNOWN_BYTES), _codec(), TaskContext.get().partitionId()
        mark = np.array([end], code.kind).tobytes()
        width = length * code.kind.itemsize
        held, made = b"", 0

        def rows(data: bytes, used: list[int]) -> pa.RecordBatch:
            parts = [pack.compress(data[i * width : (i + 1) * width], asbytes=True) for i in range(len(used))]
            own = np.full(len(used), part, np.int32)
            nth = np.arange(made, made + len(used))
            columns = [pa.array(own), pa.array(nth), pa.array(used, pa.int32()), pa.array(parts, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "nth", "n_tokens", "packed"])

        for batch in slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            held += b"".join([c + mark for c in code.encode(texts)])
            whole = len(held) // width
            if whole:
                yield rows(held, [length] * whole)
                made, held = made + whole, held[whole * width :]
        if held:
            used = len(held) // code.kind.itemsize
            yield rows(held + mark * (length - used), [used])

    return run


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def _place(firsts, count: int, seed: int):
    """Task side: the number of each sequence, and its slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.array([firsts.value[p] for p in batch.column("part").to_pylist()], np.int64)
            number = first + batch.column("nth").to_numpy()
            columns = [pa.array(feistel(number, count, seed)), pa.array(number), batch.column("n_tokens"), batch.column("packed")]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "sequence", "n_tokens", "packed"])

    return run


def _write_shards(folder: str, per_shard: int, stride: int):
    """Task side: shards of this task's slots, each written under another name and then renamed.

    Slots come sorted, and a task has whole shards: a lost task writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard, out, name, at, pack = None, None, None, 0, _codec()

        def close():
            out.close()
            final = f"{root}/shard-{shard:08d}.bin"
            if store.get_file_info(final).type != fs.FileType.NotFound:  # by an earlier attempt of this task
                store.delete_file(final)
            store.move(name, final)

        for batch in batches:
            offsets, shards, digests = [], [], []
            for slot, packed in zip(batch.column("slot").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                data = pack.decompress(packed, decompressed_size=stride, asbytes=True)
                if slot // per_shard != shard:
                    if shard is not None:
                        close()
                    shard, at = slot // per_shard, 0
                    name = f"{root}/.shard-{shard:08d}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                if slot != shard * per_shard + at // stride:
                    raise RuntimeError(f"slot {slot} is not next in shard {shard}")
                out.write(data)
                shards.append(f"shard-{shard:08d}.bin")
                offsets.append(at)
                digests.append(hashlib.sha256(data).hexdigest())
                at += len(data)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("slot", "sequence", "n_tokens")), pa.array(shards, pa.string()), pa.array(offsets, pa.int64()), pa.array(digests, pa.string())],
                names=["slot", "sequence", "n_tokens", "shard", "byte_offset", "sha256"],
            )
        if shard is not None:
            close()

    return run


def read_slots(folder: str, start: int, stop: int, length: int = LENGTH, per_shard: int = PER_SHARD, kind: str = "<u2") -> Iterator[np.ndarray]:
    """The sequences of slots ``start`` to ``stop - 1`` in order; each shard is opened at the first slot wanted of it."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    stride = length * np.dtype(kind).itemsize
    while start < stop:
        shard, at = divmod(start, per_shard)
        count = min(stop, (shard + 1) * per_shard) - start
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as file:
            file.seek(at * stride)
            for _ in range(count):
                yield np.frombuffer(file.read(stride), kind)
        start += count


def write_training_order(
    docs: DataFrame,
    path: str,
    end: int,
    folder: str | None = None,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    seed: int = 4,
    text: str = "text",
) -> DataFrame:
    """Write the token ids of all texts in training order; ``slot, sequence, n_tokens, shard, byte_offset, sha256``.

    Texts are encoded with the tokenizer file ``path``, each followed by the id ``end``,
    and the ids of a partition of ``docs`` are cut into sequences of ``length``; a
    partition's last one is filled up with ``end`` (``n_tokens`` counts the others). The
    permutation keyed by ``seed`` gives each sequence its slot. Shard k, a file of
    ``folder`` (a URI that all executors reach; a fresh one beside the checkpoints if not
    given), holds slots k * per_shard and on as little-endian ids, two bytes each if the
    vocabulary allows: slot s lies at (s mod per_shard) * stride, so a reader can go on
    at any slot. Shards appear whole or not at all.

    ``docs`` is read once; its sequences are written packed, numbered by the partition
    that made them, and dealt by slot. Only the number of sequences of each partition
    comes to the driver: a number for each task. A null or empty text is its end mark
    alone. Repeated rows are texts like any other. An empty table writes no shard and
    gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text).cast("string").alias("text"))
    made = stage_table(rows.mapInArrow(_pack_sequences(path, end, length), "part int, nth long, n_tokens int, packed binary"), "sequences")
    firsts, count = {}, 0
    for part, size in sorted(made.groupBy("part").count().collect()):
        firsts[part], count = count, count + size
    folder = folder or f"{shared_dir(spark).rstrip('/')}/seriesloom/shards-{uuid.uuid4().hex}"
    if "://" not in folder:  # a path, or file:/path
        folder = "file://" + folder.removeprefix("file:")
    placed = made.mapInArrow(
        _place(spark.sparkContext.broadcast(firsts), count, seed), "slot long, sequence long, n_tokens int, packed binary"
    )
    shards = max(1, -(-count // per_shard))
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), shards)
    # Slots are known to be 0 ... count - 1, so ranges of whole shards need no sample.
    task = F.floor(F.floor(F.col("slot") / per_shard) * tasks / shards).cast("int")
    dealt = placed.repartitionById(tasks, task).sortWithinPartitions("slot")
    stride = length * coder(path).kind.itemsize
    manifest = dealt.mapInArrow(
        _write_shards(folder, per_shard, stride), "slot long, sequence long, n_tokens int, shard string, byte_offset long, sha256 string"
    )
    return stage_table(manifest, "shard-manifest")
