"""A count-min sketch of 64-bit hashes: counted in partitions, merged by slices, of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix

SLICE_BITS = 17
# The largest sketch: two rows of 2^27 one-bit counters are 32 MB, however large the corpus is.
LEAST_BITS, MOST_BITS = 17, 27
HASHES_AT_ONCE = 1 << 20


def sketch_bits(expected: int) -> int:
    """Bits of an index, for about four counters to a hash, within the bounds."""
    return int(min(MOST_BITS, max(LEAST_BITS, (4 * max(1, expected) - 1).bit_length())))


def _index(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (row + 1) % 2**64)) >> np.uint64(64 - bits)


def _pack(index: np.ndarray) -> bytes:
    """Sorted numbers as steps of one byte; 255 means 255 more and no number yet."""
    steps = np.diff(index, prepend=0)
    wide = steps // 255
    out = np.full(len(steps) + int(wide.sum()), 255, np.uint8)
    out[np.cumsum(wide + 1) - 1] = steps % 255
    return out.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    steps = np.frombuffer(packed, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def _spread(hashes: Callable, rows: int, bits: int):
    """Task side: the counters that a task's hashes raise, packed by row and slice."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate(held)
        for row in range(rows):
            index = np.sort(_index(values, row, bits)).astype(np.int64)
            part = index >> SLICE_BITS
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            packs = [_pack(index[i:j] & ((1 << SLICE_BITS) - 1)) for i, j in zip(edges[:-1], edges[1:], strict=True)]
            own = part[edges[:-1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), row, np.int32)), pa.array(own.astype(np.int32)), pa.array(packs, pa.binary())],
                names=["row", "slice", "packed"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for values in hashes(batches):
            held.append(values)
            size += len(values)
            if size >= HASHES_AT_ONCE:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _merge(levels: tuple[int, ...]):
    """Sum the packed counters of each slice, one pack after the other; a bit for each level reached."""

    def close(key, counts: np.ndarray) -> pa.RecordBatch:
        planes = b"".join(np.packbits(counts >= level, bitorder="little").tobytes() for level in levels)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([planes], pa.binary())],
            names=["row", "slice", "planes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, counts = None, None
        for batch in batches:
            for row, part, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (row, part):
                    if key is not None:
                        yield close(key, counts)
                    key, counts = (row, part), np.zeros(1 << SLICE_BITS, np.int64)
                counts += np.bincount(_unpack(packed), minlength=1 << SLICE_BITS)
        if key is not None:
            yield close(key, counts)

    return run


@dataclass
class Sketch:
    """Whether hashes are estimated to be counted often; never underestimates."""

    bits: int
    rows: int
    planes: np.ndarray  # [level, row, byte]

    def reaches(self, hashes: np.ndarray, level: int = 0) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(self.rows):
            at = _index(hashes, row, self.bits)
            bit = self.planes[level, row][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)
            out &= (bit & 1).astype(bool)
        return out


def count_sketch(
    docs: DataFrame, hashes: Callable, expected: int, rows: int = 2, levels: tuple[int, ...] = (2,), bits: int | None = None
) -> Sketch:
    """The merged sketch of ``hashes(batches of docs)``, an iterator of uint64 arrays.

    Tasks send the counters they raise, about a byte for each; slices of the sketch are
    summed apart. Only one bit for each counter and level comes to the driver: at most
    rows x levels x 2^MOST_BITS bits, from which on more hashes share a counter.
    """
    bits = max(SLICE_BITS, sketch_bits(expected) if bits is None else bits)
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = docs.mapInArrow(_spread(hashes, rows, bits), "row int, slice int, packed binary")
    packs = packs.repartition(tasks, "row", "slice").sortWithinPartitions("row", "slice")
    merged = packs.mapInArrow(_merge(levels), "row int, slice int, planes binary").toArrow()
    width = 1 << (SLICE_BITS - 3)
    planes = np.zeros((len(levels), rows, 1 << (bits - 3)), np.uint8)
    for row, part, data in zip(*(merged.column(c).to_pylist() for c in ("row", "slice", "planes")), strict=True):
        planes[:, row, part * width : (part + 1) * width] = np.frombuffer(data, np.uint8).reshape(len(levels), width)
    return Sketch(bits, rows, planes)
