"""Words of whole texts as positions in one byte buffer, and hashes of them, without a loop over words.

A word is ``[^\\x20\\x09-\\x0D]+``. None of the separating bytes occurs inside a
multi-byte UTF-8 character, so words can be found in the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

# The odd multipliers of two polynomial hashes, and the published mixing constants of splitmix64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, null as empty, and the offsets of its rows."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def slices(batches, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column``, or one longer row.

    What is computed per byte then needs memory for one slice, or one text.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


@dataclass
class Words:
    """Word ``i`` is ``data[starts[i]:ends[i]]``; row ``r`` has the words ``first[r]`` to ``first[r + 1]``."""

    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def split_words(texts: pa.Array) -> Words:
    data, rows = text_bytes(texts)
    return words_between(data, rows)


def words_between(data: np.ndarray, rows: np.ndarray) -> Words:
    """Words of consecutive pieces of ``data``; ``rows`` are the offsets of the pieces."""
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads = rows[:-1][np.diff(rows) > 0]
    tails = rows[1:][np.diff(rows) > 0] - 1
    opens[heads] = inside[heads]
    closes[tails] = inside[tails]
    starts = np.flatnonzero(opens)
    return Words(data, rows, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, rows))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


@cache
def _letters(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, np.uint64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < size:
        known = np.full(max(size, SLICE_BYTES + 1), np.uint64(base))
        known[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(known)
        if len(known) > 4 * SLICE_BYTES:  # of one long text; not kept
            del _POWERS[base]
    return known[:size]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they lie."""
    base = _BASES[seed]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters(seed)[data] * _powers(base, len(data)), out=sums[1:])
    back = _powers(pow(base, -1, 2**64), len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def run_hashes(hashes: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``length`` consecutive hashes; entry ``i`` is of ``hashes[i:i + length]``."""
    total = np.zeros(max(0, len(hashes) - length + 1), np.uint64)
    if not len(total):
        return total
    factor = 1
    for j in range(length):
        factor = factor * _BASES[seed] % 2**64
        total += hashes[j : len(hashes) - length + 1 + j] * np.uint64(factor)
    return mix(total)


def run_starts(first: np.ndarray, length: int) -> np.ndarray:
    """Positions at which ``length`` consecutive words lie in one row."""
    total = int(first[-1])
    ok = np.ones(max(0, total - length + 1), bool)
    for j in range(1, length):
        # The run from i crosses the start of a row if that row starts in i + 1 ... i + length - 1.
        at = first[1:-1] - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return np.flatnonzero(ok)
