"""Periodic runs of words: suffix classes of a text are united by falling common prefix."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import mix, run_hashes, run_starts, slices, span_hashes, split_words

# Places in one sorted list; a class with more has several.
BLOCK = 1024
# Edges that are Python numbers at a time.
EDGES = 65_536

RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])


class Places:
    """A large ordered set of places in short sorted lists, so that adding one moves few others."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, places: list[int]):
        self.blocks = [places[low : low + BLOCK] for low in range(0, len(places), BLOCK)]
        self.tops = [block[-1] for block in self.blocks]
        self.size = len(places)

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, place: int) -> tuple[int | None, int | None]:
        """The neighbours of a place that is added."""
        k = min(bisect_left(self.tops, place), len(self.tops) - 1)
        block = self.blocks[k]
        i = bisect_left(block, place)
        before = block[i - 1] if i else self.blocks[k - 1][-1] if k else None
        after = block[i] if i < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else None
        block.insert(i, place)
        if len(block) > 2 * BLOCK:
            self.blocks[k : k + 1] = [block[:BLOCK], block[BLOCK:]]
            self.tops.insert(k, block[BLOCK - 1])
            k += 1
        self.tops[k] = self.blocks[k][-1]
        self.size += 1
        return before, after


def _add(held: list[int] | Places, place: int) -> tuple[int | None, int | None]:
    if isinstance(held, Places):
        return held.add(place)
    i = bisect_left(held, place)
    near = held[i - 1] if i else None, held[i] if i < len(held) else None
    held.insert(i, place)
    return near


def seeds(common: np.ndarray, left: np.ndarray, right: np.ndarray, total: int) -> np.ndarray:
    """Rows ``place, place, common``: neighbours in a class, when united, no further apart than they agree.

    The edges come by falling ``common`` prefix, as Kruskal takes them. A class is an
    ordered set of places; the smaller joins the larger, and each pair of neighbours
    from both is looked at once.
    """
    parent = list(range(total))
    classes: dict[int, list[int] | Places] = {}
    found: list[tuple[int, int, int]] = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for low in range(0, len(common), EDGES):
        part = slice(low, low + EDGES)
        for size, a, b in zip(common[part].tolist(), left[part].tolist(), right[part].tolist(), strict=True):
            a, b = root(a), root(b)
            large, small = classes.pop(a, None) or [a], classes.pop(b, None) or [b]
            if len(large) < len(small):
                a, b, large, small = b, a, small, large
            parent[b] = a
            if len(large) == 1:  # of two lone places
                first, second = (large[0], small[0]) if large[0] < small[0] else (small[0], large[0])
                if second - first <= size:
                    found.append((first, second, size))
                classes[a] = [first, second]
                continue
            if len(large) > 2 * BLOCK and not isinstance(large, Places):
                large = Places(large)
            joining = list(small)
            for i, place in enumerate(joining):
                before, after = _add(large, place)
                if before is not None and place - before <= size and not (i and before == joining[i - 1]):
                    found.append((before, place, size))
                # The next of the smaller class may lie in between.
                if after is not None and after - place <= size and not (i + 1 < len(joining) and joining[i + 1] < after):
                    found.append((place, after, size))
            classes[a] = large
    return np.array(found, np.int64).reshape(-1, 3)


def _suffixes(hashes: np.ndarray, row: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places of all words, by text and then in order of the words that follow.

    Prefix doubling on the classes that still have two members; words order by hash, and
    the end of a text comes first.
    """
    place = np.lexsort((hashes, row))
    new = np.ones(len(place), bool)
    new[1:] = (hashes[place[1:]] != hashes[place[:-1]]) | (row[place[1:]] != row[place[:-1]])
    rank = np.empty(len(place), np.int64)
    rank[place] = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
    open_slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    step = 1
    while len(open_slots):
        at = place[open_slots]
        group = rank[at]
        after = at + step
        then = np.where(after < end[at], rank[np.minimum(after, len(end) - 1)], -1)
        order = np.lexsort((then, group))
        at, group, then = at[order], group[order], then[order]
        place[open_slots] = at
        opens = np.ones(len(at), bool)
        opens[1:] = (group[1:] != group[:-1]) | (then[1:] != then[:-1])
        rank[at] = open_slots[np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))]
        open_slots = open_slots[~(opens & np.append(opens[1:], True))]
        step *= 2
    return place


def _repeating(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Texts in which some ``size`` words in a row occur twice."""
    at = run_starts(first, size) if len(hashes) >= size else np.zeros(0, np.int64)
    row = np.searchsorted(first, at, side="right") - 1
    key = run_hashes(hashes, size)[at] ^ mix(row.astype(np.uint64))
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    return np.unique(row[order[same]])


def _agreement(hashes: np.ndarray, left: np.ndarray, right: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words two suffixes of one text have in common, by bisection on hashes of their beginnings."""
    powers = np.full(len(hashes) + 1, np.uint64(0x9E3779B97F4A7C15))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers[:-1], out=sums[1:])
    # Both sums are brought to the power of the later suffix, which needs no inverse.
    first, second = np.minimum(left, right), np.maximum(left, right)
    shift = powers[second - first]
    low, high = np.zeros(len(left), np.int64), end[second] - second
    while True:
        open_pairs = np.flatnonzero(low < high)
        if not len(open_pairs):
            return low
        i, j = first[open_pairs], second[open_pairs]
        middle = (low[open_pairs] + high[open_pairs] + 1) // 2
        same = (sums[i + middle] - sums[i]) * shift[open_pairs] == sums[j + middle] - sums[j]
        low[open_pairs] = np.where(same, middle, low[open_pairs])
        high[open_pairs] = np.where(same, high[open_pairs], middle - 1)


def find_runs(hashes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and ``start, length, period`` of every run, by text, start and period.

    Words are given by hashes; text ``r`` has the words ``first[r]`` to ``first[r + 1]``.
    A run of length n and period q starts with two suffixes, q apart, that agree on
    n - q words; as n is ``least`` and 2 * q or more, that is half of ``least`` or more,
    so classes with less in common need not be united. When the two are united, no
    suffix between them is in their class, else the run had a smaller period. They are
    at the start of the run if the words before them differ.
    """
    known = max(1, (least + 1) // 2)
    texts = _repeating(hashes, first, known)
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    sizes = np.diff(first)[texts]
    opens = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), sizes)
    hashes = hashes[np.arange(len(row)) - opens[row] + first[:-1][texts][row]]
    end = (opens + sizes)[row]
    place = _suffixes(hashes, row, end)
    together = row[place[1:]] == row[place[:-1]]
    left, right = place[:-1][together], place[1:][together]
    common = _agreement(hashes, left, right, end)
    order = np.argsort(-common, kind="stable")[: int((common >= known).sum())]
    left, right, common = left[order], right[order], common[order]
    # Only places in some class of two, numbered without gaps.
    names, number = np.unique(np.concatenate([left, right]), return_inverse=True)
    found = seeds(common, number[: len(left)], number[len(left) :], len(names))
    start, period, common = names[found[:, 0]], names[found[:, 1]] - names[found[:, 0]], found[:, 2]
    owner = row[start]
    whole = (start == opens[owner]) | (hashes[start - 1] != hashes[start + period - 1])
    # Numbers may be nearer to each other than the places.
    whole &= (period <= common) & (common + period >= least)
    start, period, common, owner = start[whole], period[whole], common[whole], owner[whole]
    order = np.lexsort((period, start))
    runs = np.stack([start - opens[owner], common + period, period], axis=1)
    return texts[owner[order]], runs[order]


def _mark(least: int):
    """Task side: the runs of each text, and the words that no run repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = split_words(part.column("text"))
            owner, runs = find_runs(span_hashes(words.data, words.starts, words.ends), words.first, least)
            edge = np.zeros(len(words.starts) + 1, np.int64)
            begin = words.first[owner] + runs[:, 0]
            np.add.at(edge, begin + runs[:, 2], 1)
            np.add.at(edge, begin + runs[:, 1], -1)
            stays = np.cumsum(edge[:-1]) == 0
            has_run = np.zeros(part.num_rows, bool)
            has_run[owner] = True
            kept = []
            for r, text in enumerate(part.column("text").to_pylist()):
                split = (text or "").encode().split()
                if has_run[r]:
                    own = stays[words.first[r] : words.first[r + 1]]
                    split = [split[i] for i in np.flatnonzero(own).tolist()]
                kept.append(b" ".join(split))
            gone = np.concatenate([[0], np.cumsum(~stays)])[words.first]
            lists = np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)
            fields = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in range(3)], names=RUN.names)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("key"),
                    pa.array(words.counts.astype(np.int64)),
                    pa.array(np.diff(gone).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(lists), fields),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["key", "n_words", "n_dropped", "runs", "kept"],
            )

    return run


def periodic_runs(docs: DataFrame, least: int = 12, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_dropped, runs, kept`` of every document.

    A run is a stretch of at least ``least`` words, and at least twice its smallest
    period q, in which words q apart are identical and which no neighbouring word
    extends. ``runs`` has every run's ``start, length, period`` by start and period, in
    words from 0. A word is dropped if a run contains it after that run's first q words;
    ``kept`` has the others, joined by one space.

    Every text is looked at on its own, in the task that reads it, so there is no
    shuffle; memory grows with the longest text, some 300 bytes a word where it repeats
    throughout. Words are compared by 64-bit hashes.

    A null or empty text has no words and no runs; rows with the same key, and null
    keys, are rows like others. An empty table gives an empty one. Other columns are not
    looked at.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("key", rows.schema["key"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_dropped", T.LongType()),
            T.StructField("runs", T.ArrayType(RUN)),
            T.StructField("kept", T.StringType()),
        ]
    )
    return rows.mapInArrow(_mark(least), schema).withColumnRenamed("key", key)
