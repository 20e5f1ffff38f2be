"""Substring dedup: passages that also start in an earlier document, found by a sketch and settled exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sketch import count_sketch
from .words import run_hashes, run_starts, slices, span_hashes, split_words

WINDOW = 13
# Words of the piece that stands for a window in the sketch: of its pieces, the one with the least hash.
PIECE = 5


def _windows(texts: pa.Array, window: int, piece: int):
    """Words, first word of each window, and the hash of the piece that stands for the window.

    Equal windows have equal pieces, so a piece is in as many documents as any window it
    stands for, or more. Neighbouring windows mostly share theirs: there are about a
    fifth as many pieces to count as windows.
    """
    words = split_words(texts)
    hashes = span_hashes(words.data, words.starts, words.ends)
    at = run_starts(words.first, window)
    pieces = run_hashes(hashes, piece)
    least = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    for j in range(window - piece + 1):
        np.minimum(least, pieces[at + j], out=least)
    return words, hashes, at, least


def _pieces(window: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in slices(batches, "text"):
            words, _, at, least = _windows(part.column("text"), window, piece)
            row = np.searchsorted(words.first, at, side="right")
            order = np.lexsort((least, row))
            least, row = least[order], row[order]
            once = np.ones(len(least), bool)
            once[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1])
            yield least[once]

    return run


def _claims(window: int, piece: int, sketch):
    """Task side: windows estimated in several documents.

    Of the documents of a slice that hold a window, those behind the smallest key are
    settled here, in one row for a document. Only the smallest goes on to meet the
    smallest of other slices, so a window in very many documents stays few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for part in slices(batches, "text"):
            words, hashes, at, least = _windows(part.column("text"), window, piece)
            often = counts.reaches(least)
            at = at[often]
            a = run_hashes(hashes, window)[at]
            b = run_hashes(span_hashes(words.data, words.starts, words.ends, seed=1), window, seed=1)[at]
            b = (b >> np.uint64(32)).astype(np.uint32)
            row = np.searchsorted(words.first, at, side="right") - 1
            rank = part.column("rank").to_numpy()[row]
            order = np.lexsort((rank, b, a))
            a, b, row, rank, at = a[order], b[order], row[order], rank[order], at[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            later = rank > rank[head]
            spot = (at - words.first[row]).astype(np.int32)
            # In order of the text, neighbours share key and hash and pack well.
            open_rows = np.flatnonzero(~later)
            open_rows = open_rows[np.argsort(at[open_rows])]
            settled = np.flatnonzero(later)
            settled = settled[np.argsort(row[settled], kind="stable")]
            edges = np.flatnonzero(np.diff(row[settled], prepend=-1))
            owner = row[settled][edges]
            rows = np.concatenate([row[open_rows], owner])
            sizes = np.concatenate([np.ones(len(open_rows), np.int64), np.diff(np.append(edges, len(settled)))])
            spots = np.concatenate([spot[open_rows], spot[settled]])
            tie = part.column("tie").to_numpy()
            # The result of a settled row is known, and it meets no other: its place is spread by document.
            names = np.concatenate([a[open_rows].view(np.int64), part.column("rank").to_numpy()[owner]])
            more = np.concatenate([b[open_rows].view(np.int32), np.zeros(len(owner), np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(spots))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names),
                    pa.array(more),
                    pa.array(part.column("rank").to_numpy()[rows]),
                    pa.array(tie[rows]),
                    lists,
                    pa.array(np.arange(len(rows)) >= len(open_rows)),
                ],
                names=["a", "b", "rank", "tie", "spots", "settled"],
            )

    return run


def _strip(window: int):
    """Task side: the words of each text that no window of ``spots`` covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            counts, removed, kept = [], [], []
            for text, spots in zip(texts, part.column("spots"), strict=True):
                words = (text or "").encode().split()
                counts.append(len(words))
                if not spots.is_valid:
                    removed.append(0)
                    kept.append(b" ".join(words))
                    continue
                at = np.asarray(spots.values)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
                stays = np.cumsum(edge[:-1]) == 0
                removed.append(int((~stays).sum()))
                kept.append(b" ".join([words[i] for i in np.flatnonzero(stays).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["key", "n_words", "n_removed", "kept"],
            )

    return run


def remove_repeated(
    docs: DataFrame, window: int = WINDOW, piece: int = PIECE, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, n_words, n_removed, kept`` of every document; ``key`` is an integer column.

    A window is ``window`` consecutive words of one document. Every word goes that is
    covered by a window whose words also start in a document with a smaller key; windows
    are judged on the input. ``kept`` is the other words, joined by one space.

    A first pass counts, for each piece that stands for windows, the documents it is in,
    in a sketch that may overestimate but never underestimates. A second pass groups the
    windows whose piece is estimated in two documents or more, by 96 bits of their words.

    A null text has no words. A row with a null key is neither smaller nor larger than
    another: it loses nothing and makes nothing go. Rows with the same key do not affect
    each other. Texts shorter than a window stay. An empty table gives an empty one.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.select("key", "text", F.xxhash64("text").alias("tie"))
    ranked = rows.where("key is not null and text is not null").select(F.col("key").cast("long").alias("rank"), "tie", "text")
    size = ranked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sketch = count_sketch(ranked.select("text"), _pieces(window, piece), expected=size // 32)
    counts = spark.sparkContext.broadcast(sketch)
    claims = ranked.mapInArrow(
        _claims(window, piece, counts), "a long, b int, rank long, tie long, spots array<int>, settled boolean"
    )
    first = F.min("rank").over(Window.partitionBy("a", "b", "settled"))
    claims = claims.withColumn("least", first).where("settled or rank > least")
    spots = claims.groupBy("rank", F.col("tie").alias("same")).agg(F.flatten(F.collect_list("spots")).alias("spots"))
    found = rows.join(spots, (rows["key"] == spots["rank"]) & (rows["tie"] == spots["same"]), "left").select("key", "text", "spots")
    schema = T.StructType(
        [
            T.StructField("key", rows.schema["key"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    return found.mapInArrow(_strip(window), schema).withColumnRenamed("key", key)
