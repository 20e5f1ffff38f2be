"""Line dedup: an exact set-similarity join of lines, after which later matches go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_table
from .sketch import Sketch, count_sketch
from .words import mix, run_hashes, run_starts, slices, span_hashes, text_bytes, words_between

# A token of a line is this many words in a row; a shorter line is one token.
SHINGLE = 5
SIMILARITY = 0.8
# Estimated counts from which a token is less rare.
RARITY = (2, 16)
# A longer list of lines with one token is cut into lists of about this length, each of which meets every line of it.
LIST_SIZE = 65_536
# The lines that ask a list are cut into parts of about this length, each of which meets the whole list in a task of its own.
ASK_SIZE = 262_144
ROWS_AT_ONCE = 100_000
# Texts are cut into lines and tokens, or stripped, this many bytes at a time: some twenty times as much is held for them.
TEXT_BYTES = 1 << 18


def _ceil(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def line_tokens(texts: pa.Array, shingle: int):
    """First line of each text; of the lines with a word: line, and its distinct tokens as a range of hashes.

    Lines are what lies between line feeds. Hashes have 64 bits and stand for tokens.
    """
    data, rows = text_bytes(texts)
    breaks = np.flatnonzero(data == 0x0A)
    edges = np.sort(np.concatenate([rows, breaks + 1]))
    # A text's lines: one more than its line feeds. A break at the end of a text starts an empty line in it.
    first = np.append(0, np.cumsum(np.diff(np.searchsorted(breaks, rows)) + 1))
    words = words_between(data, edges)
    hashes = span_hashes(data, words.starts, words.ends)
    counts = words.counts
    at = run_starts(words.first, shingle)
    line = np.searchsorted(words.first, at, side="right") - 1
    token = run_hashes(hashes, shingle)[at]
    lines, tokens = [line], [token]
    for size in range(1, shingle):
        short = np.flatnonzero(counts == size)
        lines.append(short)
        tokens.append(run_hashes(hashes, size)[words.first[:-1][short]] + np.uint64(size))
    line, token = np.concatenate(lines), np.concatenate(tokens)
    order = np.lexsort((token, line))
    line, token = line[order], token[order]
    once = np.ones(len(line), bool)
    once[1:] = (line[1:] != line[:-1]) | (token[1:] != token[:-1])
    return first, line[once], token[once]


def _tokens(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for part in slices(batches, "text", TEXT_BYTES):
            yield line_tokens(part.column("text"), shingle)[2]

    return run


_LINES = "s1 long, s2 long, rank long, tie long, line int, live int, tokens binary"


def _candidates(shingle: int, similarity: float, sketch):
    """Task side: lines of which some token in the prefix may be in another line.

    Tokens are ordered by rarity, ties by their value: the same order in all lines. Two
    lines that are similar enough have a token in common among the first n - ceil(t n) + 1
    of each, and that token is in two lines. So a line whose prefix holds only tokens
    that are in one line has no match, equal lines included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Sketch = sketch.value
        for part in slices(batches, "text", TEXT_BYTES):
            first, line, token = line_tokens(part.column("text"), shingle)
            level = sum(counts.reaches(token, k).astype(np.int8) for k in range(len(RARITY)))
            order = np.lexsort((token, level, line))
            token, level = token[order], level[order]
            heads = np.flatnonzero(np.diff(line, prepend=-1))
            size = np.diff(np.append(heads, len(line)))
            prefix = size - _ceil(similarity * size) + 1
            # Tokens in one line only come first.
            single = np.add.reduceat((level == 0).astype(np.int64), heads) if len(heads) else size
            keep = np.flatnonzero(single < prefix)
            if not len(keep):
                continue
            own = line[heads[keep]]
            row = np.searchsorted(first, own, side="right") - 1
            total = [np.add.reduceat(mix(token + np.uint64(seed)), heads)[keep].view(np.int64) for seed in (1, 2)]
            ends = (heads + size)[keep]
            held = token.astype("<u8").tobytes()
            packed = [held[8 * i : 8 * j] for i, j in zip(heads[keep].tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(total[0]),
                    pa.array(total[1]),
                    part.column("rank").take(pa.array(row)),
                    part.column("tie").take(pa.array(row)),
                    pa.array((own - first[row]).astype(np.int32)),
                    pa.array(single[keep].astype(np.int32)),
                    pa.array(packed, pa.binary()),
                ],
                names=["s1", "s2", "rank", "tie", "line", "live", "tokens"],
            )

    return run


_POSTINGS = "token long, spot int, size int, rank long, line int, s1 long, s2 long, bits1 long, bits2 long"


def _live(batch: pa.RecordBatch, similarity: float):
    """Of a batch of lines: all tokens, first token and size of each, and row and place of its prefix tokens that count."""
    at = np.append(0, np.cumsum(pc.binary_length(batch.column("tokens")).to_numpy() // 8))
    token = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), "<u8")
    size = np.diff(at)
    live = batch.column("live").to_numpy()
    count = size - _ceil(similarity * size) + 1 - live
    row = np.repeat(np.arange(len(size)), count)
    spot = live[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return token, at[:-1], size, row, spot


def _prefixes(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            if batch.num_rows:
                token, at, _, row, spot = _live(batch, similarity)
                yield token[at[row] + spot]

    return run


def _postings(similarity: float, sketch):
    """Task side: a row for each prefix token of a line that may be in the prefix of another.

    ``bits1`` and ``bits2`` hold, for 128 classes of tokens, whether the line has an odd
    number of the class: sets differ in at least as many tokens as these differ in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Sketch = sketch.value
        for batch in batches:
            if not batch.num_rows:
                continue
            token, at, size, row, spot = _live(batch, similarity)
            often = counts.reaches(token[at[row] + spot])
            row, spot = row[often], spot[often]
            classes = mix(token + np.uint64(3)) & np.uint64(127)
            flags = [np.where(classes >> np.uint64(6) == half, np.uint64(1) << (classes & np.uint64(63)), np.uint64(0)) for half in (0, 1)]
            bits = [np.bitwise_xor.reduceat(f, at).view(np.int64) for f in flags]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(token[at[row] + spot].view(np.int64)),
                    pa.array(spot.astype(np.int32)),
                    pa.array(size[row].astype(np.int32)),
                    *(batch.column(c).take(take) for c in ("rank", "line", "s1", "s2")),
                    *(pa.array(b[row]) for b in bits),
                ],
                names=["token", "spot", "size", "rank", "line", "s1", "s2", "bits1", "bits2"],
            )

    return run


def _pairs(similarity: float, every: bool):
    """Task side: earlier lines that pass the length, position and bit filters, of each line that asks.

    Rows come sorted by list and place in the corpus. A line's first such line is taken
    from each list, or with ``every`` all of them.
    """

    def search(rows: pa.Table) -> pa.RecordBatch:
        col = {c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in rows.column_names}
        new = np.ones(rows.num_rows, bool)
        new[1:] = np.any([col[c][1:] != col[c][:-1] for c in ("token", "list", "part")], axis=0)
        place = np.arange(rows.num_rows)
        head = np.maximum.accumulate(np.where(new, place, 0))
        # Members of a list are compared with; others only ask.
        member = np.flatnonzero(col["member"])
        at = np.searchsorted(member, head)
        asks = np.flatnonzero(col["asks"])
        found_a, found_b = [], []
        step = 0
        while len(asks):
            nth = at[asks] + step
            asks, nth = asks[nth < len(member)], nth[nth < len(member)]
            a = member[nth]
            inside = a < asks
            asks, a = asks[inside], a[inside]
            size_a, size_b = col["size"][a].astype(np.int64), col["size"][asks].astype(np.int64)
            need = _ceil(similarity / (1 + similarity) * (size_a + size_b))
            most = 1 + np.minimum(size_a - col["spot"][a] - 1, size_b - col["spot"][asks] - 1)
            far = sum(np.bitwise_count(col[c][a].view(np.uint64) ^ col[c][asks].view(np.uint64)).astype(np.int64) for c in ("bits1", "bits2"))
            good = (most >= need) & (np.minimum(size_a, size_b) >= similarity * np.maximum(size_a, size_b) - 1e-9)
            good &= far <= size_a + size_b - 2 * need
            good &= (col["rank"][a] < col["rank"][asks]) | ((col["rank"][a] == col["rank"][asks]) & (col["line"][a] < col["line"][asks]))
            found_a.append(a[good])
            found_b.append(asks[good])
            asks = asks if every else asks[~good]
            step += 1
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (found_a, found_b))
        names = [pa.array(col[c][x]) for x in (b, a) for c in ("s1", "s2")]
        return pa.RecordBatch.from_arrays(names, names=["b1", "b2", "a1", "a2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS_AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            same = np.ones(rows.num_rows, bool)
            for c in ("token", "list", "part"):
                values = rows.column(c).to_numpy()
                same &= values == values[-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield search(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield search(rows)

    return run


def _dealt(posted: DataFrame) -> DataFrame:
    """Postings by token, list and part of those that ask: the members of the list, and the lines of the part.

    A line goes to its own list, in all parts, and if it ``asks`` to every list, in its
    own part. So a task gets a list and a part at most, however many lines have the token.
    """
    own = F.pmod(F.xxhash64("s1"), F.col("lists")).cast("int")
    rows = posted.withColumn("own", own).withColumn("ask", F.pmod(F.xxhash64("s2"), F.col("parts")).cast("int"))
    rows = rows.withColumn("list", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("lists") - 1)).otherwise(F.array("own"))))
    rows = rows.withColumn("member", F.col("list") == F.col("own"))
    rows = rows.withColumn("part", F.explode(F.when(F.col("member"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("ask"))))
    return rows.withColumn("asks", F.col("asks") & (F.col("part") == F.col("ask"))).drop("lists", "parts", "own", "ask")


def _verified(similarity: float):
    """Task side: the pairs whose token sets have the Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("b1", "b2")], names=["s1", "s2"])

    return run


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        yield np.concatenate([batch.column(c).to_numpy() for c in ("b1", "a1")]).view(np.uint64)


def _named(sketch):
    """Task side: the lines that may be named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: Sketch = sketch.value
        for batch in batches:
            keep = names.reaches(batch.column("s1").to_numpy().view(np.uint64))
            yield batch.filter(pa.array(keep))

    return run


def _matches(reps: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``s1, s2`` of the lines with a verified earlier match among ``pairs``.

    Few lines are in a pair; a sketch of their names keeps the tokens of most others
    out of the joins.
    """
    named = count_sketch(pairs.select("b1", "a1"), _names, expected=2 * pairs.count(), levels=(1,))
    named = _named(reps.sparkSession.sparkContext.broadcast(named))
    held = reps.select("s1", "s2", "tokens").mapInArrow(named, "s1 long, s2 long, tokens binary")
    pairs = pairs.distinct()
    for side in ("b", "a"):
        tokens = held.select(F.col("s1").alias(f"{side}1"), F.col("s2").alias(f"{side}2"), F.col("tokens").alias(f"tokens_{side}"))
        pairs = pairs.join(tokens, [f"{side}1", f"{side}2"])
    return pairs.mapInArrow(_verified(similarity), "s1 long, s2 long").distinct()


def repeated_lines(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``rank, tie, lines``: the numbers of the lines to remove from each text of ``docs(rank, tie, text)``."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    sketch = count_sketch(docs.select("text"), _tokens(shingle), expected=size // 6, levels=RARITY)
    counts = spark.sparkContext.broadcast(sketch)
    lines = stage_table(docs.mapInArrow(_candidates(shingle, similarity, counts), _LINES), "lines")
    # Equal sets of tokens become one line, the first; partial sums keep one row for each set and task.
    reps = lines.groupBy("s1", "s2").agg(
        F.min(F.struct("rank", "line")).alias("head"), F.first("live").alias("live"), F.first("tokens").alias("tokens")
    )
    reps = stage_table(reps.select("s1", "s2", "head.rank", "head.line", "live", "tokens"), "line-sets")
    # Without the equal lines many of these tokens are in one line only; a second, smaller sketch leaves them out.
    few = count_sketch(reps.select("live", "tokens"), _prefixes(similarity), expected=10 * reps.count())
    posted = reps.mapInArrow(_postings(similarity, spark.sparkContext.broadcast(few)), _POSTINGS)
    lists = posted.groupBy("token").count()
    cut = [F.ceil(F.col("count") / size).cast("int").alias(name) for name, size in (("lists", LIST_SIZE), ("parts", ASK_SIZE))]
    lists = lists.where("count > 1").select("token", *cut)
    posted = stage_table(posted.join(lists, "token"), "postings")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(rows: DataFrame, every: bool) -> DataFrame:
        dealt = _dealt(rows).repartition(tasks, "token", "list", "part")
        dealt = dealt.sortWithinPartitions("token", "list", "part", "rank", "line", "s1", "s2")
        return stage_table(dealt.mapInArrow(_pairs(similarity, every), "b1 long, b2 long, a1 long, a2 long"), "line-pairs")

    pairs = searched(posted.withColumn("asks", F.lit(True)), False)
    matched = stage_table(_matches(reps, pairs, similarity), "line-matches")
    # Lines whose first plausible line is no match ask for all of theirs.
    open_lines = pairs.select(F.col("b1").alias("s1"), F.col("b2").alias("s2")).distinct().join(matched, ["s1", "s2"], "left_anti")
    open_lines = stage_table(open_lines, "open-lines")
    if open_lines.limit(1).count():
        asking = posted.join(open_lines.withColumn("asks", F.lit(True)), ["s1", "s2"], "left")
        pairs = searched(asking.withColumn("asks", F.coalesce("asks", F.lit(False))), True)
        matched = matched.unionByName(_matches(reps, pairs, similarity))
    heads = reps.select("s1", "s2", F.struct("rank", "line").alias("head"))
    heads = heads.join(matched.withColumn("matched", F.lit(True)), ["s1", "s2"], "left")
    gone = lines.select("s1", "s2", "rank", "tie", "line").join(heads, ["s1", "s2"])
    gone = gone.where(F.col("matched") | (F.struct("rank", "line") > F.col("head")))
    return gone.groupBy("rank", "tie").agg(F.collect_set("line").alias("lines"))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task side: texts without the lines of ``lines``."""
    for part in slices(batches, "text", TEXT_BYTES):
        filled, removed, kept = [], [], []
        for text, gone in zip(part.column("text").to_pylist(), part.column("lines").to_pylist(), strict=True):
            own = [] if text is None else text.split("\n")
            filled.append(sum(1 for x in own if x.encode().strip()))
            removed.append(len(gone or ()))
            if gone:
                drop = set(gone)
                text = "\n".join([x for i, x in enumerate(own) if i not in drop])
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), pa.array(filled, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            names=["row", "n_lines", "n_removed", "kept"],
        )


def _stripped(docs: DataFrame, row: list[str], shingle: int, similarity: float, text: str, key: str) -> DataFrame:
    rows = docs.select(
        F.struct(*[F.col(c) for c in row]).alias("row"), F.col(text).cast("string").alias("text"), F.col(key).cast("long").alias("rank")
    ).withColumn("tie", F.xxhash64("text"))
    named = rows.where("rank is not null and text is not null").select("rank", "tie", "text")
    gone = repeated_lines(named, shingle, similarity)
    gone = gone.select(F.col("rank").alias("r"), F.col("tie").alias("t"), "lines")
    found = rows.join(gone, (rows["rank"] == gone["r"]) & (rows["tie"] == gone["t"]), "left").select("row", "text", "lines")
    schema = T.StructType(
        [
            T.StructField("row", rows.schema["row"].dataType),
            T.StructField("n_lines", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept", T.StringType()),
        ]
    )
    return found.mapInArrow(_strip, schema)


def dedup_lines(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key, n_lines, n_removed, kept`` of every document; ``key`` is an integer column.

    Lines lie between line feeds; n_lines counts those with a word, and only those are
    compared. A line's tokens are its distinct ``shingle``-word sequences (the whole line
    if it is shorter). It goes if an earlier line, by key and then by place in the text,
    has a Jaccard similarity of ``similarity`` or more to it; lines are judged on the
    input, so a line that goes itself still counts as earlier. ``kept`` is the rest.

    A null text has no lines and stays null. Rows with a null key lose nothing and make
    nothing go. Of rows with the same key, lines at the same place don't affect each
    other, so equal rows stay equal. An empty table gives an empty one.
    """
    found = _stripped(docs, [key], shingle, similarity, text, key)
    return found.select(F.col("row").getField(key).alias(key), "n_lines", "n_removed", "kept")


def without_repeated_lines(
    docs: DataFrame,
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    text: str = "text",
    key: str = "doc_id",
    size: str | None = "n_chars",
) -> DataFrame:
    """``docs`` with the texts ``dedup_lines`` keeps; ``size`` (if there is such a column) is a changed text's new length."""
    others = [c for c in docs.columns if c != text]
    found = _stripped(docs, others, shingle, similarity, text, key)
    fresh = F.when(F.col("n_removed") > 0, F.length("kept"))
    columns = {c: F.col("row").getField(c) for c in others} | {text: F.col("kept")}
    if size in others:
        columns[size] = F.coalesce(fresh.cast(docs.schema[size].dataType), columns[size])
    return found.select(*[columns[c].alias(c) for c in docs.columns])
