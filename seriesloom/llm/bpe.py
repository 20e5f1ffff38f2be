"""Byte-pair encoding and decoding with content-defined chunks that are encoded once."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage_table
from .sketch import count_sketch
from .words import SLICE_BYTES, run_hashes, run_starts, slices, span_hashes, split_words

# A chunk begins at a word whose window of WINDOW words has a hash divisible by CHUNK_WORDS.
WINDOW, CHUNK_WORDS = 4, 48
# Words at each side of a chunk join that are encoded together and apart.
SEAM_WORDS = 2
# Bytes for the words and pieces whose codes a Python worker remembers; an entry has some 200 besides its own.
KNOWN_BYTES, ENTRY_BYTES = 32_000_000, 200
# Whole texts that ``new_chunk_hashes`` remembers in a task.
KNOWN_TEXTS = 10_000

# Letters, and ASCII marks behind them; an apostrophe could begin a piece of its own.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Coder:
    """Encodes whole texts as the tokenizers library does, and tokens as it decodes them.

    Where the tokenizer drops white space between pieces (``by_word``), no token spans a
    separator and nothing before a separator changes what comes after it; a text's codes
    are then its words' codes in a row, and words are remembered. Otherwise the library
    gets the whole text.
    """

    def __init__(self, path: str, room: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.names = [str(i) for i in range(size)]
        self.joins_tokens = parts.get("decoder") is None
        self.by_word = self._drops_space(parts)
        # When half of what may be held is filled, it becomes the older half; what was older and not met since is forgotten.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held, self.room = 0, room
        self.split = self.tokenizer.model.tokenize
        self.letters = _byte_letters()

    @staticmethod
    def _drops_space(parts: dict) -> bool:
        """Whether this is the one known arrangement: spaces folded, lower case, pieces without spaces, bytes."""
        norm = [n.get("type") for n in (parts.get("normalizer") or {}).get("normalizers", [])]
        pre = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if norm != ["NFC", "Replace", "Lowercase"] or [p.get("type") for p in pre] != ["Split", "ByteLevel"]:
            return False
        split, level = pre
        pattern = split.get("pattern", {}).get("Regex", "")
        # Fixed value: the pattern of words, single digits and other marks that leaves white space out.
        known = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        glued = any(
            any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or _PLAIN.fullmatch(t["content"])
            for t in parts.get("added_tokens", [])
        )
        plain = pattern == known and split.get("behavior") == "Removed" and split.get("invert") is True
        return plain and not glued and not level.get("use_regex") and not level.get("add_prefix_space") and parts.get("post_processor") is None

    def _keep(self, word: bytes, codes: bytes) -> bytes:
        self.known[word] = codes
        self.held += len(word) + len(codes) + ENTRY_BYTES
        return codes

    def _piece(self, piece: str) -> bytes:
        """The ids of letters alone, in lower case, or of marks: those of the word they would be."""
        word = piece.encode()
        codes = self.known.get(word)
        if codes is None:
            codes = self.older.get(word)
            if codes is None:
                shown = piece if piece.isascii() else "".join([self.letters[b] for b in word])
                codes = array(self.kind.char, [t.id for t in self.split(shown)]).tobytes()
            self._keep(word, codes)
        return codes

    def _learn(self, words: set[bytes]) -> None:
        """Make the ``words`` known, which are not."""
        hard, piece, older, plain = [], self._piece, self.older.get, _PLAIN.fullmatch
        for word in words:
            codes = older(word)
            if codes is None:
                found = plain(word.decode())
                if found is None:
                    hard.append(word)
                    continue
                # Letters, and the marks behind them, are pieces of their own.
                stem, marks = found.groups()
                codes = piece(stem.lower()) + piece(marks) if stem and marks else piece(stem.lower() or marks)
                if word in self.known:
                    continue
            self._keep(word, codes)
        if hard:
            found = self.tokenizer.encode_batch_fast([w.decode() for w in hard], add_special_tokens=False)
            for word, e in zip(hard, found, strict=True):
                self._keep(word, array(self.kind.char, e.ids).tobytes())

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as bytes of ``kind``."""
        if not self.by_word:
            found = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            return [array(self.kind.char, e.ids).tobytes() for e in found]
        if self.held > self.room // 2:
            self.older, self.known, self.held = self.known, {}, 0
        split = [t.split() for t in texts]
        self._learn(set().union(*split).difference(self.known))
        get = self.known.__getitem__
        return [b"".join(map(get, own)) for own in split]

    def count(self, texts: list[bytes]) -> list[int]:
        return [len(x) // self.kind.itemsize for x in self.encode(texts)]

    def decode(self, ids: list[int]) -> str:
        if self.joins_tokens:
            return " ".join([self.tokens[i] for i in ids])
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def digest(self, codes: bytes) -> tuple[int, str, str]:
        """Number of tokens, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded text."""
        ids = np.frombuffer(codes, self.kind).tolist()
        listed = hashlib.sha256(" ".join([self.names[i] for i in ids]).encode()).hexdigest()
        return len(ids), listed, hashlib.sha256(self.decode(ids).encode()).hexdigest()


@cache
def coder(path: str, room: int = KNOWN_BYTES) -> Coder:
    """One for each Python worker, which keeps it from task to task; ``room`` is that for words and pieces."""
    return Coder(path, room)


def cut(texts: pa.Array):
    """Content-defined chunks of each text: byte spans, and the chunks of each row as a range.

    A chunk reaches from a word that is a boundary, or the start of the text, to the next
    one; white space in front of a boundary belongs to the chunk before it. Where a
    boundary lies depends on the next WINDOW words alone, so equal passages are cut alike.
    """
    words = split_words(texts)
    hashes = span_hashes(words.data, words.starts, words.ends)
    at = run_starts(words.first, WINDOW)
    bounds = at[run_hashes(hashes, WINDOW)[at] % np.uint64(CHUNK_WORDS) == 0] if len(at) else at
    heads = words.rows[:-1][np.diff(words.rows) > 0]
    starts = np.union1d(words.starts[bounds], heads)
    ends = np.append(starts[1:], len(words.data))
    return words, starts, ends, np.searchsorted(starts, words.rows)


def text_names(data: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """128 bits that stand for each whole text."""
    return list(zip(*(span_hashes(data, rows[:-1], rows[1:], seed).tolist() for seed in (0, 1)), strict=True))


def chunk_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for part in slices(batches, "text"):
        words, starts, ends, _ = cut(part.column("text"))
        yield span_hashes(words.data, starts, ends)


def new_chunk_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Chunks of each text but for those of a text the task has just seen; ``encode_documents`` counts them all."""
    seen: set[tuple[int, int]] = set()
    for part in slices(batches, "text"):
        words, starts, ends, first = cut(part.column("text"))
        fresh = np.ones(len(first) - 1, bool)
        for i, name in enumerate(text_names(words.data, words.rows)):
            if len(seen) >= KNOWN_TEXTS:
                seen.clear()
            fresh[i] = name not in seen
            seen.add(name)
        yield span_hashes(words.data, starts, ends)[np.repeat(fresh, np.diff(first))]


def _seams(code: Coder, parts: list[bytes]) -> list[bool]:
    """For each join of neighbouring chunks: whether encoding across it gives what encoding each side gives."""
    tails = [b" ".join(p.split()[-SEAM_WORDS:]) if code.by_word else p for p in parts[:-1]]
    heads = [b" ".join(p.split()[:SEAM_WORDS]) if code.by_word else p for p in parts[1:]]
    glue = b" " if code.by_word else b""
    encode = code.tokenizer.encode_batch_fast if hasattr(code.tokenizer, "encode_batch_fast") else code.tokenizer.encode_batch
    both = encode([(t + glue + h).decode() for t, h in zip(tails, heads, strict=True)], add_special_tokens=False)
    left, right = code.encode(tails), code.encode(heads)
    return [np.array(e.ids, code.kind).tobytes() == a + b for e, a, b in zip(both, left, right, strict=True)]


def repaired(code: Coder, parts: list[bytes], shared: list[bool]) -> list[tuple[bytes, bool]]:
    """Units of a text, with whether each is a shared chunk as it is.

    Chunks whose join does not agree are one unit and encoded anew, wider and wider until
    all joins agree; neighbouring chunks that are not shared are one unit from the start.
    """
    units: list[tuple[bytes, bool]] = []
    for part, common in zip(parts, shared, strict=True):
        if units and not common and not units[-1][1]:
            units[-1] = (units[-1][0] + part, False)
        else:
            units.append((part, common))
    while len(units) > 1:
        agree = _seams(code, [u[0] for u in units])
        if all(agree):
            break
        wider = [units[0]]
        for unit, good in zip(units[1:], agree, strict=True):
            if good:
                wider.append(unit)
            else:
                wider[-1] = (wider[-1][0] + unit[0], False)
        units = wider
    return units


_RESULT = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
]
_PIECES = [
    T.StructField("place", T.LongType()),  # a slice of a task's texts; null: a document with its result
    T.StructField("number", T.IntegerType()),  # of a shared chunk in its place, from 0; null: a document
    T.StructField("a", T.LongType()),  # 128 bits that name a shared chunk
    T.StructField("b", T.LongType()),
    T.StructField("data", T.BinaryType()),  # the text of a shared chunk, once a task; a document's own codes, compressed
    T.StructField("units", T.ArrayType(T.IntegerType())),  # of a document: n > 0: shared chunk n - 1; else -n bytes of its own codes
    *_RESULT,
]
_ARROW = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.string(), pa.string()]


def chunk_name(chunk: bytes) -> tuple[int, int]:
    """128 bits that stand for a chunk; unlike those of ``span_hashes``, no two texts are known to have the same."""
    name = hashlib.blake2b(chunk, digest_size=16).digest()
    return int.from_bytes(name[:8], "big", signed=True), int.from_bytes(name[8:], "big", signed=True)


def _cut_and_encode(path: str, shared):
    """Task side: every text is cut and its joins are checked; what it does not share is encoded here.

    Texts without a shared chunk are then decoded and done. The others say how they are put
    together, and each slice of texts asks once for each shared chunk in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, sketch = coder(path), shared.value
        first_place = TaskContext.get().partitionId() << 33
        sent: set[tuple[int, int]] = set()
        for turn, part in enumerate(slices(batches, "text")):
            place = first_place + turn
            words, starts, ends, first = cut(part.column("text"))
            common = sketch.reaches(span_hashes(words.data, starts, ends)).tolist()
            held = words.data.tobytes()
            chunks = [held[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            asked: dict[bytes, int] = {}  # shared chunks of this place, numbered
            own: list[bytes] = []
            texts = []  # the units of each: shared chunks, and what comes next of its own
            for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                units = repaired(code, chunks[low:high], common[low:high])
                texts.append([asked.setdefault(data, len(asked)) if is_shared else None for data, is_shared in units])
                own += [data for data, is_shared in units if not is_shared]
            codes = iter(code.encode(own))
            rows, at = [], []
            for i, units in enumerate(texts):
                mine = [next(codes) for n in units if n is None]
                data = b"".join(mine)
                if len(mine) == len(units):
                    rows.append((None, None, None, None, None, None, *code.digest(data)))
                else:
                    sizes = map(len, mine)
                    data = pa.compress(data, codec="zstd", asbytes=True) if data else data
                    rows.append((place, None, None, None, data, [-next(sizes) if n is None else n + 1 for n in units], None, None, None))
                at.append(i)
            for chunk, number in asked.items():
                name = chunk_name(chunk)
                rows.append((place, number, *name, None if name in sent else chunk, None, None, None, None))
                at.append(None)
                sent.add(name)
            columns = [pa.array(c, f) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)]
            keys = part.column("key").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *columns], names=["key", *(f.name for f in _PIECES)])
        # The worker waits for its next task, of this query or of another.
        pa.default_memory_pool().release_unused()

    return run


def _encode_chunks(path: str):
    """Task side: requests sorted by chunk, its text in front, get the codes; a chunk is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        last, codes = None, b""
        for part in slices(batches, "data"):
            names = list(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True))
            new = [i for i, name in enumerate(names) if name != (names[i - 1] if i else last)]
            found = dict(zip(new, code.encode(part.column("data").take(pa.array(new, pa.int64())).to_pylist()), strict=True))
            low, size, held = 0, 0, []
            for i, name in enumerate(names):
                codes = found.get(i, codes)
                held.append(codes)
                size += len(codes)
                # One chunk can be long and asked for by many.
                if size >= SLICE_BYTES or i + 1 == len(names):
                    out = part.slice(low, len(held))
                    yield pa.RecordBatch.from_arrays([out.column("place"), out.column("number"), pa.array(held, pa.binary())], names=["place", "number", "data"])
                    low, size, held = i + 1, 0, []
            last = names[-1]

    return run


def _join_units(path: str):
    """Task side: a place's shared chunks, then its documents, which are put together and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        place, chunks = None, []
        for batch in batches:
            at, rows = [], []
            columns = (batch.column(c).to_pylist() for c in ("place", "number", "data", "units"))
            for i, (own, number, data, units) in enumerate(zip(*columns, strict=True)):
                if own != place:
                    place, chunks = own, []
                if number is not None:
                    chunks.append(data)
                    continue
                size = -sum(n for n in units if n < 0)
                mine = pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""
                held, low = [], 0
                for n in units:
                    held.append(chunks[n - 1] if n > 0 else mine[low : low - n])
                    low -= min(n, 0)
                at.append(i)
                rows.append(code.digest(b"".join(held)))
            if rows:
                keys = batch.column("key").take(pa.array(at, pa.int64()))
                results = [pa.array(c, f) for c, f in zip(zip(*rows, strict=True), _ARROW[-3:], strict=True)]
                yield pa.RecordBatch.from_arrays([keys, *results], names=["key", *(f.name for f in _RESULT)])

    return run


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded with the tokenizer file ``path``.

    Codes are those of the library without special tokens; the decoded text keeps special
    tokens. Every text is cut into content-defined chunks, and all chunks are counted: a
    sketch of bounded size tells which may occur more than once. Those are encoded once for
    the corpus and go once to each slice of texts that holds them, where its documents are
    put together; copies are documents like others. All else is encoded where it lies, and
    a text without a shared chunk is never shuffled. Joins of chunks are checked by encoding
    across them, and units are widened and encoded anew until all joins agree. Every
    document is decoded.

    A null text counts as empty: no tokens and the digests of the empty string. Repeated
    rows and null keys give a row each. An empty table gives an empty one. Other columns
    are not looked at. ``path`` is read on every executor.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # One chunk wrongly taken for shared moves a document's codes, so the sketch is eight times as wide as usual.
    sketch = count_sketch(rows.select("text"), chunk_hashes, expected=8 * size // (6 * CHUNK_WORDS))
    shared = spark.sparkContext.broadcast(sketch)
    own_key = T.StructField("key", rows.schema["key"].dataType)
    pieces = stage_table(rows.mapInArrow(_cut_and_encode(path, shared), T.StructType([own_key, *_PIECES])), "pieces", codec="zstd")
    shared.unpersist()
    results = T.StructType([own_key, *_RESULT])
    done = pieces.where("n_tokens is not null").select(*results.names)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = pieces.where("number is not null").select("place", "number", "a", "b", "data")
    asked = asked.repartition(tasks, "a", "b").sortWithinPartitions("a", "b", F.col("data").isNull())
    chunks = asked.mapInArrow(_encode_chunks(path), "place long, number int, data binary")
    texts = pieces.where("units is not null").select("key", "place", "number", "data", "units")
    placed = texts.unionByName(chunks, allowMissingColumns=True).repartition(tasks, "place")
    placed = placed.sortWithinPartitions("place", F.col("number").asc_nulls_last())
    return done.unionByName(placed.mapInArrow(_join_units(path), results)).withColumnRenamed("key", key)
