from __future__ import annotations

import hashlib
import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seriesloom.llm import bpe
from seriesloom.llm.sketch import _pack, _unpack, count_sketch

PATH = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string, uid int, seq int, data string"
ODD = [
    None,
    "",
    " \t\n",
    "It's the dog's; they'll WE'RE \x1c \x85  x y",
    "<|endoftext|> a<|startoftext|>b <|EndOfText|>",
    "é é ́x ÀÉß İstanbul ΣΑΣ ﬁ Ǆ 한국 日本語 🙂👍🏽 1234 ١٢",
    "don't. stop, Now! «Ça» va? naïve; x:",
    "x " * 30_000,
    "a" * 20_000,
    "word\x00null \x7f​",
]


def corpus() -> list[str | None]:
    rng = random.Random(2)
    words = ["The", "thoned,", "reathing", "Über", "l'eau", "É.", "x1y2", "##", "don't", "hello", "WORLD!"] + [f"wor{i}d" for i in range(300)]
    passages = [" ".join(rng.choices(words, k=400)) for _ in range(4)]
    out = list(ODD)
    for _ in range(40):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 150))), rng.choice(passages), "\n" * rng.randint(0, 2)]
        rng.shuffle(parts)
        out.append(rng.choice([" ", "\n", "", "\t "]).join(parts))
    return out + [out[-1]] * 5 + ["  " + passages[0], passages[0] + "  "]


def expected(path: str, text: str | None) -> tuple:
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    ids = tok.encode(text or "", add_special_tokens=False).ids
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), tok.decode(ids, skip_special_tokens=False))]
    return (len(ids), *sha)


@pytest.mark.parametrize("path", [PATH, BYTES])
def test_documents_match_the_library(spark, path):
    texts = corpus()
    rows = [(i, t, "c", 1, 2, "d") for i, t in enumerate(texts)] + [(None, texts[12], "c", 1, 2, "d"), (3, texts[3], "c", 1, 2, "d")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = bpe.encode_documents(docs, path)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = sorted(str((r[0], *expected(path, r[1]))) for r in rows)
    assert sorted(str(tuple(r)) for r in got.collect()) == want


@pytest.mark.parametrize("known", [2, 20_000])
def test_copies_are_encoded_once_and_each_has_a_row(spark, monkeypatch, known):
    """Copies next to each other, far apart, under other keys and under none, of texts with and without shared chunks."""
    monkeypatch.setattr(bpe, "KNOWN_TEXTS", known)
    texts = corpus()[10:60]
    rows = [(i, t) for i, t in enumerate(texts) for _ in range(1 + i % 3)]
    rows += [(None if i % 2 else 1000 + i, t) for i, t in enumerate(texts)] + [(7, ""), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = bpe.encode_documents(docs, PATH)
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str((r[0], *expected(PATH, r[1]))) for r in rows)


def test_texts_seen_are_not_counted_again():
    texts = [t for t in corpus() if t]
    alone = list(bpe.chunk_hashes(iter([pa.record_batch({"text": pa.array(dict.fromkeys(texts))})])))
    copied = list(bpe.new_chunk_hashes(iter([pa.record_batch({"text": pa.array(texts * 3)})])))
    assert sorted(np.concatenate(alone).tolist()) == sorted(np.concatenate(copied).tolist())


def test_empty_table(spark):
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_is_coded_as_the_library_does(text):
    code, tok = bpe.coder(PATH), Tokenizer.from_file(PATH)
    ids = tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(code.encode([text.encode()])[0], code.kind).tolist() == ids
    assert code.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_joins_that_do_not_agree_are_widened():
    code = bpe.coder(BYTES)
    text = b"hello world these are words in a row again and again"
    parts = [text[:13], text[13:17], text[17:30], text[30:]]
    units = bpe.repaired(code, parts, [True, True, False, True])
    assert b"".join(u for u, _ in units) == text
    assert b"".join(code.encode([u for u, _ in units])) == code.encode([text])[0]
    assert len(units) < 4


def test_equal_passages_are_cut_alike_and_found_shared(spark):
    texts = corpus()[10:]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    sketch = count_sketch(docs, bpe.chunk_hashes, 1000)
    words, starts, ends, first = bpe.cut(pa.array(texts))
    common = sketch.reaches(bpe.span_hashes(words.data, starts, ends))
    data = words.data.tobytes()
    parts = [data[i:j] for i, j in zip(starts, ends, strict=True)]
    assert b"".join(parts) == data
    twice = {p for p in parts if parts.count(p) > 1}
    assert len(twice) > 5
    assert twice <= {p for p, c in zip(parts, common, strict=True) if c}


def test_packed_counters_round_trip():
    rng = np.random.default_rng(1)
    for size in (0, 1, 5, 3000):
        index = np.sort(rng.integers(0, 1 << 17, size))
        assert _unpack(_pack(index)).tolist() == index.tolist()
    assert _unpack(_pack(np.array([0, 0, 255, 510, 511]))).tolist() == [0, 0, 255, 510, 511]


def test_words_met_often_are_encoded_once_though_many_pass():
    code = bpe.Coder(PATH, 40_000)
    tok, made, split = code.tokenizer, [], code.split
    code.split = lambda piece: made.append(piece) or split(piece)
    texts = [f"Often,&& often... {'a' * (i % 9 + 1)}{'bcdefgh'[i % 7]}{chr(97 + i // 26)}{chr(97 + i % 26)}*** don't ## é," for i in range(600)]
    for text in texts:
        assert np.frombuffer(code.encode([text.encode()])[0], code.kind).tolist() == tok.encode(text, add_special_tokens=False).ids
        assert len(code.known) + len(code.older) < 250
    assert made.count("often") == made.count("***") == 1


def pieces_of(monkeypatch, texts: list[str], shared: set[int]) -> list[dict]:
    """What a task makes of ``texts``, if the chunks with the hashes ``shared`` occur elsewhere."""
    monkeypatch.setattr(bpe.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    sketch = SimpleNamespace(reaches=lambda hashes: np.isin(hashes, np.array(sorted(shared), np.uint64)))
    batch = pa.record_batch({"key": pa.array(range(len(texts))), "text": pa.array(texts)})
    return pa.Table.from_batches(bpe._cut_and_encode(PATH, SimpleNamespace(value=sketch))(iter([batch]))).to_pylist()


def test_texts_that_share_little_are_put_together_from_chunks(monkeypatch):
    text = " ".join(f"word{i} of {i * i % 977}" for i in range(600))
    words, starts, ends, _ = bpe.cut(pa.array([text]))
    assert len(starts) > 4
    hashes = bpe.span_hashes(words.data, starts, ends)
    found = pieces_of(monkeypatch, [text, text + " more", "alone"], {int(hashes[1])})
    documents = {r["key"]: r for r in found if r["key"] is not None}
    assert [documents[k]["units"] and [n for n in documents[k]["units"] if n > 0] for k in range(3)] == [[1], [1], None]
    assert documents[2]["n_tokens"] == expected(PATH, "alone")[0]
    chunk = text[int(starts[1]) : int(ends[1])].encode()
    assert [(r["number"], r["data"]) for r in found if r["key"] is None] == [(0, chunk)]


def test_every_copy_is_encoded_and_decoded(monkeypatch):
    encoded, decoded = [], []
    encode, decode = bpe.Coder.encode, bpe.Coder.decode
    monkeypatch.setattr(bpe.Coder, "encode", lambda self, texts: encoded.extend(texts) or encode(self, texts))
    monkeypatch.setattr(bpe.Coder, "decode", lambda self, ids: decoded.append(ids) or decode(self, ids))
    found = pieces_of(monkeypatch, ["one text", "another", "one text", "one text"], set())
    assert encoded == [b"one text", b"another", b"one text", b"one text"] and len(decoded) == 4
    assert [r["key"] for r in found] == [0, 1, 2, 3]


def test_texts_with_equal_hashes_have_their_own_codes(spark):
    """Two words of 2,048 letters whose polynomial hashes are equal modulo 2^64, whatever the base."""
    marks = [bin(i).count("1") % 2 for i in range(2048)]
    one, two = "".join("ab"[m] for m in marks), "".join("ba"[m] for m in marks)
    words = bpe.split_words(pa.array([one, two]))
    for seed in (0, 1):
        assert len(set(bpe.span_hashes(words.data, words.starts, words.ends, seed).tolist())) == 1
    assert bpe.chunk_name(one.encode()) != bpe.chunk_name(two.encode())
    rows = [(1, one), (2, two), (3, two), (4, one), (5, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(r) for r in bpe.encode_documents(docs, PATH).collect()) == [(k, *expected(PATH, t)) for k, t in rows]


def test_a_chunk_that_many_ask_for_is_encoded_once_and_sent_in_small_batches(monkeypatch):
    made = []
    encode = bpe.Coder.encode
    monkeypatch.setattr(bpe.Coder, "encode", lambda self, texts: made.extend(texts) or encode(self, texts))
    texts = [b"x " * 300_000, b"short one"]
    asked = [(i % 7, 0, name, name, texts[name] if i == 0 else None) for name in (0, 1) for i in range(20)]
    columns = [pa.array(c, f) for c, f in zip(zip(*asked, strict=True), bpe._ARROW, strict=False)]
    table = pa.Table.from_arrays(columns, names=["place", "number", "a", "b", "data"])
    batches = list(bpe._encode_chunks(PATH)(iter(table.to_batches(max_chunksize=9))))
    assert made == texts
    assert max(b.column("data").nbytes for b in batches) < 3 << 20
    got = pa.Table.from_batches(batches)
    assert got["place"].to_pylist() == table["place"].to_pylist()
    want = [b.tobytes() for b in (np.array(Tokenizer.from_file(PATH).encode(t.decode(), add_special_tokens=False).ids, np.uint16) for t in texts)]
    assert got["data"].to_pylist() == [want[0]] * 20 + [want[1]] * 20
