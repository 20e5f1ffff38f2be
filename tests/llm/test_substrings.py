from __future__ import annotations

import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from seriesloom.llm import substrings

SCHEMA = "doc_id long, text string, n_words string, kept int, a int, rank string, spots int"


def plain(rows, window=13):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first: dict = {}
    for (key, _), words in zip(rows, split, strict=True):
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if key is not None:
                first[run] = min(key, first.get(run, key))
    out = []
    for (key, _), words in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(words) - window + 1):
            if key is not None and first[tuple(words[i : i + window])] < key:
                gone |= set(range(i, i + window))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(150)] + ["É", "é"]
    passages = [rng.choices(words, k=k) for k in (12, 13, 14, 60, 400)]
    rows = [(9, None), (8, ""), (7, " \n "), (6, "a b c"), (None, " ".join(passages[3])), (None, None), (5, "x " * 20_000), (4, "x\t" * 30)]
    for i in range(10, 130):
        text: list[str] = []
        for _ in range(rng.randint(1, 4)):
            text += rng.choices(words, k=rng.randint(0, 60)) if rng.random() < 0.5 else rng.choice(passages)
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(20, rows[30][1]), rows[40], rows[40], (-3, rows[41][1]), (200, rows[41][1] + " tail")]
    return rows


def test_kept_words_match_a_plain_loop(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "n", 1, 2, "r", 3) for r in rows], SCHEMA).repartition(5)
    got = substrings.remove_repeated(docs)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain(rows)))


def test_short_windows_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (2, "z b c d z"), (3, "c d e f b c d")]
    docs = spark.createDataFrame([(*r, "n", 1, 2, "r", 3) for r in rows], SCHEMA)
    got = substrings.remove_repeated(docs, window=3, piece=2)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, plain(rows, 3)))
    assert substrings.remove_repeated(docs.where("doc_id < 0")).count() == 0


def test_settled_rows_of_copies_do_not_share_a_place():
    text = " ".join(f"w{i}" for i in range(40))
    rows = pa.RecordBatch.from_arrays(
        [pa.array(range(300), pa.int64()), pa.array([7] * 300, pa.int64()), pa.array([text] * 300)], names=["rank", "tie", "text"]
    )
    sketch = SimpleNamespace(value=SimpleNamespace(reaches=lambda hashes: np.ones(len(hashes), bool)))
    got = pa.Table.from_batches(substrings._claims(13, 5, sketch)([rows])).to_pylist()
    settled = [r for r in got if r["settled"]]
    assert len(settled) == 299 and len({(r["a"], r["b"]) for r in settled}) == 299
    assert all(sorted(r["spots"]) == list(range(28)) for r in settled) and sum(not r["settled"] for r in got) == 28
