from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np

from seriesloom.llm import periodic, queries

SCHEMA = "doc_id long, text string, runs string, kept int, n_words int, key string, start int"


def plain_runs(words, least=12):
    """Every run, by looking at each period and place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((i, n, q) for (i, n), q in found.items())


def collapsed(words, runs):
    gone = {k for i, n, q in runs for k in range(i + q, i + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def planted(key, words):
    h = zlib.crc32(str(key).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts():
    rng = random.Random(5)
    out = [None, "", " \n", "a", "a " * 11, "a " * 12, "a b " * 6, "a b " * 6 + "a", "x " + "a b c " * 4 + "y", "é è\x0b" * 8]
    for letters in (1, 2, 2, 3, 4):
        out += [" ".join(rng.choices("abcd"[:letters], k=rng.randint(10, 200))) for _ in range(25)]
    for _ in range(60):
        text: list[str] = []
        for _ in range(rng.randint(1, 5)):
            unit = rng.choices([f"w{i}" for i in range(6)], k=rng.randint(1, 30))
            text += (unit * rng.randint(1, 6))[: rng.randint(1, 150)]
        out.append(rng.choice([" ", "\n", " \t"]).join(text))
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    return [*out, " ".join(fib[-1])]


def test_runs_match_a_plain_loop(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts())] + [(3, "a b " * 30), (3, "a b " * 30)]
    docs = spark.createDataFrame([(*r, "r", 1, 2, "k", 3) for r in rows], SCHEMA).repartition(3)
    for least in (12, 5):
        got = periodic.periodic_runs(docs, least=least)
        assert got.columns == ["doc_id", "n_words", "n_dropped", "runs", "kept"]
        got = [(r.doc_id, r.n_words, r.n_dropped, [tuple(x) for x in r.runs], r.kept) for r in got.collect()]
        want = []
        for key, text in rows:
            words = split(text)
            runs = plain_runs(words, least)
            kept = collapsed(words, runs)
            want.append((key, len(words), len(words) - len(kept), runs, " ".join(kept)))
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert periodic.periodic_runs(docs.where("n_words = 0")).count() == 0


def test_large_classes_and_long_texts():
    """A class of many places is kept in blocks; one long text takes time in proportion to its length."""
    rng = np.random.default_rng(1)
    same = np.full(60_000, 7, np.uint64)
    start = time.perf_counter()
    _, runs = periodic.find_runs(same, np.array([0, 30_000, 60_000]), 12)
    assert runs.tolist() == [[0, 30_000, 1]] * 2
    unit = rng.integers(0, 2**63, 50_000).astype(np.uint64)
    _, runs = periodic.find_runs(np.concatenate([unit[100:109], np.tile(unit, 7)]), np.array([0, 350_009]), 12)
    assert runs.tolist() == [[9, 350_000, 50_000]] and time.perf_counter() - start < 60
    places = periodic.Places([5])
    seen = [5]
    for place in rng.permutation(9000).tolist():
        if place != 5:
            before, after = places.add(place)
            seen.append(place)
            if len(seen) % 500 == 0:
                assert before == max((x for x in seen if x < place), default=None)
                assert after == min((x for x in seen if x > place), default=None)
    assert list(places) == list(range(9000)) and len(places) == 9000 and len(places.blocks) > 4


def test_query_digests(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(40)], k=rng.randint(0, 120)))) for i in range(300)]
    rows += [(None, "a b " * 9), (400, None), (401, ""), *[(i, "c d e f g h i j k l m n o p q r s t u v w x y z " * 2) for i in range(500, 540)]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic(spark, str(tmp_path))
    want = []
    for key, text in rows:
        words = split(text)
        words = words if key is None else planted(key, words)
        runs = plain_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = hashlib.sha256("".join(f"{i},{n},{q}\n" for i, n, q in runs).encode()).hexdigest()
        kept = hashlib.sha256(" ".join(collapsed(words, runs)).encode()).hexdigest()
        milli = 1000 * top[1] // top[2] if runs else None
        want.append((key, len(runs), *top, milli, digest, kept))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(w[1] > 0 for w in want) > 30
