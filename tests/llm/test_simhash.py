from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from seriesloom.llm import simhash
from seriesloom.llm.words import WORD_PATTERN

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text: str | None, k: int = 4) -> int:
    words = re.findall(WORD_PATTERN, (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: list[int], radius: int) -> list[int]:
    name = list(range(len(prints)))

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                name[b] = a
    return [top(i) for i in range(len(prints))]


def texts_with_copies(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "x y", "Word"]
    out: list[str | None] = [None, "", " \t\n", "one", "One two", "a b c", "A b c", "x " * 3000]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(40, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            changed = list(base)
            changed[rng.randrange(len(changed))] = "new"
            out.append("\n".join(changed))
    return out


def test_fingerprints_match_a_plain_loop():
    texts = texts_with_copies()
    got = simhash.fingerprints_of(pa.array(texts), 4)
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [2, 4])
def test_search_in_one_task_joins_what_all_pairs_join(radius):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 20, np.uint64)
    rows = [int(c) ^ sum(1 << b for b in set(rng.integers(0, 64, rng.integers(0, 9)).tolist())) for c in centres for _ in range(30)]
    rows = sorted(set(rows))
    fp = np.array(rows, np.uint64)
    member = rng.random(len(fp)) < 0.7
    _, label = simhash._linked(fp, np.zeros(len(fp), int), np.ones(len(fp), bool), radius)
    want = plain_components(rows, radius)
    assert len(set(zip(label.tolist(), want, strict=True))) == len(set(want)) == len(set(label.tolist()))
    # Two trees of one shard, each asked by all rows, give the same links together.
    both = [simhash._linked(fp, np.zeros(len(fp), int), m, radius) for m in (member, ~member)]
    joined = simhash.smallest_labels(len(fp), *[np.concatenate([x[i] for x in both]) for i in (0, 1)])
    assert len(set(zip(joined.tolist(), want, strict=True))) == len(set(want)) == len(set(joined.tolist()))


@pytest.mark.parametrize("count", [10, 10**6, 10**8, 10**10, 10**13])
def test_masks_keep_every_pair_within_the_radius(count):
    rng = random.Random(count)
    masks = simhash.shard_masks(count, 4)
    for _ in range(500):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


@pytest.mark.parametrize("tree_size", [4096, 3])
def test_components_match_all_pairs(spark, monkeypatch, tree_size):
    monkeypatch.setattr(simhash, "TREE_SIZE", tree_size)
    texts = texts_with_copies()
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)] + [(3, "One two", "en", "s", 1), (None, "a b c", None, None, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    want = plain_components(prints, 4)
    least = {}
    for r, c in zip(rows, want, strict=True):
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    expected = sorted((str(r[0]), f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, want, strict=True))
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == expected
    kept = simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


def test_a_hot_shard_is_searched_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TREE_SIZE", 40)
    monkeypatch.setattr(simhash, "ASK_SIZE", 80, raising=False)
    search = simhash._search_shards

    def counting(radius):
        run = search(radius)

        def counted(batches):
            sizes: Counter = Counter()

            def passed():
                for batch in batches:
                    names = [c for c in ("place", "key", "tree", "part") if c in batch.schema.names]
                    sizes.update(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
                    yield batch

            yield from run(passed())
            assert max(sizes.values(), default=0) <= 250

        return counted

    monkeypatch.setattr(simhash, "_search_shards", counting)
    # All agree on the upper bits.
    prints = random.Random(8).sample(range(2**22), 600)
    known = spark.createDataFrame([(x,) for x in prints], "fp long")
    links = [tuple(r) for r in simhash.fingerprint_links(known, 4).collect()]
    at = {x: i for i, x in enumerate(prints)}
    got = simhash.smallest_labels(600, *(np.array([at[r[i]] for r in links]) for i in (0, 1))).tolist()
    want = plain_components(prints, 4)
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got)) < 600


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, fp string, key int, row int, _tie int")
    assert simhash.near_duplicates(docs).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(docs).count() == 0
    rows = [(1, "a b c d e", "f", 1, 2, 3), (1, "a b c d e", "f", 1, 2, 3), (2, "other words in here now", "f", 1, 2, 3)]
    docs = spark.createDataFrame(rows, docs.schema)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_a_long_text_takes_bounded_memory():
    """Thirty megabytes of one text: some thirty times its size at the peak, where the sums of bits alone once took eighty."""
    text = pa.array([" ".join(f"w{i % 50_021}" for i in range(4_500_000)), "a b c", None])
    tracemalloc.start()
    got = simhash.fingerprints_of(text, 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 36 * text.nbytes
    assert got[1:].tolist() == simhash.fingerprints_of(text.slice(1), 4).tolist()
