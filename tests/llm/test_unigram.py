from __future__ import annotations

import math
import random
import re

import public_tokenizers
import pytest

from seriesloom.llm import unigram

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, key int, n_tokens string"


def plain(word: bytes, scores: dict[bytes, float]) -> int:
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            own = scores.get(word[start:end])
            if own is not None and best[start][0] + own > best[end][0]:
                best[end] = (best[start][0] + own, best[start][1] + 1)
    return best[-1][1]


@pytest.fixture(scope="module")
def scores():
    return unigram.rank_scores(PATH)


def words(count=600, seed=2):
    rng = random.Random(seed)
    parts = ["th", "re", "tion", "ing", "é", "ü", "über", "日本", "🙂", ".", ",", "##", "0", "x" * 30]
    return ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(count)]


def test_counts_match_a_plain_forward_pass(spark, scores):
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "a" * 5000, "the the\vthe"] + [rng.choice([" ", "\n"]).join(rng.choices(words(), k=80)) for _ in range(30)]
    rows = [(i, t, 1, "n") for i, t in enumerate(texts)] + [(None, "one", 1, "n"), (3, "one", 1, "n")]
    got = unigram.token_counts(spark.createDataFrame(rows, SCHEMA), PATH)
    want = []
    for key, text, *_ in rows:
        own = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        want.append((key, len(own), sum(plain(w, scores) for w in own)))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert unigram.token_counts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_shared_prefixes_are_scored_once_and_memory_is_bounded(scores, monkeypatch):
    trie = unigram.UnigramTrie(scores)
    own = [w.encode() for w in words()]
    assert [trie.count([w]) for w in own] == [plain(w, scores) for w in own]
    assert len(trie.score) == len({w[:i] for w in own for i in range(len(w) + 1)})
    monkeypatch.setattr(unigram, "MOST_NODES", 500)
    small = unigram.UnigramTrie(scores)
    for low in range(0, 600, 20):
        assert small.count(own[low : low + 20]) == sum(plain(w, scores) for w in own[low : low + 20])
