"""Token counts under a unigram model: pre-tokens share a trie, and each prefix is scored once."""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices

# Nodes of a worker's trie and pre-tokens it remembers; beyond, it starts anew.
MOST_NODES, KNOWN_WORDS = 1_000_000, 500_000


class UnigramTrie:
    """Best segmentations of byte strings into pieces, a node for each prefix of any of them.

    A node's forward score is the best over all pieces that end there of the score where
    the piece begins plus the piece's own: it depends on the prefix alone, so strings
    with a common prefix share its scores. Of equal scores the longest last piece wins.
    A terminal's number of pieces is the string's token count.
    """

    def __init__(self, scores: dict[bytes, float]):
        self.scores = scores
        # The longest piece by its last two bytes: the only starts that a prefix with this end needs to try.
        self.reach: dict[bytes, int] = {}
        for piece in scores:
            if len(piece) > 1:
                self.reach[piece[-2:]] = max(self.reach.get(piece[-2:], 1), len(piece))
        self.known: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all nodes but the root."""
        self.next: dict[int, int] = {}  # 256 times the node plus the byte: the child
        self.score = array("d", [0.0])
        self.pieces = array("l", [0])

    def insert(self, word: bytes) -> int:
        """The token count of ``word``, scoring those of its prefixes that are new."""
        path, node = [0], 0
        for byte in word:
            child = self.next.get(node * 256 + byte)
            if child is None:
                break
            node = child
            path.append(node)
        scores, score, pieces, reach = self.scores, self.score, self.pieces, self.reach
        for end in range(len(path), len(word) + 1):
            best, count = -math.inf, -1
            for start in range(max(0, end - reach.get(word[max(0, end - 2) : end], 1)), end):
                own = scores.get(word[start:end])
                if own is not None and score[path[start]] + own > best:
                    best, count = score[path[start]] + own, pieces[path[start]] + 1
            child = len(score)
            self.next[node * 256 + word[end - 1]] = child
            score.append(best)
            pieces.append(count)
            path.append(child)
            node = child
        return pieces[node]

    def count(self, words: list[bytes]) -> int:
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        fresh = set(words).difference(known)
        if len(known) + len(fresh) > KNOWN_WORDS:
            known.clear()
            fresh = set(words)
        # In order, neighbours share the most.
        for word in sorted(fresh):
            if len(self.score) + len(word) > MOST_NODES:
                self.clear()
            known[word] = self.insert(word)
        return sum(map(known.__getitem__, words))


def rank_scores(path: str) -> dict[bytes, float]:
    """Pieces of a rank file (base64 piece, rank) with Zipf's log probability of their rank."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    whole = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {piece: -math.log(rank + 1) - whole for piece, rank in ranks.items()}


@cache
def _trie(path: str) -> UnigramTrie:
    """One for each Python worker, which keeps it from task to task."""
    return UnigramTrie(rank_scores(path))


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(path)
        for part in slices(batches, "text"):
            words, tokens = [], []
            for text in part.column("text").to_pylist():
                own = (text or "").encode().split()
                words.append(len(own))
                tokens.append(trie.count(own))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["key", "n_words", "n_tokens"]
            )

    return run


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_words, n_tokens`` of every whole text.

    Pre-tokens are the words (``[^\\x20\\x09-\\x0D]+``) in UTF-8; white space has no
    tokens. A pre-token has as many tokens as the most probable segmentation into pieces
    of the rank file ``path``, which holds all single bytes; probabilities are Zipf's.
    Each worker's trie and memory are bounded. Nothing is shuffled.

    A null or wordless text has no words and no tokens. Rows are counted each for itself,
    repeated ones and those with a null key too. An empty table gives an empty one.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType(
        [rows.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    return rows.mapInArrow(_count(path), schema).withColumnRenamed("key", key)
