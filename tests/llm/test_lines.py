from __future__ import annotations

import itertools
import random
import re
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from seriesloom.llm import lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tokens(line: str, k: int = 5) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain(rows):
    """Removed line numbers of each row."""
    every = [(key, i, tokens(x)) for key, t in rows if key is not None and t is not None for i, x in enumerate(t.split("\n"))]
    every = [x for x in every if x[2]]
    out = []
    for key, t in rows:
        gone = []
        for i, x in enumerate((t or "").split("\n")):
            own = tokens(x)
            if key is None or not own:
                continue
            if any((k, j) < (key, i) and 10 * len(own & o) >= 8 * len(own | o) for k, j, o in every):
                gone.append(i)
        out.append(gone)
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(120)] + ["é"]
    base = [rng.choices(words, k=k) for k in (1, 2, 4, 5, 8, 9, 30, 60, 60)]
    rows = [(2, None), (1, ""), (0, "\n\n"), (None, " ".join(base[6])), (None, None), (3, "x y\n \nx y\n"), (4, "a a a a a a a\na a a a a a\n")]
    for i in range(10, 70):
        own = []
        for _ in range(rng.randint(1, 5)):
            if rng.random() < 0.4:
                own.append(rng.choices(words, k=rng.randint(0, 40)))
            else:
                line = list(rng.choice(base))
                for _ in range(rng.randint(0, 2)):
                    line[rng.randrange(len(line))] = rng.choice(words)
                own.append(line)
        rows.append((i, "\n".join(rng.choice([" ", "  "]).join(x) for x in own) + rng.choice(["", "\n", "\r\n"])))
    return rows + [rows[20], rows[20], (5, rows[30][1]), (40, rows[30][1]), (-1, "long " * 30_000)]


@pytest.mark.parametrize("list_size", [65_536, 4])
def test_later_matches_go(spark, monkeypatch, list_size):
    monkeypatch.setattr(lines, "LIST_SIZE", list_size)
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "en", "s", 7) for k, t in rows], SCHEMA).repartition(4)
    want = []
    for (key, text), gone in zip(rows, plain(rows), strict=True):
        own = [] if text is None else text.split("\n")
        left = None if text is None else "\n".join(x for i, x in enumerate(own) if i not in gone)
        want.append((key, sum(bool(tokens(x)) for x in own), len(gone), left))
    got = lines.dedup_lines(docs)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert sum(x[2] for x in want) > 50
    whole = lines.without_repeated_lines(docs)
    assert whole.columns == docs.columns
    renewed = [(k, left, "en", "s", len(left) if n else 7) for k, _, n, left in want]
    assert sorted(map(str, (tuple(r) for r in whole.collect()))) == sorted(map(str, renewed))


def test_a_hot_token_is_searched_in_bounded_groups(spark, monkeypatch):
    monkeypatch.setattr(lines, "LIST_SIZE", 8)
    monkeypatch.setattr(lines, "ASK_SIZE", 16, raising=False)
    search = lines._pairs

    def counting(similarity, every):
        run = search(similarity, every)

        def counted(batches):
            sizes: Counter = Counter()

            def passed():
                for batch in batches:
                    names = [c for c in ("token", "list", "part") if c in batch.schema.names]
                    sizes.update(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
                    yield batch

            yield from run(passed())
            assert max(sizes.values(), default=0) <= 64

        return counted

    monkeypatch.setattr(lines, "_pairs", counting)
    texts = [" ".join(x) for x in itertools.product("ab", repeat=10)]
    random.Random(6).shuffle(texts)
    rows = list(enumerate(texts[:600]))
    docs = spark.createDataFrame([(k, t, "en", "s", 7) for k, t in rows], SCHEMA).repartition(4)
    got = dict(lines.dedup_lines(docs).select("doc_id", "n_removed").collect())
    want = {k: len(gone) for (k, _), gone in zip(rows, plain(rows), strict=True)}
    assert got == want and 0 < sum(want.values()) < 600


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, row int, lines int, rank string, tie int, kept int, n_lines int")
    assert lines.dedup_lines(docs).count() == 0 and lines.without_repeated_lines(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b\nc", 1, 2, "r", 3, 4, 5), (2, "c\nd", 1, 2, "r", 3, 4, 5)], docs.schema)
    got = {r.doc_id: r for r in lines.without_repeated_lines(docs).collect()}
    assert tuple(got[2]) == (2, "d", 1, 2, "r", 3, 4, 5) and got[1].text == "a b\nc"


def test_tokens_of_many_texts_need_little_memory():
    texts = ["\n".join(" ".join(f"w{i * j % 997}" for j in range(12)) for i in range(k, k + 60)) for k in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    for _ in lines._tokens(5)(iter([batch.slice(0, 100)])):  # tables of powers are kept
        pass
    tracemalloc.start()
    count = sum(len(found) for found in lines._tokens(5)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == sum(len({w for x in t.split("\n") for w in [(x, p) for p in tokens(x)]}) for t in texts)
    assert peak < 10_000_000
