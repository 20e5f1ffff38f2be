from __future__ import annotations

import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import queries, toxicity

DOCS = "doc_id long, text string, key string, score string, fold int, toxic int, features string"
LABELS = "doc_id long, quality int, toxic int, key string"
LEXICON = toxicity.Lexicon({"idiot": 5.0, "scum": 4.0}, {"lowe": 6.0, "lowei": 7.0})


def said_of(text, lexicon=LEXICON):
    """The features before their logarithm."""
    found = toxicity.features(text, lexicon, lexicon.automaton())
    return {n: v if n == "share" else round(float(np.expm1(v)), 6) for n, v in zip(toxicity.FEATURES, found, strict=True)}


def test_clauses_are_read_by_the_composed_grammar():
    assert not any(said_of("nothing here, and idiotic or xidiot is no match").values())
    plain = said_of("what an Idiot")
    assert (plain["all"], plain["plain"], plain["aimed"], plain["matches"]) == (5, 5, 0, 1)
    assert said_of("you are an idiot")["aimed"] == said_of("idiot that you are")["aimed"] == 5
    assert said_of("you. idiot")["aimed"] == 0  # a clause ends what the one before it says
    denied = said_of("he is not an idiot")
    assert (denied["denied"], denied["plain"], denied["aimed"]) == (5, 0, 5)
    assert said_of("no. an idiot")["denied"] == 0
    told = said_of("he said that this scum, scum")
    assert (told["told"], told["plain"], told["kinds"], told["clause"]) == (4, 4, 1, 4)
    assert said_of("loweisch und lowen und lowe")["all"] == 7 + 6 + 6
    assert said_of("i will kill you")["threat"] == 1 and said_of("you they will kill")["threat"] == 1
    assert said_of("i will not kill you")["threat"] == said_of("the frost may kill you")["threat"] == 0
    assert said_of("he said you will kill me")["threat"] == 0


def test_composition_equals_its_parts():
    """The one table says what the transducers say one by one, over random words."""
    rng = random.Random(1)
    steps = (toxicity.target_step, toxicity.late_step, toxicity.denial_step, toxicity.report_step, toxicity.intent_step)
    for _ in range(200):
        state, own = 0, [0] * len(steps)
        for _ in range(30):
            kind = rng.randrange(7)
            state, said = toxicity.GRAMMAR[state, kind]
            parts = [step(s, kind) for step, s in zip(steps, own, strict=True)]
            own = [s for s, _ in parts]
            assert said == sum(m for _, m in parts)


def test_long_texts_take_linear_time():
    start = time.perf_counter()
    long = said_of("you idiot " * 200_000)
    assert long["matches"] == 200_000 and time.perf_counter() - start < 30
    start = time.perf_counter()
    assert said_of("idiot. " * 100_000)["clause"] == 5 and said_of("a" * 3_000_000)["matches"] == 0
    assert time.perf_counter() - start < 30


def test_odd_rows(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(300):
        words = rng.choices([f"w{chr(97 + k)}x" for k in range(26)], k=30)
        toxic = i % 5 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(["zork", "grumptious", "grumptal", "grumpen"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    rows += [(None, "zork"), (None, None), (1000, ""), (1001, None), (1002, "x" * 200_000), (1003, "grumpxx"), (0, rows[0][1]), (0, rows[0][1])]
    marks += [(0, 0, 0), (0, 0, None), (None, 1, 1), (1003, 1, None), (99_999, 1, 1)]
    docs = spark.createDataFrame([(*r, "k", "s", 1, 2, "f") for r in rows], DOCS).repartition(3)
    labels = spark.createDataFrame([(*m, "k") for m in marks], LABELS)
    model = toxicity.fit(docs, labels, F.lit(True))
    assert "zork" in model.lexicon.words or "zork" in model.lexicon.beginnings
    assert any("grumpxx".startswith(b) for b in model.lexicon.beginnings)
    scored = toxicity.score_documents(docs, model)
    assert scored.columns == ["doc_id", "score", "predicted"]
    got = scored.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by_key = {r.doc_id: r.predicted for r in got if r.doc_id is not None}
    assert all(by_key[i] == int(i % 5 == 0) for i in range(300))
    assert [by_key[i] for i in (1000, 1001, 1002, 1003)] == [0, 0, 0, 1]
    assert toxicity.score_documents(docs.where("fold = 0"), model).count() == 0
    for some in (labels.where("quality > 5"), labels.where("toxic = 1")):
        bare = toxicity.fit(docs, some, F.lit(True))
        judged = toxicity.score_documents(spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string"), bare)
        assert {r.doc_id: r.predicted for r in judged.collect()} == {1: 1, 2: 0}
    few = toxicity.fit(docs, labels, F.lit(True), size=200)
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(docs, few).collect())


@pytest.fixture(scope="module")
def judged(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = queries.op12_toxicity(spark, sf_dir)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored.join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(judged):
    assert (judged["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in judged["doc_id"]]).all()
    held = judged[judged["held_out"] & judged["toxic"].notna()]
    flagged, toxic = held["predicted"] == 1, held["toxic"] == 1
    assert (flagged & toxic).sum() >= 0.9 * toxic.sum() and (flagged & ~toxic).sum() <= 0.002 * (~toxic).sum()
    ranks = held["score"].rank()
    area = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert area > 0.96
