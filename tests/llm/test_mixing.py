from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_targets(sizes: dict, weights=(3, 1, 2), share=1.5) -> dict:
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full = {}, set()
    total = share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(target[s] for s in full)
        for s in rest:
            target[s] = left * weight[s] / sum(weight[x] for x in rest)
        above = [s for s in rest if target[s] > 2 * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = 2 * sizes[s]
            full.add(s)


def documents(spark, count=900, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        source = rng.choice(["a", "a", "a", "b", "c", "é", "", None])
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])), "en", source, None))
    rows += [rows[0]] * 3 + [(None, "x y", None, "b", None), (None, None, None, None, None), (5, "x \t\n y z", "en", "b", 3)]
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("leaf", "fan"), [(4096, 64), (20, 3)])
def test_sources_come_near_their_targets(spark, monkeypatch, leaf, fan):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    monkeypatch.setattr(mixing, "FAN", fan)
    rows, docs = documents(spark)
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    got = mixing.mix_copies(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.copies <= 2 for r in got)
    source_of = {sizes[s]: s for s in sizes}
    assert len(source_of) == len(sizes)
    for size, source in source_of.items():
        own = [r for r in got if r.source_size == size]
        assert own[0].target == pytest.approx(want[source])
        assert abs(sum(r.copies * r.size for r in own) - want[source]) <= 200
    again = mixing.mix_copies(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_rounding_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 40).astype(float)
    start = rng.uniform(0.05, 0.95, 40)
    mean = np.zeros(40)
    for _ in range(3000):
        part = start.copy()
        left = mixing._pivot(size, part, rng.random(40))
        rest = np.delete(part, left)
        assert np.isin(rest, (0, 1)).all()
        assert part @ size == pytest.approx(start @ size)
        mean += part
    assert np.abs(mean / 3000 - start).max() < 0.05


def test_taken_documents(spark):
    rows, docs = documents(spark, 200)
    taken = {(r.doc_id, r.tie): 0 for r in mixing.mix_copies(docs).collect()}
    for r in mixing.mix_copies(docs).collect():
        taken[(r.doc_id, r.tie)] += r.copies
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    count = {(r.doc_id, r.tie): r.n for r in out.select("doc_id", F.xxhash64(*out.columns).alias("tie")).groupBy("doc_id", "tie").agg(F.count("*").alias("n")).collect()}
    assert count == {k: v for k, v in taken.items() if v}


def test_empty_and_wordless_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, size int, place int, tie string, part int")
    assert mixing.mix_copies(docs).count() == 0 and mixing.mixed_documents(docs).count() == 0
    docs = spark.createDataFrame([(1, None, "a", 1, 2, "t", 3), (2, " ", None, 1, 2, "t", 3)], docs.schema)
    assert [(r.doc_id, r.copies, r.target) for r in mixing.mix_copies(docs).orderBy("doc_id").collect()] == [(1, 0, 0.0), (2, 0, 0.0)]
