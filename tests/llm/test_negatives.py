from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, anchor string, part int, id int, size int"


def vectors(count=600, size=10, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    rows = []
    for i in range(count):
        c = int(rng.integers(6))
        rows.append((i, (centres[c] + 0.5 * rng.normal(size=size)).astype(np.float32).tolist(), c if rng.random() < 0.6 else int(rng.integers(10))))
    rows[30] = (30, rows[100][1], rows[100][2])
    rows += [(1000 + i, rows[100][1], i % 3) for i in range(40)]  # one vector many times
    rows += [(2000 + i, rng.integers(-2, 3, size).astype(float).tolist(), int(rng.integers(3))) for i in range(150)]  # ties
    odd = [None, [], [0.0] * size, [1.0] * (size - 1) + [None], [math.nan] + [1.0] * (size - 1), [math.inf] * size, [1e-30] * size]
    rows += [(3000 + 100 * i, v, 1) for i, v in enumerate(odd)]
    rows += [(None, rows[3][1], 1), (4000, rows[3][1], None), (4100, [1.0, 2.0], 1), (4101, [2.0, 1.0], 1), (4102, [1.0, 1.0], 2), (200, rows[200][1], rows[200][2])]
    rows += [(5, rows[9][1], 2), (5, rows[9][1], 2)]
    return rows


def plain(rows, k=5, n=10):
    good = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = set()
    for own, label, v in good:
        if own % 100:
            continue
        every = [(-sum(a * b for a, b in zip(v, w, strict=True)), i, other) for i, other, w in good if i != own and len(v) == len(w)]
        first = sorted((s, i) for s, i, other in every if other == label)[:k]
        for s, i in first:
            fits = sorted((t, j) for t, j, other in every if other != label and 30 * -s <= 100 * -t <= 90 * -s)[:n]
            out |= {(own, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(fits)}
    return sorted(out)


def mined(table):
    shifted = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(shifted, F.col("vec_id") % 100 == 0)


@pytest.mark.parametrize(("shard", "anchors", "step"), [(8192, 4096, 128), (90, 5, 7)])
def test_matches_brute_force(spark, monkeypatch, shard, anchors, step):
    monkeypatch.setattr(negatives, "SHARD", shard)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "FIRST_STEP", step)
    rows = vectors()
    table = spark.createDataFrame([(*r, "a", 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    got = mined(table)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in got.collect())
    assert sorted(set(got)) == plain(rows) and len(got) > 300


def test_empty_tables_and_no_anchors(spark):
    rows = vectors(120)
    table = spark.createDataFrame([(*r, "a", 1, 2, 3) for r in rows], SCHEMA)
    assert mined(table.where("vec_id < 0")).count() == 0
    assert mined(table.where("vec_id % 100 <> 0")).count() == 0


def test_huge_components_are_bounded(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [3e38, -1.0], 1), (2, [2e30, 5.0], 2), (3, [1.0, 1.0], 2), (4, [-3e38, 0.0], 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = negatives.hard_negatives(table, F.col("vec_id") == 0, high=100).collect()
    assert [(r.positive_id, r.negative_id) for r in got] == [(1, 2), (1, 3)]
    assert {r.positive_score for r in got} == {int(negatives.HIGHEST)} == {r.negative_score for r in got}


def test_walks_end_early():
    """Clustered anchors score a part of the rows only, and find what scoring all of them finds."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = centres[rng.integers(20, size=6000)] + 0.15 * rng.normal(size=(6000, 16))
    labels = rng.integers(4, size=6000)
    anchors = negatives.Vectors.of(np.arange(200), labels[:200], rows[:200])
    every = negatives.Vectors.of(np.arange(6000), labels, rows)
    asks = negatives.Asks(np.arange(200), np.full(200, -np.inf), np.full(200, np.inf), True)
    ask, ids, score, taken = negatives.walk(anchors, every, asks, 5)
    assert taken < 0.5 * 200 * 6000
    whole = anchors.whole @ every.whole.T
    for a in range(200):
        fits = [i for i in np.lexsort((every.ids, -whole[a])) if labels[i] == labels[a] and i != a][:5]
        assert sorted(ids[ask == a]) == sorted(fits) and sorted(score[ask == a]) == sorted(whole[a][fits])


def test_query_equals_its_sql(spark, tmp_path):
    rows = [r for r in vectors(400, seed=4) if r[0] is None or r[0] not in (5, 200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in queries.op13_negatives(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op13_negatives"])
    names = [d[0] for d in want.description]
    assert names == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(want.fetchall()) == got == plain(rows)
