from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import vptree

SCHEMA = "vec_id long, embedding array<float>, label int, size int, shard string"


def vectors(count=400, size=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, size))
    rows = []
    for i in range(count):
        v = centres[rng.integers(8)] + 0.4 * rng.normal(size=size)
        rows.append((i, v.astype(np.float32).tolist()))
    rows[30] = (30, rows[50][1])
    rows[31] = (31, rows[50][1])
    rows += [(1000 + i, rows[100][1]) for i in range(20)]
    odd = [None, [], [0.0] * size, [1.0] * (size - 1) + [None], [float("nan")] + [1.0] * (size - 1), [float("inf")] * size, [1e-30] * size, [3e38] * size]
    rows += [(2000 + 50 * i, v) for i, v in enumerate(odd)]
    rows += [(None, rows[3][1]), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (150, rows[7][1])]
    return rows


def plain(rows, k=5):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q in sorted({i for i, _ in good if i % 50 == 0}):
        best: dict = {}
        for n, (own, a) in enumerate(good):
            if own != q:
                continue
            for m, (i, b) in enumerate(good):
                if i != q and len(a) == len(b):
                    score = (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
                    best[(n, m)] = (-score, i)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(best.values())[:k])]
    return out


@pytest.mark.parametrize(("shard", "leaf"), [(8192, 128), (60, 8)])
def test_factor_one_is_exact(spark, monkeypatch, shard, leaf):
    monkeypatch.setattr(vptree, "SHARD", shard)
    monkeypatch.setattr(vptree, "LEAF", leaf)
    rows = [r for i, r in enumerate(vectors()) if not (r[0] == 150 and i > 400)]
    table = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], SCHEMA).repartition(3)
    got = vptree.nearest(table, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(tuple(r) for r in got.collect())
    want = plain(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14)


def test_blocks_of_queries_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(vptree, "QUERY_BLOCK", 3)
    rows = vectors(300)
    rows = [r for r in rows if r[0] is not None and r[0] < 1000][:300]
    table = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], SCHEMA)
    got = sorted(tuple(r)[:3] for r in vptree.nearest(table, F.col("vec_id") % 50 == 0).collect())
    assert got == [w[:3] for w in plain(rows)]
    few = table.where("vec_id in (0, 1, 2)")
    assert [tuple(r)[:2] for r in vptree.nearest(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert vptree.nearest(table.where("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    assert vptree.nearest(table.where("vec_id = 7"), F.col("vec_id") % 50 == 0).count() == 0


def test_a_larger_factor_prunes_more_and_keeps_most():
    rng = np.random.default_rng(2)
    data = (rng.normal(size=(30, 24))[rng.integers(30, size=4000)] + 0.3 * rng.normal(size=(4000, 24))).astype(np.float32)
    tree = vptree.VpTree(np.arange(4000), data, 5)
    unit = vptree._unit(data[::40])
    exact, _ = tree.search(unit, 6, 1.0)
    brute = np.argsort(-(unit @ tree.unit.T), axis=1)[:, :6]
    assert all(set(a) == set(b) for a, b in zip(exact.tolist(), brute.tolist(), strict=True))
    loose, _ = tree.search(unit, 6, 2.0)
    recall = np.mean([len(set(a) & set(b)) / 6 for a, b in zip(loose.tolist(), brute.tolist(), strict=True)])
    assert 0.9 <= recall <= 1


def tied_tables():
    rng = np.random.default_rng(3)
    signs = [(i, v) for i, v in enumerate(rng.choice([-1.0, 1.0], size=(1200, 8)).tolist())]
    signs = [(i, [x * 2.0 ** float(rng.integers(-2, 3)) for x in v]) if i % 3 else (i, v) for i, v in signs]
    line = [(i, [2.0 ** (20 - i % 40), 0.0, 0.0]) for i in range(300)]
    hot = [(i, (np.eye(16)[i % 16] / 2.0 ** (i // 16)).tolist()) for i in range(500)]
    again = [(0, [1.0, 1.0])] * 9 + [(0, [float(2**j), float(2**j)]) for j in range(1, 15)] + [(3, [1.0, 1.0])] * 8 + [(i, [1.0, 1.0]) for i in range(4, 9)]
    far = [(i, [1.0, -float(i)]) for i in range(60, 99)]
    wide = [(i, rng.choice([-1.0, 1.0], size=64).tolist()) for i in range(2000)]
    return {"signs": signs, "scaled": line, "one-hot": hot, "repeated ids": again + far, "64 components": wide}


@pytest.mark.parametrize("name", tied_tables())
def test_ties_go_to_the_smaller_id_however_many(spark, monkeypatch, name):
    monkeypatch.setattr(vptree, "LEAF", 16)
    monkeypatch.setattr(vptree, "PAIRS", 1000)
    rows = tied_tables()[name]
    table = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r)[:3] for r in vptree.nearest(table, F.col("vec_id") % 50 == 0).collect())
    ids, data = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    length = np.sqrt((data * data).sum(axis=1))
    want = []
    for q in sorted({i for i in ids.tolist() if i % 50 == 0}):
        # One row for each of the query's different vectors meets all other rows.
        own = np.unique(data[ids == q], axis=0)
        pairs = [(-s, i) for v in own for s, i in zip((data * v).sum(axis=1) / (np.sqrt((v * v).sum()) * length), ids, strict=True) if i != q]
        want += [(q, r + 1, int(i)) for r, (_, i) in enumerate(sorted(pairs)[:5])]
    assert got == want


def test_pairs_are_cut_to_k_part_by_part(monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 16)
    monkeypatch.setattr(vptree, "PAIRS", 200)
    monkeypatch.setattr(vptree, "COMPONENTS", 800)
    data = np.random.default_rng(5).choice([-1.0, 1.0], size=(900, 10)).astype(np.float32)
    ids = np.random.default_rng(6).permutation(900)
    tree = vptree.VpTree(ids, data, 5)
    query, found, score = tree.nearest(ids[::30], data[::30], 5, 1.0)
    for n, (own, vector) in enumerate(zip(ids[::30], data[::30], strict=True)):
        every = sorted((-s, i) for s, i in zip(vptree._cosine(vector[None], data), ids, strict=True) if i != own)[:5]
        assert [(-s, i) for s, i in zip(score[query == n], found[query == n], strict=True)] == every


def test_components_far_from_one(spark):
    """Vectors whose squares overflow or vanish have the scores of the same vectors near one."""
    rng = np.random.default_rng(7)
    plainly = [(i, v) for i, v in enumerate(rng.normal(size=(120, 6)).tolist())]
    power = [0, 1000, -1000, 600, -700]
    extreme = [(i, [float(np.ldexp(x, power[i // 2 % 5])) for x in v]) for i, v in plainly]
    got, want = (
        vptree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0)
        for rows in (extreme, plainly)
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    tiny = spark.createDataFrame([(0, [5e-324, 0.0]), (1, [1e308, 1e308]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = vptree.nearest(tiny, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 12)) for r in rows] == [(2, 1.0), (1, round(0.5**0.5, 12))]
