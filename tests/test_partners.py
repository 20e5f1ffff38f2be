"""Partners of a series found without comparing all blocks are those of all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import long_frame

from seriesloom.operators import partners


def families(seed=3, count=6, each=25, days=80):
    """Series in families that follow a wave of their own."""
    rng = np.random.default_rng(seed)
    at = pd.date_range("2021-01-01", periods=days)
    waves = rng.normal(size=(count, days))
    sign = rng.choice([-1, 1], size=(count * each))
    values = {
        f"s{i:03d}": 1000 + 5 * sign[i] * (waves[i % count] + 0.1 * rng.normal(size=days)) for i in range(count * each)
    }
    return pd.DataFrame(values, index=at)


def expected(wide, k):
    rows = set()
    with np.errstate(invalid="ignore", divide="ignore"):
        table = wide.corr(min_periods=2)
    for a in table:
        own = table[a].drop(a).dropna()
        best = sorted(own.items(), key=lambda x: (-abs(x[1]), x[0]))[:k]
        rows |= {(a, b, round(c, 9)) for b, c in best}
    return rows


def found(df):
    return {(r["a"], r["b"], round(r["corr"], 9)) for r in df.collect()}


def test_equal_to_all_pairs_and_skips_blocks(spark):
    wide = families()
    long = long_frame(spark, wide)
    assert found(partners.strongest_partners(long, 5, size=8, pivots=12)) == expected(wide, 5)
    pairs = partners.block_pairs(partners.measured_blocks(long, 5, 8, 12)).toPandas()
    blocks = pairs["j"].max() + 1
    assert len(pairs) == blocks * (blocks + 1) // 2
    assert pairs["needed"].mean() < 0.5


def test_noise_and_few_pivots_stay_exact(spark):
    rng = np.random.default_rng(5)
    wide = pd.DataFrame(rng.normal(size=(12, 40)), index=pd.date_range("2021-01-01", periods=12))
    wide.columns = [f"n{i}" for i in range(40)]
    assert found(partners.strongest_partners(long_frame(spark, wide), 3, size=4, pivots=2)) == expected(wide, 3)


def test_gaps_flat_series_and_groups(spark):
    wide = families(seed=9, count=3, each=8, days=40)
    wide.iloc[3:9, 2] = np.nan
    wide.iloc[20:, 5] = np.nan
    wide["flat"] = 4.0
    wide["short"] = np.nan
    wide.iloc[0, -1] = 1.0
    wide["early"], wide["late"] = np.nan, np.nan
    wide.iloc[:5, -2], wide.iloc[36:, -1] = [1.0, 2.0, 0.0, 5.0, 3.0], [2.0, 1.0, 4.0, 3.0]
    other = families(seed=11, count=2, each=3, days=30)
    both = long_frame(spark, wide, "g").unionByName(long_frame(spark, other, "h"))
    both = both.unionByName(long_frame(spark, other[["s000"]], "alone"))
    got = partners.strongest_partners(both, 4, size=5, pivots=4)
    kept = wide.drop(columns=["flat", "short"])
    assert found(got.where("group_id = 'g'")) == expected(kept, 4)
    assert got.where("group_id = 'alone' or corr is null or isnan(corr)").isEmpty()
    assert found(got.where("group_id = 'h'")) == expected(other, 4)


def test_runs_of_blocks_of_series_with_gaps(spark):
    wide = families(seed=13, count=4, each=40, days=40)
    rng = np.random.default_rng(17)
    for i in range(0, 160, 2):
        wide.iloc[rng.integers(0, 40, 5), i] = np.nan
    long = long_frame(spark, wide)
    runs = partners._runs(partners.measured_blocks(long, 1, 4, 4)).select("block", "run").toPandas()
    # A task compares runs of blocks: a block goes to a few tasks, not to one for each other block.
    assert runs["block"].nunique() >= 40 and 1 < runs["run"].nunique() <= 4
    assert found(partners.strongest_partners(long, 1, size=4, pivots=4)) == expected(wide, 1)


def test_rows_that_come_twice(spark):
    wide = families(seed=19, count=2, each=6, days=20)
    wide.iloc[4:7, 3] = np.nan
    long = long_frame(spark, wide).where("y is not null")
    assert found(partners.strongest_partners(long.unionByName(long), 2, size=4, pivots=2)) == expected(wide, 2)


def test_ties_go_by_name(spark):
    day = pd.date_range("2021-01-01", periods=6)
    base = np.array([1.0, 2.0, 4.0, 1.0, 0.0, 3.0])
    wide = pd.DataFrame({name: base * scale for name, scale in zip("dcbae", (1, 2, -1, 4, 8))}, index=day)
    rows = partners.strongest_partners(long_frame(spark, wide), 2, size=2, pivots=1, digits=6).collect()
    assert {(r["a"], r["b"]) for r in rows} == {
        ("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("e", "a"), ("e", "b")
    }


@pytest.mark.parametrize("rows", [[], [("g", "one", 1.0)]])
def test_nothing_to_compare(spark, rows):
    df = spark.createDataFrame(rows, "group_id string, series_id string, y double").selectExpr("*", "date'2021-01-01' ds")
    assert partners.strongest_partners(df, 3).isEmpty()
