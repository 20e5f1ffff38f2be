"""Skew, plan shape and the SQL twins."""

import os

import numpy as np
import pytest
from conftest import day
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_check import check, connect
from seriesloom.operators import cleaning, correlation, demand, horizon, merging, reports
from seriesloom.session import stage_table, staging
from seriesloom.sources.logs import series_from_log

SMALL = "/root/testdata/sf0.001"
MODELS = ("fit", "predict", "forecast_s", "cv_m", "cross", "comp", "eval", "train", "save", "run_", "custom", "forecast")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def hot_log(spark, rows=60_000):
    """A third of the rows carry one key, one user and one day."""
    hot = F.col("id") % 3 == 0
    return spark.range(rows).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 11)).alias("query"),
        F.when(hot, "u0").otherwise(F.concat(F.lit("u"), F.col("id") % 997)).alias("user_id"),
        F.when(hot, F.lit("2024-01-05"))
        .otherwise(F.date_add(F.lit(day("2024-01-01")), (F.col("id") % 30).cast("int")).cast("string"))
        .cast("timestamp_ntz")
        .alias("ts"),
    )


def test_hot_key_is_counted_whole_and_combined_early(spark):
    series = series_from_log(hot_log(spark), F.lit("g"), F.col("query"), "ts")
    assert series.agg(F.sum("y")).first()[0] == 60_000
    assert series.where("series_id = 'hot'").count() == 1
    plan = plan_of(series)
    assert plan.index("partial_count") > plan.index("Exchange"), "no partial count below the shuffle"


def test_hot_user_against_brute_force(spark):
    log = hot_log(spark, 6_000)
    rows = log.toPandas()
    found = demand.related_queries(log, ["hot", "k1"], k=50).where("kind = 'top'").toPandas()
    for word in ("hot", "k1"):
        users = set(rows.loc[rows["query"] == word, "user_id"])
        mine = rows[rows["user_id"].isin(users) & (rows["query"] != word)].groupby("query").size()
        got = found[found["series_id"] == word].set_index("query")["value"]
        assert got.to_dict() == mine.to_dict()


def test_batches_of_many_keys_against_brute_force(spark):
    log = spark.range(4_000).select(
        F.concat(F.lit("w"), F.col("id") % 123).alias("q"),
        F.date_add(F.lit(day("2024-01-01")), (F.col("id") % 9).cast("int")).cast("timestamp_ntz").alias("ts"),
    )
    got = demand.interest_over_time(log, "q", "ts").toPandas()
    names = sorted(got["series_id"].unique())
    want = {name: str(i // 5) for i, name in enumerate(names)}
    assert len(names) == 123 and dict(zip(got["series_id"], got["group_id"])) == want


def test_group_larger_than_a_request(spark):
    wide = spark.range(40 * 25).select(
        F.lit("g").alias("group_id"),
        F.format_string("s%03d", F.col("id") % 25).alias("series_id"),
        F.date_add(F.lit(day("2024-01-01")), (F.col("id") / 25).cast("int")).alias("ds"),
        F.sin(F.col("id") * F.col("id")).alias("y"),
    )
    want = wide.toPandas().pivot(index="ds", columns="series_id", values="y").corr()
    whole = correlation.correlation_matrix(wide).toPandas().pivot(index="a", columns="b", values="corr")
    assert whole.shape == (25, 25) and abs(whole.to_numpy(float) - want.to_numpy()).max() < 1e-9
    cut = correlation.correlation_matrix(wide, size=4).toPandas()
    names = list(want.columns)
    assert len(cut) == 6 * 16 + 1 and all(names.index(a) // 4 == names.index(b) // 4 for a, b in zip(cut["a"], cut["b"]))
    best = correlation.correlation_matrix(wide, size=4, top_k=3).toPandas()
    for name in names:
        own = want[name].drop(name)
        strongest = own.reindex(own.abs().sort_values(ascending=False).index)[:3]
        got = best[best["a"] == name].set_index("b")["corr"]
        assert set(got.index) == set(strongest.index) and abs(got - strongest[got.index]).max() < 1e-9
    rows = correlation.correlation_lower(wide, size=25, order=["s007", "s003"]).toPandas()
    assert len(rows) == 300 and not (rows["a"] == "s007").any()
    assert set(rows.loc[rows["a"] == "s003", "b"]) == {"s007"} and len(rows[rows["b"] == "s007"]) == 24


def test_every_two_series_of_a_large_group_are_correlated(spark):
    wide = spark.range(12 * 150).select(
        F.lit("g").alias("group_id"),
        F.format_string("s%03d", F.col("id") % 150).alias("series_id"),
        F.date_add(F.lit(day("2024-01-01")), (F.col("id") / 150).cast("int")).alias("ds"),
        F.sin(F.col("id") * F.col("id")).alias("y"),
    )
    want = wide.toPandas().pivot(index="ds", columns="series_id", values="y").corr()
    for table in (correlation.correlation_matrix(wide), reports.report_tables(wide)["correlation"]):
        rows = table.toPandas()
        got = rows.pivot(index="a", columns="b", values="corr")
        assert len(rows) == 150 * 150 and abs(got.to_numpy(float) - want.to_numpy()).max() < 1e-9
    order = ["s149", "s070", "s003"]
    place = {name: i for i, name in enumerate([*order, *(n for n in want.columns if n not in order)])}
    lower = correlation.correlation_lower(wide, order=order).toPandas()
    assert len(lower) == len(set(zip(lower["a"], lower["b"]))) == 150 * 149 // 2
    assert all(place[a] > place[b] and abs(c - want.loc[a, b]) < 1e-9 for a, b, c in zip(lower["a"], lower["b"], lower["corr"]))


def waves(spark, series, days):
    """A group of series, some or all of whose values are null or missing: every seventh and every fifth of all."""
    return spark.range(days * series).where("id % 5 <> 3").select(
        F.lit("g").alias("group_id"),
        F.format_string("s%03d", F.col("id") % series).alias("series_id"),
        F.date_add(F.lit(day("2024-01-01")), (F.col("id") / series).cast("int")).alias("ds"),
        F.when(F.col("id") % 7 != 2, F.sin(F.col("id") * F.col("id"))).alias("y"),
    )


def test_strongest_of_a_large_group_sends_a_series_to_few_tasks(spark):
    wide = waves(spark, 203, 16)
    assert correlation.routed(wide, 8, None, True).count() <= 203 * correlation.BLOCKS
    want = wide.toPandas().pivot(index="ds", columns="series_id", values="y").corr(min_periods=2)
    best = correlation.correlation_matrix(wide, size=8, top_k=2).toPandas()
    assert len(best) == 2 * 203 and not (best["a"] == best["b"]).any()
    for name, own in best.groupby("a"):
        sizes = want[name].drop(name).abs().sort_values(ascending=False)[:2]
        assert np.allclose(own["corr"].abs().sort_values(ascending=False), sizes, atol=1e-9, equal_nan=True)


def test_matrix_of_a_large_group_sends_a_series_to_few_tasks(spark):
    wide = waves(spark, 333, 12)
    assert correlation.routed(wide, None, None, True).count() <= 333 * correlation.BLOCKS
    want = wide.toPandas().pivot(index="ds", columns="series_id", values="y").corr(min_periods=2)
    rows = correlation.correlation_matrix(wide).toPandas()
    got = rows.pivot(index="a", columns="b", values="corr")
    assert len(rows) == 333 * 333 and np.allclose(got.to_numpy(float), want.to_numpy(), atol=1e-9, equal_nan=True)
    assert len(correlation.correlation_lower(wide).toPandas()) == 333 * 332 // 2


def test_series_of_many_groups_are_sent_once(spark):
    wide = waves(spark, 599, 12).withColumn("group_id", F.substring("series_id", -1, 1))
    assert correlation.routed(wide, 15, None, True).count() == 599
    want = wide.toPandas()
    rows = correlation.correlation_matrix(wide).toPandas()
    assert len(rows) == 9 * 60 * 60 + 59 * 59
    for name, own in rows.groupby("group_id"):
        corr = want[want["group_id"] == name].pivot(index="ds", columns="series_id", values="y").corr(min_periods=2)
        got = own.pivot(index="a", columns="b", values="corr")
        assert np.allclose(got.to_numpy(float), corr.to_numpy(), atol=1e-9, equal_nan=True)


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = plan_of(demand.trending(hot_log(spark).withColumn("geo", F.lit("US")), "US", bucket="year"))
    assert "TakeOrderedAndProject" in plan
    series = series_from_log(hot_log(spark), F.lit("g"), F.col("query"), "ts")
    assert "WindowGroupLimit" in plan_of(horizon.infer_freq(series)) and "WindowGroupLimit" in plan_of(reports.last_n(series, 5))


def test_no_query_pairs_everything_with_everything(spark):
    for name, run in entry.queries().items():
        if not name.startswith(MODELS):
            plan = plan_of(run(spark, SMALL))
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_grid_costs_one_shuffle_of_rows(spark, tmp_path):
    series = series_from_log(hot_log(spark), F.col("user_id"), F.col("query"), "ts")
    series.write.parquet(str(tmp_path / "t"))
    filled = cleaning.fill_time(merging.complete_grid(spark.read.parquet(str(tmp_path / "t"))))
    filled.count()
    final = plan_of(filled)
    assert "SortMergeJoin" in final or "BroadcastHashJoin" in final


@pytest.fixture
def no_broadcast(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, -1)
    # So small a table would be merged into one partition whatever its distribution.
    merging_name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging_name, "false")
    yield
    for name in [*names, merging_name]:
        spark.conf.unset(name)


@pytest.mark.parametrize("literal", [True, False])
def test_grid_of_one_hot_group_is_many_tasks(spark, no_broadcast, literal):
    rows = spark.range(400 * 50).select(
        (F.lit("g") if literal else F.concat(F.lit("g"), F.col("id") * 0)).alias("group_id"),
        F.concat(F.lit("s"), F.col("id") % 400).alias("series_id"),
        F.date_add(F.lit(day("2024-01-01")), (F.floor(F.col("id") / 400) * 3 + F.col("id") % 3).cast("int")).alias("ds"),
        F.col("id").cast("double").alias("y"),
    )
    filled = cleaning.fill_time(merging.complete_grid(rows))
    assert "CartesianProduct" not in plan_of(filled) and "NestedLoop" not in plan_of(filled)
    dates = rows.select("ds").distinct().count()
    spread = filled.withColumn("task", F.spark_partition_id())
    assert spread.select("task").distinct().count() > 1
    assert filled.count() == 400 * dates and filled.where("y is null").isEmpty()


def test_requests_do_not_depend_on_shared_exchanges(spark):
    log = hot_log(spark, 6_000)
    want = {tuple(r) for r in demand.interest_over_time(log, "user_id", "ts", "month").collect()}
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert {tuple(r) for r in demand.interest_over_time(log, "user_id", "ts", "month").collect()} == want
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    sizes = {}
    for group, series, *_ in want:
        sizes.setdefault(group, set()).add(series)
    assert sorted(map(len, sizes.values()))[1:] == [5] * (len(sizes) - 1)


def test_staged_tables_go_with_their_block(spark):
    with staging(spark):
        staged = stage_table(spark.range(5), "short-lived")
        path = staged.inputFiles()[0].rpartition("/")[0].removeprefix("file:").replace("//", "/")
        assert staged.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:4] == ["group_id", "series_id", "ds", "y"] and not df.isEmpty()


QUICK = ["fill_time", "preprocess_all", "split_sequences", "related_queries", "correlation_matrix", "forecast_recursive"]


@pytest.mark.parametrize("name", QUICK)
def test_sql_twin(spark, name):
    problem, _, rows = check(spark, connect(SMALL), name, entry.queries()[name], entry.oracle_sql()[name], SMALL)
    assert problem is None and rows > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
