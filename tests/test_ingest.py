import datetime as dt

import pandas as pd
import pytest
from conftest import day, long_frame, series_of
from pyspark.sql import functions as F

from seriesloom.config import DataConfig, ModelConfig
from seriesloom.models import additive
from seriesloom.operators import cleaning, decomposition, demand, merging, selection, windows
from seriesloom.plans.preprocess import preprocess
from seriesloom.sources import extracts, processed, results
from seriesloom.sources.logs import normalize_geo


def test_wide_and_long(spark, year_wide, year_long):
    wide = extracts.to_wide(year_long, ["keyword1", "keyword2"])
    back = extracts.to_long(wide, ["keyword1", "keyword2"], "g", index="ds")
    assert back.exceptAll(year_long).isEmpty() and year_long.exceptAll(back).isEmpty()


def test_keyword_names_are_data(spark):
    odd = pd.DataFrame({"day_x": [1.0, 2.0], "a.b `c`": [3.0, 4.0]}, index=pd.date_range("2020-01-01", periods=2))
    long = long_frame(spark, odd)
    names = list(odd.columns)
    back = extracts.to_long(extracts.to_wide(long, names), names, "g", index="ds")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, long.collect()))


def test_csv_extract_keeps_text_until_cleaned(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,kw,isPartial\n2020-01-01,<1,False\n2020-01-02,7,False\n2020-01-03,,True\n")
    schema = extracts.wide_schema(["kw"], kind="string")
    landed = extracts.read_trends(spark, str(tmp_path), "csv", schema)
    long = extracts.to_long(cleaning.drop_partial(landed), ["kw"], "g", kind="string")
    assert series_of(cleaning.clean(long), "kw").tolist() == [0.0, 7.0, 0.0]
    plain = long.withColumn("y", F.col("y").try_cast("double"))
    assert plain.where("y is null").count() == 2


def test_drop_partial_keeps_rows(spark):
    df = spark.createDataFrame([(1, True), (None, False)], "y int, isPartial boolean")
    out = cleaning.drop_partial(df)
    assert out.columns == ["y"] and out.count() == 2


def test_geo_default_and_worldwide(spark):
    df = spark.createDataFrame([("", 1), ("US", 2)], "geo string, y int")
    assert [r.y for r in selection.filter_geo(df).collect()] == [1]
    assert [r.y for r in selection.filter_geo(df, "US").collect()] == [2]
    assert [r.y for r in selection.filter_geo(df, None, DataConfig(geo="US")).collect()] == [2]
    assert [r.y for r in selection.filter_geo(df, "", DataConfig(geo="US")).collect()] == [1]


def test_timeframe_includes_the_last_day_of_timestamps(spark):
    df = spark.sql("select timestamp_ntz'2020-01-31 23:59:59' ts union all select timestamp_ntz'2020-02-01 00:00:00'")
    assert selection.filter_timeframe(df, "2020-01-01 2020-01-31", column="ts").count() == 1


def test_timeframe_reaches_the_scan(spark, tmp_path):
    long = spark.createDataFrame([("g", "s", day("2020-01-01"), 1.0)], "group_id string, series_id string, ds date, y double")
    long.write.parquet(str(tmp_path / "t"))
    kept = selection.filter_timeframe(spark.read.parquet(str(tmp_path / "t")), "2020-01-01 2020-02-01")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ds" in plan and "LessThanOrEqual(ds" in plan


def test_first_period_wins_even_with_a_null(spark):
    days = pd.date_range("2020-01-01", periods=3)
    early = long_frame(spark, pd.DataFrame({"a": [1.0, None]}, index=days[:2]))
    late = long_frame(spark, pd.DataFrame({"a": [9.0, 5.0]}, index=days[1:]))
    merged = series_of(merging.merge_periods([early, late]), "a")
    assert merged.tolist()[0::2] == [1.0, 5.0] and pd.isna(merged.iloc[1])
    with pytest.raises(ValueError):
        merging.merge_periods([])


def test_periods_that_never_landed_are_skipped(spark, year_long, tmp_path):
    year_long.write.parquet(str(tmp_path / "p1"))
    found = extracts.read_periods(spark, [str(tmp_path / "p0"), str(tmp_path / "p1")], "parquet")
    assert len(found) == 1 and merging.merge_periods(found).count() == 732


def test_finer_than_a_day_is_refused(spark):
    df = spark.sql("select 'g' group_id, 's' series_id, timestamp_ntz'2020-01-01 10:00:00' ds, 1d y")
    for use in (merging.complete_grid, cleaning.fill_time):
        with pytest.raises(ValueError, match="date"):
            use(df)


def test_batches_meet_on_the_date(spark):
    first = pd.DataFrame({"a": [1.0, 2.0]}, index=pd.date_range("2020-01-01", periods=2))
    second = pd.DataFrame({"b": [3.0, 4.0]}, index=pd.date_range("2020-01-02", periods=2))
    merged = merging.merge_batches([long_frame(spark, first, "x"), long_frame(spark, second, "y")], "all")
    want = pd.concat([first, second], axis=1)
    for name in want:
        pd.testing.assert_series_equal(series_of(merged, name), want[name], check_names=False, check_freq=False)


def test_wide_batches_meet_on_the_date(spark):
    first = spark.sql("select date'2020-01-01' `date`, 1d `a.b`, 2d w union all select date'2020-01-02', null, 3d union all select null, 9d, 9d")
    second = spark.sql("select 7L W, date'2020-01-02' `date`, 'x' c union all select null, date'2020-01-03', 'y'")
    rows = merging.merge_wide([first, second]).orderBy("date").collect()
    assert merging.merge_wide([first, second]).columns == ["date", "a.b", "w", "W_2", "c"]
    assert [tuple(r)[1:] for r in rows] == [(1.0, 2.0, None, None), (None, 3.0, 7, "x"), (None, None, None, "y")]
    assert merging.merge_wide([first.limit(0), second]).count() == 2
    three = merging.merge_wide([second, second, second])
    assert three.columns == ["date", "W", "c", "W_2", "c_2", "W_3", "c_3"] and three.count() == 2
    plan = three._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    with pytest.raises(Exception, match="this date twice"):
        merging.merge_wide([second.unionByName(second)]).collect()
    with pytest.raises(ValueError):
        merging.merge_wide([])


def test_request_size():
    assert merging.check_request(list("abcde")) == list("abcde")
    assert merging.check_request(list("abcdef"), 6) == list("abcdef")
    with pytest.raises(ValueError):
        merging.check_request(list("abcdef"))
    assert merging.split_keywords(" a, b ,,c") == ["a", "b", "c"]


def test_batch_size_is_honoured(spark):
    words = spark.range(12).select(F.col("id").alias("ordinal"))
    assert [r.batch for r in merging.batch_keywords(words, 9).orderBy("ordinal").collect()] == [0] * 9 + [1] * 3
    assert [r.batch for r in merging.batch_keywords(words).orderBy("ordinal").collect()] == [0] * 5 + [1] * 5 + [2] * 2
    with pytest.raises(ValueError):
        merging.batch_keywords(words, 0)


def test_raw_and_processed_round_trip(spark, year_long, tmp_path):
    extracts.write_raw(year_long, str(tmp_path / "raw"), "today 12-m", "KR", "csv")
    about = spark.read.json(str(tmp_path / "raw/metadata")).first()
    assert (about.geo, about.timeframe, about.n_dates, about.n_keywords) == ("KR", "today 12-m", 366, 2)

    assert spark.read.json(str(tmp_path / "raw/keywords")).count() == 2

    done = preprocess(year_long)
    processed.write_processed(done.data, done.scalers, str(tmp_path / "p"))
    data, scalers = processed.read_processed(spark, str(tmp_path / "p"))
    assert data.count() == 732 and scalers.count() == 4
    assert processed.read_processed(spark, str(tmp_path / "p"), with_scalers=False)[1] is None
    about = spark.read.json(str(tmp_path / "p/metadata")).first()
    assert about.scalers == ["y", "y_original"] and about.config.smoothing_window == 7

    processed.write_processed(year_long, None, str(tmp_path / "bare"))
    assert processed.read_processed(spark, str(tmp_path / "bare"))[1] is None


def test_buckets_are_read_without_a_shuffle(spark, year_long, tmp_path):
    path = str(tmp_path / "it's here")
    full = cleaning.fill_time(year_long)
    processed.write_processed(full, None, path, buckets=6)
    data, _ = processed.read_processed(spark, path)
    assert data.count() == 732 and len(list((tmp_path / "it's here/data").glob("*.parquet"))) <= 6
    uses = {
        "windows": lambda df: windows.make_sequences(df, 5),
        "decomposition": lambda df: decomposition.seasonal_decompose(df, 7),
        "fit": lambda df: additive.fit_additive(df, ModelConfig(n_changepoints=2), spread=False),
    }
    for use in uses.values():
        got = use(data)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, use(full).collect()))
    # Written anew with another number, and plain again: readers go by what lies there.
    processed.write_processed(full.where("series_id = 'keyword1'"), None, path, buckets=3)
    assert processed.read_processed(spark, path)[0].count() == 366
    processed.write_processed(full, None, path)
    plain, _ = processed.read_processed(spark, path)
    assert plain.count() == 732
    assert "Exchange" in windows.make_sequences(plain, 5)._jdf.queryExecution().executedPlan().toString()


def searches(spark):
    start = dt.datetime(2024, 1, 1)
    log = [
        ("u1", "tea", 0), ("u1", "cake", 1), ("u1", "cake", 9), ("u1", "milk", 1),
        ("u2", "tea", 2), ("u2", "milk", 3), ("u3", "milk", 10), ("u4", "lone", 4),
    ]
    rows = [(u, q, start + dt.timedelta(days=d), "US" if u != "u3" else "GB") for u, q, d in log]
    return spark.createDataFrame(rows, "user_id string, query string, ts timestamp_ntz, geo string")


def test_related_queries(spark):
    found = demand.related_queries(searches(spark), ["tea", "nobody"]).collect()
    top = {r["query"]: r["value"] for r in found if r["kind"] == "top"}
    rising = {r["query"]: r["value"] for r in found if r["kind"] == "rising"}
    assert top == {"cake": 2, "milk": 2}
    assert rising == {"cake": 0, "milk": -100}
    assert {r["series_id"] for r in found} == {"tea"}
    assert demand.related_queries(searches(spark).limit(0), ["tea"]).isEmpty()
    assert demand.related_queries(searches(spark), ["lone"]).isEmpty()
    many = ["tea", "milk", "cake", "lone", "x", "y", "z"]
    assert {r["series_id"] for r in demand.related_queries(searches(spark), many).collect()} == {"tea", "milk", "cake"}


def test_landed_related_queries(spark):
    landed = spark.createDataFrame(
        [("tea", "top", "a", 5), ("tea", "top", "b", 9), ("tea", "rising", "c", 1), ("tea", "other", "d", 1)],
        "series_id string, kind string, query string, value long",
    )
    out = {(r["kind"], r["query"]) for r in demand.landed_related_queries(landed, "tea", 1).collect()}
    assert out == {("top", "b"), ("rising", "c")}
    assert demand.landed_related_queries(landed, "unknown").isEmpty()


def test_trending(spark):
    out = demand.trending(searches(spark), "us").collect()
    assert [(r["query"], r["n"], r["rank"]) for r in out] == [("cake", 1, 1)]
    assert demand.trending(searches(spark), "FR").isEmpty() and demand.trending(searches(spark), "").isEmpty()
    mixed = normalize_geo(searches(spark).withColumn("geo", F.when(F.col("query") == "milk", " us ").otherwise("Us")))
    found = demand.trending(mixed, "uS", bucket="year").collect()
    assert [(r["geo"], r["query"], r["n"], r["rank"]) for r in found] == [
        ("US", "milk", 3, 1), ("US", "cake", 2, 2), ("US", "tea", 2, 3), ("US", "lone", 1, 4)
    ]


def test_interest_peaks_at_100_per_request(spark):
    log = spark.range(700).select(
        F.format_string("k%02d", F.col("id") % 7).alias("q"),
        F.expr("date_add(date'2024-01-01', cast(id % 3 as int))").cast("timestamp_ntz").alias("ts"),
    )
    out = demand.interest_over_time(log, "q", "ts").toPandas()
    assert sorted(out.groupby("group_id")["series_id"].nunique()) == [2, 5]
    assert out.groupby("group_id")["y"].max().tolist() == [100.0, 100.0]
    own = demand.interest_over_time(log.withColumn("g", F.lit("one")), "q", "ts", group="g").toPandas()
    assert own["group_id"].unique().tolist() == ["one"] and own["y"].max() == 100.0


def test_predictions_align_and_summary_skips_nan(spark):
    rows = [("g", "s", "a", day("2020-01-01"), 1.0), ("g", "s", "b", day("2020-01-02"), 2.0)]
    forecasts = spark.createDataFrame(rows, "group_id string, series_id string, model string, ds date, yhat double")
    wide = results.predictions_wide(forecasts, ["a", "b"]).orderBy("ds").collect()
    assert [(r.a, r.b) for r in wide] == [(1.0, None), (None, 2.0)]
    raw = spark.createDataFrame([("g", "s", day("2019-01-01"), 1.0)], "group_id string, series_id string, ds date, y double")
    scored = spark.createDataFrame(
        [("g", "s", "a", "mae", 1.5), ("g", "s", "a", "mape", float("nan"))],
        "group_id string, series_id string, model string, metric string, value double",
    )
    summary = results.results_summary(raw, scored, forecasts).first()
    assert summary.metrics == {"a.mae": 1.5} and summary.models == ["a"] and summary.prediction_periods == 2
