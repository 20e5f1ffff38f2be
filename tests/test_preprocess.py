import numpy as np
import pandas as pd
import pytest
from conftest import day, long_frame, series_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.config import DataConfig
from seriesloom.operators import cleaning, features, scaling, splitting, windows
from seriesloom.plans.preprocess import preprocess
from seriesloom.schema import SERIES_SCHEMA

INPUTS = ["year", "month", "day", "day_of_week", "week_of_year", "month_sin", "month_cos", "day_sin", "day_cos"]


def test_fill_at_edges_and_between(spark):
    dates = ["2020-01-01", "2020-01-02", "2020-01-05", "2020-01-09", "2020-01-10"]
    rows = [("g", "s", day(d), v) for d, v in zip(dates, [None, 2.0, None, 9.0, None])]
    rows += [("g", "empty", day(d), None) for d in dates]
    out = cleaning.fill_time(spark.createDataFrame(rows, SERIES_SCHEMA))
    assert series_of(out, "s").tolist() == [2.0, 2.0, 5.0, 9.0, 9.0]
    assert series_of(out, "empty").isna().all()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.floats(-1e3, 1e3)), min_size=1, max_size=25), st.integers(1, 9), st.data())
def test_fill_and_smooth_match_pandas(spark, values, width, data):
    gaps = data.draw(st.lists(st.integers(1, 6), min_size=len(values), max_size=len(values)))
    days = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.cumsum(gaps), unit="D")
    series = pd.Series(values, index=pd.DatetimeIndex(days), dtype=float)
    filled = series.interpolate(method="time", limit_direction="both").ffill().bfill()
    want = filled.rolling(width, center=True, min_periods=1).mean()
    long = long_frame(spark, series.to_frame("s"))
    got = series_of(cleaning.smooth(cleaning.fill_time(long), width), "s").astype(float)
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy(), rtol=1e-9, atol=1e-7)


def test_nan_is_missing(spark, year_long):
    holes = year_long.withColumn("y", F.coalesce("y", F.lit(float("nan"))))
    assert cleaning.missing_count(holes).first()["missing"] == 5
    for step in (cleaning.fill_time, cleaning.drop_missing, cleaning.clean):
        got, want = step(holes), step(year_long)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_causal_smoothing_looks_back_only(spark):
    wide = pd.DataFrame({"s": [1.0, 2.0, 6.0, 8.0]}, index=pd.date_range("2020-01-01", periods=4))
    assert series_of(cleaning.smooth(long_frame(spark, wide), 2, causal=True), "s").tolist() == [1.0, 1.5, 4.0, 7.0]


def test_drop_missing_drops_the_date_for_the_group(spark, year_long):
    out = cleaning.drop_missing(year_long)
    assert out.groupBy("series_id").count().select("count").distinct().collect()[0][0] == 361
    other = year_long.where("series_id = 'keyword2'").withColumn("group_id", F.lit("h"))
    assert cleaning.drop_missing(year_long.unionByName(other)).where("group_id = 'h'").count() == 366


def test_scaling_matches_definition(spark, year_wide):
    wide = year_wide.assign(flat=3.0)
    long = long_frame(spark, wide)
    for method in ("minmax", "standard"):
        table = scaling.fit_scaler(long, method)
        via_table = scaling.apply_scaler(long, table)
        inline = scaling.scale_series(long, method)
        for name in wide:
            x = wide[name]
            if method == "minmax":
                want = (x - x.min()) / ((x.max() - x.min()) or 1.0)
            else:
                want = (x - x.mean()) / (x.std(ddof=0) or 1.0)
            for got in (via_table, inline):
                np.testing.assert_allclose(series_of(got, name).to_numpy(float), want.to_numpy(), atol=1e-9)
        back = scaling.inverse_scale(inline, table)
        np.testing.assert_allclose(series_of(back, "keyword2").to_numpy(), wide["keyword2"].to_numpy(), atol=1e-9)
    for call in (scaling.fit_scaler, scaling.scale_series):
        with pytest.raises(ValueError):
            call(long, "robust")


def test_inverse_scale_leaves_unknown_series_alone(spark, year_long):
    only = scaling.fit_scaler(year_long.where("series_id = 'keyword1'"))
    back = scaling.inverse_scale(year_long, only)
    assert back.where("series_id = 'keyword2'").exceptAll(year_long).isEmpty()


def test_preprocess_leaves_no_nulls(spark, year_long):
    done = preprocess(year_long)
    pdf = done.data.toPandas()
    assert not pdf.isna().any().any() and {"month", "day", "day_of_week"} <= set(pdf.columns)
    assert pdf["y"].between(0, 1).all() and pdf["y_original"].between(0, 1).all()
    assert done.scalers.count() == 4


def test_preprocess_target_columns(spark, year_long):
    done = preprocess(year_long, target="keyword1")
    assert done.data.columns == ["group_id", "series_id", "ds", "y", *INPUTS]
    assert done.data.select("series_id").distinct().collect()[0][0] == "keyword1"
    everything = preprocess(year_long, target="unheard of")
    assert everything.data.count() == 732 and "y_original" in everything.data.columns


def test_preprocess_steps_are_gated(spark, year_long):
    done = preprocess(year_long, DataConfig(normalize=False, smoothing_window=1, interpolate_missing=False))
    assert done.scalers is None and "y_original" not in done.data.columns and done.data.count() == 722


def test_scaler_fitted_on_training_rows(spark):
    wide = pd.DataFrame({"s": np.arange(100.0)}, index=pd.date_range("2020-01-01", periods=100))
    done = preprocess(long_frame(spark, wide), DataConfig(smoothing_window=1, fit_on="train"))
    scaled = series_of(done.data, "s")
    assert scaled.iloc[71] == 1.0 and scaled.iloc[99] > 1.3


def test_one_shuffle(spark, year_long, tmp_path):
    year_long.write.parquet(str(tmp_path / "t"))
    plan = preprocess(spark.read.parquet(str(tmp_path / "t"))).data._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_calendar_matches_pandas(spark):
    days = pd.date_range("2019-12-20", "2021-01-10")
    long = long_frame(spark, pd.DataFrame({"s": 1.0}, index=days))
    got = features.cyclical_features(features.calendar_features(long)).orderBy("ds").toPandas()
    assert got["day_of_week"].tolist() == days.dayofweek.tolist()
    assert got["week_of_year"].tolist() == days.isocalendar().week.tolist()
    np.testing.assert_allclose(got["day_cos"], np.cos(2 * np.pi * days.day / 31), atol=1e-12)
    np.testing.assert_allclose(got["dow_sin"], np.sin(2 * np.pi * days.dayofweek / 7), atol=1e-12)


def test_dow_features_on_request(spark, year_long):
    rows = features.cyclical_features(features.calendar_features(year_long))
    assert features.select_target(rows, "keyword1", include_dow=True).columns[-2:] == ["dow_sin", "dow_cos"]


@pytest.mark.parametrize("length, steps", [(30, 1), (5, 3)])
def test_sequences_match_slices(spark, year_long, length, steps):
    data = preprocess(year_long, target="keyword1").data
    out = windows.make_sequences(data, length, steps).orderBy("ds").toPandas()
    pdf = data.orderBy("ds").toPandas()
    values = pdf[["y", *INPUTS]].to_numpy(np.float32)
    assert len(out) == 366 - length - steps + 1
    for i in (0, 100, len(out) - 1):
        np.testing.assert_array_equal(np.stack(out["x"][i]).astype(np.float32), values[i : i + length])
        want = values[i + length : i + length + steps, 0]
        np.testing.assert_array_equal(np.atleast_1d(np.asarray(out["yt"][i], np.float32)), want)
    with pytest.raises(ValueError):
        windows.make_sequences(data, target="nope")


def test_too_short_for_a_window(spark):
    wide = pd.DataFrame({"s": np.arange(6.0)}, index=pd.date_range("2020-01-01", periods=6))
    rows = features.calendar_features(long_frame(spark, wide))
    assert windows.make_sequences(rows, 5, 1).count() == 1 and windows.make_sequences(rows, 5, 2).isEmpty()


def test_split_is_a_partition_in_order(spark, year_long):
    out = splitting.temporal_split(year_long).where("series_id = 'keyword1'").orderBy("ds").toPandas()
    t = int(366 * (1 - 0.2))
    v = int(t * (1 - 0.1))
    assert out["split"].tolist() == ["train"] * v + ["val"] * (t - v) + ["test"] * (366 - t)


def test_windows_stay_inside_their_split(spark, year_long):
    split_df = splitting.temporal_split(preprocess(year_long, target="keyword1").data)
    out = windows.split_sequences(split_df).groupBy("split").count().collect()
    # 292 rows are not test: 262 train and 30 val, too few for a window of 30.
    assert {r["split"]: r["count"] for r in out} == {"train": 185, "val": 47, "test": 44}
    lengths = windows.adaptive_length(split_df).first()
    assert (lengths["n_train"], lengths["length"]) == (262, 30)


def test_short_series_is_padded(spark):
    wide = pd.DataFrame({"s": np.arange(1.0, 41.0)}, index=pd.date_range("2020-01-01", periods=40))
    rows = splitting.temporal_split(features.calendar_features(long_frame(spark, wide)))
    first = windows.split_sequences(rows, features=["y", "day"]).where("split = 'train'").orderBy("ds").first()
    assert first["length"] == 7 and len(first["x"]) == 60
    assert first["x"][0::2] == [0.0] * 23 + [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0] and first["yt"] == 8.0
