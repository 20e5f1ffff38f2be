"""Series finer than a day, cut into pieces, against the same work on whole series in one process."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.config import ModelConfig
from seriesloom.models import additive, fine as fine_models, map_fit
from seriesloom.operators import fine

KINDS = ("timestamp", "timestamp_ntz")


def hourly(rng, count, holes=0.2, gap=(0, 0)):
    """Values at uneven times, some missing, with one long gap."""
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 4, count)), unit="h")
    hours = (at - at[0]) / pd.Timedelta(hours=1)
    y = 10 + hours / 500 + 3 * np.sin(2 * np.pi * hours / 24) + rng.normal(0, 0.3, count)
    y = np.where(rng.random(count) < holes, np.nan, y)
    y[gap[0] : gap[1]] = np.nan
    return pd.Series(y, index=at)


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(5)
    one, two = hourly(rng, 900, gap=(100, 420)), hourly(rng, 333)
    two.iloc[:70] = np.nan
    two.iloc[-40:] = np.nan
    empty = hourly(rng, 130, holes=1.1)
    return {"one": one, "two": two, "empty": empty, "single": one[:1], "short": one[430:450]}


def table(spark, wide, kind="timestamp_ntz"):
    frame = pd.concat([pd.DataFrame({"group_id": "g", "series_id": k, "ds": s.index, "y": s.to_numpy()}) for k, s in wide.items()])
    rows = spark.createDataFrame(frame.sample(frac=1, random_state=1), f"group_id string, series_id string, ds {kind}, y double")
    return rows.repartition(5)


def series(df, name, column="y"):
    rows = df.where(F.col("series_id") == name).orderBy("ds").toPandas()
    return pd.Series(rows[column].to_numpy(), index=pd.DatetimeIndex(rows["ds"]))


@pytest.mark.parametrize("kind", KINDS)
def test_numbers_and_halos(spark, wide, kind):
    cut = fine.cut_series(table(spark, wide, kind), 64)
    placed = cut.where("series_id = 'one'").orderBy("ds").toPandas()
    assert placed["at"].tolist() == list(range(900)) and (placed["piece"] == placed["at"] // 64).all()
    halo = fine.with_halo(cut, 7, 5).where("series_id = 'one'").toPandas()
    for home, rows in halo.groupby("home"):
        own = sorted(rows.loc[rows["own"], "at"])
        low, high = int(home) * 64, min(900, int(home) * 64 + 64)
        assert own == list(range(low, high))
        assert sorted(rows["at"]) == list(range(max(0, low - 7), min(900, high + 5)))
    with pytest.raises(ValueError, match="shorter than a frame"):
        fine.with_halo(cut, 65, 0)
    with pytest.raises(ValueError, match="timestamp"):
        fine.cut_series(table(spark, wide).withColumn("ds", F.to_date("ds")))


@pytest.mark.parametrize("size", [16, 64, 10_000])
def test_filled_and_smoothed_as_whole_series(spark, wide, size):
    cut = fine.cut_series(table(spark, wide), size)
    filled = fine.fill_time(cut)
    assert filled.columns == cut.columns and filled.count() == sum(map(len, wide.values()))
    for causal, window in ((False, 7), (False, 8), (True, 12)):
        smoothed = fine.uncut(fine.smooth(filled, window, causal))
        assert smoothed.columns == ["group_id", "series_id", "ds", "y", "y_original"]
        for name, own in wide.items():
            want = own.interpolate("time", limit_area="inside").ffill().bfill()
            np.testing.assert_allclose(series(smoothed, name, "y_original"), want, rtol=1e-12)
            ahead = 0 if causal else (window - 1) // 2
            moved = [want.iloc[max(0, i - window + 1 + ahead) : i + ahead + 1].mean() for i in range(len(want))]
            np.testing.assert_allclose(series(smoothed, name), moved, rtol=1e-12)


def test_windows_as_of_whole_series(spark, wide):
    filled = fine.fill_time(fine.cut_series(table(spark, wide), 32)).where("series_id <> 'empty'")
    got = fine.make_sequences(filled.withColumn("hour", F.hour("ds")), 30, 4, features=["y", "hour"])
    for name in ("one", "two", "short"):
        own = wide[name].interpolate("time", limit_area="inside").ffill().bfill()
        rows = got.where(F.col("series_id") == name).orderBy("ds").collect()
        assert [r["ds"] for r in rows] == [t.to_pydatetime() for t in own.index[30 : max(30, len(own) - 3)]]
        cells = np.stack([own.to_numpy(np.float32), own.index.hour.to_numpy(np.float32)], axis=1)
        for i, r in enumerate(rows):
            assert np.allclose(r["x"], cells[i : i + 30]) and np.allclose(r["yt"], cells[i + 30 : i + 34, 0])
    one = fine.make_sequences(filled, 30)
    assert one.schema["yt"].dataType.simpleString() == "float"
    with pytest.raises(ValueError, match="No column"):
        fine.make_sequences(filled, target="nothing")


@pytest.mark.parametrize("period", [24, 7])
def test_decomposed_as_whole_series(spark, wide, period):
    filled = fine.fill_time(fine.cut_series(table(spark, wide), 40))
    got = fine.seasonal_decompose(filled, period)
    status = {r["series_id"]: r["status"] for r in got.select("series_id", "status").distinct().collect()}
    assert status == {"one": "ok", "two": "ok", "empty": "missing values", "single": "too short", "short": "ok" if period == 7 else "too short"}
    for name in ("one", "two"):
        own = wide[name].interpolate("time", limit_area="inside").ffill().bfill().to_numpy()
        half = period // 2
        weights = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
        trend = np.full(len(own), np.nan)
        trend[half : len(own) - half] = np.convolve(own, weights, "valid")
        level = np.array([np.nanmean((own - trend)[p::period]) for p in range(period)])
        seasonal = np.resize(level - level.mean(), len(own))
        np.testing.assert_allclose(series(got, name, "trend"), trend, rtol=1e-10)
        np.testing.assert_allclose(series(got, name, "seasonal"), seasonal, atol=1e-9)
        np.testing.assert_allclose(series(got, name, "resid"), own - trend - seasonal, atol=1e-9)


def test_fit_of_pieces_equals_the_fit_of_the_whole(spark, wide):
    config = ModelConfig(yearly_seasonality=False, daily_seasonality=True, n_changepoints=6)
    doubled = table(spark, wide).unionByName(table(spark, {"one": wide["one"][:50] + 1}))
    models = fine_models.fit_additive(doubled, config, size=50)
    by_name = {r["series_id"]: r for r in models.collect()}
    # A series without a value has no rows to fit, as in the daily model.
    assert set(by_name) == {"one", "two", "single", "short"} and "two times" in by_name["single"]["error"]
    own = pd.concat([wide["one"], wide["one"][:50] + 1]).dropna().groupby(level=0).agg(["mean", "count", lambda v: v.var(ddof=0) * len(v)])
    days = ((own.index - pd.Timestamp("1970-01-01")) / pd.Timedelta(days=1)).to_numpy()
    t0 = np.floor(days[0])
    span = days[-1] - t0
    t = (days - t0) / span
    bends = map_fit.place_changepoints(t, 6, 0.8)
    scale = own["mean"].abs().max()
    terms = map_fit.terms_of(config)
    ridge = map_fit.Ridge.of(map_fit.additive_design(days, t, bends, terms), own["mean"].to_numpy() / scale, own["count"].to_numpy(float))
    want = map_fit.fit_summed(ridge, own["count"].sum(), own.iloc[:, 2].sum() / scale**2, bends, terms, config)
    got = by_name["one"]
    assert got["n_obs"] == want["n_obs"] and got["error"] is None and got["last_ds"] == own.index[-1].to_pydatetime()
    for name in ("k", "m", "sigma", "changepoints", "deltas"):
        np.testing.assert_allclose(got[name], want[name], rtol=1e-5, atol=1e-6)
    for mine, theirs in zip(got["terms"], want["terms"], strict=True):
        assert mine["name"] == theirs["name"]
        np.testing.assert_allclose(mine["coef"], theirs["coef"], atol=1e-6)


def test_daily_component_is_recovered(spark):
    at = pd.date_range("2024-01-01", periods=24 * 90, freq="h")
    hours = np.arange(len(at))
    noise = np.random.default_rng(2).normal(0, 0.2, len(at))
    y = pd.Series(20 + hours / 400 + 5 * np.sin(2 * np.pi * hours / 24) + noise, index=at)
    rows = table(spark, {"s": y})
    models = fine_models.fit_additive(rows, ModelConfig(yearly_seasonality=False, daily_seasonality=True), size=300).cache()
    parts = additive.components(models, rows, ("weekly", "daily"))
    np.testing.assert_allclose(series(parts, "s", "daily"), 5 * np.sin(2 * np.pi * hours / 24), atol=0.1)
    assert series(parts, "s", "weekly").abs().max() < 0.15
    ahead = additive.predict_dates(models, fine_models.horizon_times(models, 48))
    path = series(ahead, "s", "yhat")
    later = np.arange(len(at), len(at) + 48)
    assert path.index[0] == at[-1] + pd.Timedelta(hours=1)
    np.testing.assert_allclose(path, 20 + later / 400 + 5 * np.sin(2 * np.pi * later / 24), atol=0.6)
    with pytest.raises(ValueError, match="additive seasons"):
        fine_models.fit_additive(rows, ModelConfig(daily_seasonality=True, seasonality_mode="multiplicative"))
    assert fine_models.fit_additive(rows.where("y < 0"), ModelConfig(daily_seasonality=True)).count() == 0


def test_one_series_spreads_over_tasks(spark):
    rows = spark.range(200_000).select(
        F.lit("g").alias("group_id"), F.lit("s").alias("series_id"),
        F.expr("timestamp_ntz'2000-01-01' + make_dt_interval(0, cast(id as int))").alias("ds"),
        F.when(F.col("id") % 7 > 0, F.sin("id")).alias("y"),
    )
    filled = fine.fill_time(fine.cut_series(rows, 4096))
    sizes = filled.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 200_000 and len(sizes) > 1 and max(r["count"] for r in sizes) < 150_000
    assert filled.agg(F.max("piece"), F.count_if(F.col("y").isNull())).first()[:] == (48, 0)
