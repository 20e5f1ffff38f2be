import numpy as np
import pandas as pd
import pytest
from conftest import day, long_frame, series_of
from pyspark.sql import functions as F

from seriesloom.config import DataConfig, ModelConfig
from seriesloom.models import additive, map_fit, sequence, store
from seriesloom.operators import horizon, windows
from seriesloom.operators.splitting import temporal_split
from seriesloom.plans import forecasting
from seriesloom.plans.preprocess import preprocess

SPLIT = "2023-06-01"


def days_of(series: pd.Series) -> np.ndarray:
    return (series.index - pd.Timestamp("1970-01-01")).days.to_numpy()


def log_posterior(params: dict, days, y, config) -> float:
    level, share, extra = map_fit.evaluate(params, days)
    error = y / params["y_scale"] - (level * (1 + share) + extra)
    s = params["sigma"]
    coefs = np.concatenate([t["coef"] for t in params["terms"]])
    return -(
        error @ error / (2 * s * s)
        + len(y) * np.log(s)
        + (params["k"] ** 2 + params["m"] ** 2) / (2 * map_fit.GROWTH_PRIOR**2)
        + np.abs(params["deltas"]).sum() / config.changepoint_prior_scale
        + coefs @ coefs / (2 * config.seasonality_prior_scale**2)
        + s * s / (2 * map_fit.NOISE_PRIOR**2)
    )


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_fit_is_a_maximum(four_years, mode):
    config = ModelConfig(seasonality_mode=mode)
    days, y = days_of(four_years), four_years.to_numpy()
    params = map_fit.fit_map(days, y, np.ones(len(y)), 0.0, config)
    best, rng = log_posterior(params, days, y, config), np.random.default_rng(0)
    for size in (1e-2, 1e-3, 1e-4):
        for _ in range(40):
            moved = dict(params)
            moved["k"] += rng.normal(0, size)
            moved["m"] += rng.normal(0, size)
            moved["sigma"] *= np.exp(rng.normal(0, size))
            moved["deltas"] = list(np.asarray(params["deltas"]) + rng.normal(0, size, len(params["deltas"])))
            moved["terms"] = [
                {**t, "coef": list(np.asarray(t["coef"]) + rng.normal(0, size, len(t["coef"])))} for t in params["terms"]
            ]
            assert log_posterior(moved, days, y, config) <= best + 0.05


def test_repeated_dates_count_as_observations(four_years):
    config = ModelConfig()
    days, y = days_of(four_years), four_years.to_numpy()
    other = y + np.random.default_rng(1).normal(0, 3, len(y))
    mean, spread = (y + other) / 2, ((y - other) ** 2 / 2).sum()
    merged = map_fit.fit_map(days, mean, np.full(len(y), 2.0), spread, config)
    # The same history given as twice as many rows, with its own changepoints.
    both = np.concatenate([y, other])
    error = both - np.tile(sum_of(merged, days), 2)
    assert np.isclose(merged["sigma"] * merged["y_scale"], error.std(), rtol=1e-2)
    assert merged["n_obs"] == 2 * len(y)


def sum_of(params, days):
    level, share, extra = map_fit.evaluate(params, days)
    return (level * (1 + share) + extra) * params["y_scale"]


def test_changepoint_is_found():
    t = np.arange(800)
    y = np.where(t < 400, t, 400 - 0.5 * (t - 400)) + np.random.default_rng(2).normal(0, 2, 800)
    config = ModelConfig(yearly_seasonality=False, weekly_seasonality=False)
    params = map_fit.fit_map(t, y, np.ones(800), 0.0, config)
    slopes = np.diff(sum_of(params, t))
    assert abs(slopes[100] - 1) < 0.05 and abs(slopes[-50] + 0.5) < 0.05


@pytest.fixture(scope="module")
def fitted(spark, four_years):
    long = long_frame(spark, four_years.to_frame("s"))
    train = long.where(F.col("ds") < SPLIT)
    return long, additive.fit_additive(train).cache()


def test_recovers_trend_and_season(fitted, four_years):
    long, models = fitted
    test = long.where(F.col("ds") >= SPLIT)
    ahead = additive.predict_interval(models, test).toPandas().sort_values("ds")
    actual = four_years[SPLIT:].to_numpy()
    assert np.sqrt(np.mean((ahead["yhat"] - actual) ** 2)) < 6
    inside = (actual >= ahead["yhat_lower"]) & (actual <= ahead["yhat_upper"])
    assert 0.88 <= inside.mean() <= 1.0


def test_column_expression_equals_numpy(fitted, four_years):
    long, models = fitted
    params = models.first().asDict(recursive=True)
    params["t0"] = (params["t0"] - day("1970-01-01")).days
    got = series_of(additive.predict_dates(models, long), "s", "yhat").to_numpy()
    np.testing.assert_allclose(got, sum_of(params, days_of(four_years)), rtol=1e-9)
    parts = additive.components(models, long).toPandas()
    whole = parts[["trend", "yearly", "weekly"]].sum(axis=1)
    np.testing.assert_allclose(np.sort(whole), np.sort(got), rtol=1e-9)


def test_multiplicative_components_are_shares(spark, four_years):
    long = long_frame(spark, four_years.to_frame("s"))
    models = additive.fit_additive(long, ModelConfig(seasonality_mode="multiplicative"))
    parts = additive.components(models, long).orderBy("ds").toPandas()
    got = series_of(additive.predict_dates(models, long), "s", "yhat").to_numpy()
    np.testing.assert_allclose(parts["trend"] * (1 + parts["yearly"] + parts["weekly"]), got, rtol=1e-9)
    assert parts["yearly"].abs().max() < 0.2


def test_fit_tells_whether_it_settled(spark, four_years):
    long = long_frame(spark, four_years.to_frame("s"))
    done = additive.fit_additive(long).first()
    hasty = additive.fit_additive(long, ModelConfig(fit_rounds=2)).first()
    assert done["converged"] and done["passes"] == 1 and not hasty["converged"]


def test_custom_seasonality(spark):
    days = pd.date_range("2020-01-01", periods=600)
    y = 10 + 3 * np.sin(2 * np.pi * np.arange(600) / 30)
    long = long_frame(spark, pd.DataFrame({"s": y}, index=days))
    extra = ({"name": "monthly", "period": 30, "fourier_order": 2},)
    config = ModelConfig(yearly_seasonality=False, custom_seasonalities=extra)
    models = additive.fit_additive(long, config)
    parts = additive.components(models, long, ("weekly", "monthly")).toPandas()
    assert np.isclose(parts["monthly"].max(), 3, atol=0.1) and parts["weekly"].abs().max() < 0.1
    shares = additive.component_importance(models, long, ("weekly", "monthly")).toPandas()
    assert np.isclose(shares["importance"].sum(), 100)


def test_constant_series(spark):
    long = long_frame(spark, pd.DataFrame({"s": 5.0, "zero": 0.0}, index=pd.date_range("2020-01-01", periods=60)))
    models = additive.fit_additive(long)
    assert additive.model_errors(models).isEmpty()
    ahead = additive.predict_horizon(models, 5).toPandas()
    assert np.allclose(ahead.loc[ahead["series_id"] == "s", "yhat"], 5, atol=0.05)
    assert np.allclose(ahead.loc[ahead["series_id"] == "zero", "yhat"], 0, atol=1e-6)


def test_failing_series_does_not_stop_the_others(spark, four_years):
    long = long_frame(spark, four_years[:200].to_frame("s")).unionByName(
        spark.createDataFrame([("g", "one", day("2020-01-01"), 1.0)], "group_id string, series_id string, ds date, y double")
    )
    infinite = long.where("series_id = 's'").withColumn("series_id", F.lit("inf")).withColumn("y", F.lit(float("inf")))
    holes = long.where("series_id = 's'").withColumn("series_id", F.lit("nan")).withColumn("y", F.lit(float("nan")))
    models = additive.fit_additive(long.unionByName(infinite).unionByName(holes))
    errors = additive.model_errors(models).collect()
    assert {(e["series_id"], e["model"]) for e in errors} == {("one", "additive"), ("inf", "additive")}
    assert additive.usable(models).count() == 1 and additive.predict_horizon(models, 3).count() == 3


def test_interval_does_not_depend_on_partitioning(fitted):
    long, models = fitted
    ahead = horizon.future_dates(long, 20)
    one = additive.predict_interval(models, ahead.repartition(1)).orderBy("ds").collect()
    many = additive.predict_interval(models.repartition(3), ahead.repartition(7)).orderBy("ds").collect()
    assert one == many


def test_simulation_in_pieces(four_years, monkeypatch):
    days, y = days_of(four_years), four_years.to_numpy()
    params = map_fit.fit_map(days[:1000], y[:1000], np.ones(1000), 0.0, ModelConfig())
    whole = map_fit.simulate(params, days, 400, 0.9, 1)
    monkeypatch.setattr(map_fit, "DATES_AT_ONCE", 100)
    pieces = map_fit.simulate(params, days, 400, 0.9, 1)
    np.testing.assert_allclose(whole[0], pieces[0])
    spread = whole[2] - whole[1]
    assert np.abs(pieces[2] - pieces[1] - spread).max() < 0.35 * spread.max()
    assert map_fit.simulate(params, days[:0], 10, 0.9, 1)[0].size == 0


def test_cross_validation(spark, four_years):
    long = long_frame(spark, four_years.to_frame("s"))
    cuts = [r["cutoff"] for r in additive.cv_cutoffs(long).orderBy("cutoff").collect()]
    assert cuts[-1] == day("2023-10-02") and len(cuts) == 4
    assert (cuts[1] - cuts[0]).days == 180 and cuts[0] >= day("2021-12-31")
    scored = additive.cross_validate(long)
    assert scored.count() == 4 * 90 and additive.cv_errors(scored).isEmpty()
    quality = additive.cv_metrics(scored).first()
    assert 4 < quality["cv_rmse"] < 7 and 0 < quality["cv_mape"] < 0.1 and quality["cv_coverage"] > 0.85
    short = additive.cross_validate(long.where("ds < '2021-01-01'"))
    assert [tuple(r) for r in short.collect()] == [("g", "s", *[None] * 6, "Too short for a cutoff")]
    bad = long.withColumn("y", F.when(F.col("ds") == "2022-01-01", float("inf")).otherwise(F.col("y")))
    failed = additive.cv_errors(additive.cross_validate(bad)).collect()
    assert len(failed) == 4 and all("finite" in r["error"] for r in failed)


@pytest.fixture(scope="module")
def wave_split(spark, three_waves):
    done = preprocess(long_frame(spark, three_waves), select=True)
    return done, temporal_split(done.data).cache()


def test_linear_windows_learn_and_forecast(spark, wave_split):
    done, split_df = wave_split
    rows = windows.split_sequences(split_df)
    model = sequence.fit_sequence(rows)
    scored = sequence.predict_sequence_batch(model, rows.where("split = 'test'")).toPandas()
    assert np.sqrt(np.mean((scored["y"] - scored["yhat"]) ** 2)) < 0.05
    history = sequence.training_history(model, rows)
    assert {r["metric"] for r in sequence.final_metrics(history).collect()} == {"loss", "val_loss"}
    with pytest.raises(ValueError):
        sequence.predict_sequence_batch(None, rows)


@pytest.mark.parametrize("compat", [False, True])
def test_recursion_equals_the_loop(spark, wave_split, compat):
    done, split_df = wave_split
    model = sequence.fit_sequence(windows.split_sequences(split_df))
    weights, intercept = model.coefficients()
    future = horizon.future_dates(done.data, 12)
    got = sequence.forecast_recursive(model, done.data, future, compat_roll=compat)
    path = series_of(got, "keyword2", "yhat")

    pdf = done.data.where("series_id = 'keyword2'").orderBy("ds").toPandas()
    window = pdf[model.features].to_numpy(float)[-30:]
    dates, want = path.index, []
    for date in dates:
        value = float((window * np.asarray(weights)).sum() + intercept)
        want.append(value)
        fresh = window[0].copy()
        if not compat:
            dow, week = date.dayofweek, date.isocalendar().week
            m, d = 2 * np.pi * date.month / 12, 2 * np.pi * date.day / 31
            fresh = np.array([0, date.year, date.month, date.day, dow, week, np.sin(m), np.cos(m), np.sin(d), np.cos(d)])
        fresh[0] = value
        window = np.vstack([window[1:], fresh])
    assert dates[0] == pdf["ds"].astype("datetime64[ns]").max() + pd.Timedelta(days=1)
    np.testing.assert_allclose(path.to_numpy(), want, rtol=1e-7, atol=1e-8)


def test_trees_stop_early_and_forecast_directly(spark, wave_split, tmp_path):
    done, split_df = wave_split
    config = ModelConfig(sequence_kind="gbt", sequence_max_iter=3)
    trained = forecasting.train_models(split_df, ["sequence"], config, periods=4)
    assert trained.sequence.direct and sequence.horizon_steps(30)[-1] == 30
    ahead = forecasting.forecast(trained, done.data, 4, config).toPandas()
    assert len(ahead) == 12 and ahead["yhat"].between(-0.5, 1.5).all()
    assert forecasting.evaluate(trained, split_df, config).where("metric = 'rmse'").count() == 3
    store.save_sequence(spark, trained.sequence, str(tmp_path), config)
    again = store.load_sequence(spark, str(tmp_path))
    assert (again.kind, again.direct, again.size) == ("gbt", True, 310)


def test_saved_models_come_back(spark, wave_split, fitted, tmp_path):
    _, split_df = wave_split
    rows = windows.split_sequences(split_df)
    model = sequence.fit_sequence(rows)
    store.save_sequence(spark, model, str(tmp_path / "s"))
    again = store.load_sequence(spark, str(tmp_path / "s"))
    assert again.coefficients() == model.coefficients() and again.length == 30
    assert sorted(again.history.collect()) == sorted(sequence.training_history(model, rows).collect())
    long, models = fitted
    store.save_additive(models, str(tmp_path / "a"))
    assert store.load_additive(spark, str(tmp_path / "a")).collect() == models.collect()
    about = store.read_metadata(spark, str(tmp_path / "a"))
    assert about["model_type"] == "additive" and "is_trained = True" in store.model_summary(about, {"mae": 1.0})
    assert store.read_metadata(spark, str(tmp_path / "nowhere")) == {}


def test_registry():
    assert set(store.list_models()) >= {"additive", "sequence"}
    with pytest.raises(ValueError, match="additive"):
        store.get_model("unheard of")
    store.register("mine", len)
    assert store.get_model("mine") is len
    store.unregister("mine")
    with pytest.raises(ValueError):
        store.get_model("mine")
    assert store.set_params(ModelConfig(), interval_width=0.8).interval_width == 0.8


def test_registered_types_are_trained_scored_and_forecast(spark, three_waves):
    """A type of one's own: the mean of the training rows."""

    def fit(rows, config):
        return rows.groupBy("group_id", "series_id").agg(F.avg("y").alias("level"))

    def predict(models, dates, keep=()):
        joined = dates.join(models, ["group_id", "series_id"])
        return joined.select("group_id", "series_id", "ds", *keep, F.col("level").alias("yhat"))

    store.register("level", store.TableModel(fit, predict))
    try:
        raw = long_frame(spark, three_waves[["keyword1", "keyword2"]])
        done = forecasting.run(raw, periods=3, types=["level", "unheard of"])
        assert done["models"].names == ["level"] and done["errors"].isEmpty()
        assert done["forecasts"].groupBy("series_id").agg(F.countDistinct("yhat").alias("n")).collect()[0]["n"] == 1
        assert done["metrics"].where("model = 'level' and metric = 'rmse'").count() == 2
    finally:
        store.unregister("level")


def test_run_everything(spark, three_waves, tmp_path, monkeypatch):
    raw = long_frame(spark, three_waves[["keyword1", "keyword2"]])
    done = forecasting.run(raw, periods=5, types=["additive", "sequence", "unheard of"], output=str(tmp_path))
    assert done["models"].names == ["additive", "sequence"] and done["errors"].isEmpty()
    assert done["forecasts"].count() == 2 * 2 * 5
    ahead = done["forecasts"].toPandas()
    assert ahead["ds"].min() == day("2022-01-01") and ahead["yhat"].between(-40, 140).all()
    names = {r["metric"] for r in done["metrics"].collect()}
    assert {"mae", "mse", "rmse", "mape", "r2", "changepoint_prior_scale", "test_loss"} <= names
    assert spark.read.csv(str(tmp_path / "predictions"), header=True).columns[-2:] == ["additive", "sequence"]
    assert spark.read.text(str(tmp_path / "summary")).count() == 2
    assert done["report"]["correlation"].count() == 4 and done["report"]["rmse"].count() == 4

    def broken(*_):
        raise RuntimeError("lost")

    scaled = done["metrics"].where("metric = 'mae' and series_id = 'keyword1'").collect()
    real = forecasting.evaluate(done["models"], done["split"], scalers=done["processed"].scalers)
    for row in scaled:
        other = real.where((F.col("metric") == "mae") & (F.col("model") == row["model"])).where("series_id = 'keyword1'")
        span = done["processed"].scalers.where("series_id = 'keyword1' and column = 'y'").first()["scale"]
        assert np.isclose(other.first()["value"], row["value"] * span)

    monkeypatch.setattr(forecasting.sequence, "forecast_recursive", broken)
    partly = forecasting.run(raw, periods=2, types=["sequence", "additive"])
    assert {r["model"] for r in partly["forecasts"].collect()} == {"additive"}
    assert [(r["model"], r["stage"], r["error"]) for r in partly["errors"].collect()] == [("sequence", "forecast", "lost")]

    single = forecasting.run(raw, periods=3, target="keyword2", types=["additive"])
    assert {r["series_id"] for r in single["forecasts"].collect()} == {"keyword2"}


def test_run_reports_series_too_short_for_windows(spark, three_waves):
    raw = long_frame(spark, three_waves[["keyword1"]]).unionByName(
        long_frame(spark, three_waves[["keyword3"]][:2], "tiny")
    )
    split_df = temporal_split(preprocess(raw, DataConfig(smoothing_window=1), select=True).data)
    trained = forecasting.train_models(split_df, ["sequence"])
    assert [(e["group_id"], e["stage"]) for e in trained.errors[0].collect()] == [("tiny", "fit")]
