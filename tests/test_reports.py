import numpy as np
import pandas as pd
import pytest
from conftest import day, long_frame, series_of
from pyspark.sql import functions as F

from seriesloom.operators import correlation, decomposition, horizon, metrics, reports

SCORED = "group_id string, series_id string, model string, y double, yhat double"


def test_metrics_and_edges(spark):
    rows = [("g", "a", "m", y, p) for y, p in [(1.0, 2.0), (0.0, 1.0), (4.0, 2.0)]]
    rows += [("g", "flat", "good", 3.0, 3.0)] * 2 + [("g", "flat", "bad", 3.0, 4.0)] * 2 + [("g", "zero", "m", 0.0, 1.0)]
    out = {(r["series_id"], r["model"]): r for r in metrics.regression_metrics(spark.createDataFrame(rows, SCORED)).collect()}
    a = out["a", "m"]
    assert np.isclose(a["mae"], 4 / 3) and np.isclose(a["mse"], 2.0) and np.isclose(a["rmse"], 2**0.5)
    assert np.isclose(a["mape"], 75.0) and np.isclose(a["r2"], 1 - 6 / (26 / 3))
    assert out["flat", "good"]["r2"] == 1.0 and out["flat", "bad"]["r2"] == 0.0
    assert np.isnan(out["zero", "m"]["mape"])
    table = metrics.to_long_metrics(metrics.regression_metrics(spark.createDataFrame(rows, SCORED)))
    assert metrics.metric_names(table) == sorted(metrics.METRICS)
    wide = metrics.metrics_table(table, ["mape", "r2", "cv_rmse"]).where("series_id = 'zero'").first()
    assert wide["mape"] is None and wide["cv_rmse"] is None
    ranked = metrics.rank_models(table).where("series_id = 'flat' and rank = 1").collect()
    assert {r["model"] for r in ranked if r["metric"] in ("r2", "mae")} == {"good"}


def test_correlation_with_gaps(spark, three_waves):
    wide = three_waves.copy()
    wide["flat"] = 1.0
    wide.iloc[5:40, 0] = np.nan
    wide.iloc[:100, 1] = np.nan
    want = wide.corr()
    got = correlation.correlation_matrix(long_frame(spark, wide)).toPandas()
    assert len(got) == 16
    table = got.pivot(index="a", columns="b", values="corr").loc[want.index, want.columns]
    np.testing.assert_allclose(table.to_numpy(float), want.to_numpy(), atol=1e-9, equal_nan=True)
    lower = correlation.correlation_lower(long_frame(spark, wide)).toPandas()
    assert len(lower) == 6 and (lower["a"] > lower["b"]).all()


def decompose(values: np.ndarray, period: int):
    """The textbook definition, in NumPy."""
    weights = np.r_[0.5, np.ones(period - 1), 0.5] / period if period % 2 == 0 else np.ones(period) / period
    half, trend = len(weights) // 2, np.full(len(values), np.nan)
    trend[half : len(values) - half] = np.convolve(values, weights, "valid")
    level = np.array([np.nanmean((values - trend)[i::period]) for i in range(period)])
    return trend, np.resize(level - level.mean(), len(values))


@pytest.mark.parametrize("rows, period, used", [(731, None, 365), (300, None, 30), (40, None, 7), (60, 8, 8)])
def test_decomposition(spark, three_waves, rows, period, used):
    wide = three_waves[["keyword1"]][:rows]
    out = decomposition.seasonal_decompose(long_frame(spark, wide), period).orderBy("ds").toPandas()
    trend, seasonal = decompose(wide["keyword1"].to_numpy(), used)
    assert set(out["status"]) == {"ok"} and set(out["period"]) == {used}
    np.testing.assert_allclose(out["trend"].to_numpy(float), trend, atol=1e-9, equal_nan=True)
    np.testing.assert_allclose(out["seasonal"].to_numpy(float), seasonal, atol=1e-9, equal_nan=True)


def test_decomposition_refuses(spark, three_waves, year_long):
    short = long_frame(spark, three_waves[["keyword1"]][:13])
    assert {r["status"] for r in decomposition.seasonal_decompose(short).collect()} == {"too short"}
    gaps = decomposition.seasonal_decompose(year_long.where("series_id = 'keyword1'"))
    assert {(r["status"], r["trend"]) for r in gaps.collect()} == {("missing values", None)}


def test_distribution_matches_numpy(spark, three_waves):
    wide = three_waves[["keyword1"]].assign(flat=2.0)
    out = reports.distribution(long_frame(spark, wide)).orderBy("bin").toPandas()
    for name in wide:
        counts, edges = np.histogram(wide[name], bins=30)
        mine = out[out["series_id"] == name]
        assert mine["n"].tolist() == counts.tolist()
        np.testing.assert_allclose(mine["bin_from"], edges[:-1], atol=1e-9)
        assert np.isclose(mine["median"].iat[0], wide[name].median()) and np.isclose(mine["mean"].iat[0], wide[name].mean())


def test_overview_and_tail(spark, year_long):
    row = reports.overview(year_long).first()
    assert (row["keywords"], row["data_points"], row["missing"]) == (2, 366, 5)
    assert row["first_date"] == day("2020-01-01") and row["last_date"] == day("2020-12-31")
    assert reports.last_n(year_long, 10).where("ds >= '2020-12-22'").count() == 20


def test_frequency_and_dates(spark):
    weekly = pd.DataFrame({"w": 1.0}, index=pd.date_range("2020-01-05", periods=6, freq="7D"))
    monthly = pd.DataFrame({"m": 1.0}, index=pd.date_range("2020-01-01", periods=6, freq="MS"))
    single = pd.DataFrame({"one": 1.0}, index=pd.date_range("2020-01-31", periods=1))
    long = long_frame(spark, weekly).unionByName(long_frame(spark, monthly)).unionByName(long_frame(spark, single))
    assert {r["series_id"]: r["freq"] for r in horizon.infer_freq(long).collect()} == {"w": "W", "m": "M", "one": "D"}
    ahead = horizon.future_dates(long, 2)
    dates = {n: [r["ds"] for r in ahead.where(F.col("series_id") == n).orderBy("ds").collect()] for n in ("w", "m", "one")}
    assert dates == {
        "w": [day("2020-02-16"), day("2020-02-23")],
        "m": [day("2020-07-01"), day("2020-08-01")],
        "one": [day("2020-02-01"), day("2020-02-02")],
    }
    forced = horizon.future_dates(long, 1, "D").where("series_id = 'w'").first()
    assert forced["ds"] == day("2020-02-10")


@pytest.mark.parametrize(
    ("first", "rule", "freq"),
    [("2020-01-31", "ME", "ME"), ("2020-01-31", "QE", "QE"), ("2019-12-31", "YE", "YE"), ("2020-01-01", "QS", "Q"),
     ("2019-02-01", "12MS", "Y"), ("2020-01-15", "14D", "D"), ("2020-02-29", "ME", "ME")],
)
def test_steps_of_months_quarters_and_years(spark, first, rule, freq):
    dates = pd.date_range(first, periods=9, freq=rule)
    long = long_frame(spark, pd.DataFrame({"x": 1.0}, index=dates[:5]))
    assert horizon.infer_freq(long).first()["freq"] == freq
    ahead = [r["ds"] for r in horizon.future_dates(long, 4).orderBy("step").collect()]
    assert ahead == [d.date() for d in dates[5:]]


def test_forecast_tables(spark):
    rows = [("g", "s", "up", day("2020-02-01"), 1.0), ("g", "s", "up", day("2020-02-02"), 3.06)]
    rows += [("g", "s", "same", day("2020-02-01"), 2.0), ("g", "s", "same", day("2020-02-02"), 2.0)]
    forecasts = spark.createDataFrame(rows, "group_id string, series_id string, model string, ds date, yhat double")
    summary = {r["model"]: r for r in reports.forecast_summary(forecasts).collect()}
    assert (summary["up"]["average"], summary["up"]["change"], summary["up"]["direction"]) == (2.0, 2.1, "up")
    assert summary["same"]["direction"] == "down"
    history = long_frame(spark, pd.DataFrame({"s": np.arange(31.0)}, index=pd.date_range("2020-01-01", periods=31)))
    context = reports.forecast_context(history, forecasts, 5).toPandas()
    assert context["kind"].value_counts().to_dict() == {"actual": 5, "up": 2, "same": 2}
    assert set(context["forecast_start"]) == {day("2020-02-01")}
    test = history.where("ds > '2020-01-30'").withColumn("ds", F.date_add("ds", 1))
    both = metrics.backtest_table(test, forecasts).collect()
    assert {(r["model"], r["actual"], r["predicted"]) for r in both} == {("up", 30.0, 1.0), ("same", 30.0, 2.0)}
    tables = reports.report_tables(history, forecasts)
    assert set(tables) == {"history", "correlation", "forecast"}
    assert series_of(tables["history"], "s").iloc[-1] == 30.0
