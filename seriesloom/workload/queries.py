"""Each operator applied to the given tables, by name."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AppConfig, DataConfig, ModelConfig
from ..functions.arrays import literal_array
from ..models import additive, sequence, store
from ..models.network import Network
from ..models.trees import Ensemble
from ..models import fine as fine_models
from ..operators import cleaning, correlation, decomposition, demand, features, fine, horizon, merging, metrics
from ..operators import partners, reports, scaling, selection, splitting, windows
from ..plans import forecasting
from ..plans.preprocess import preprocess
from ..schema import KEYS, in_time
from ..session import shared_dir, stage_table
from ..sources import extracts, processed, results
from ..sources.logs import normalize_geo
from . import views

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
TODAY = dt.date(2001, 8, 1)
QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/seriesloom/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def finite(column: str):
    return F.coalesce(F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf")), F.lit(False))


# Inputs shared by the queries below.


def daily(spark, d):
    return views.orders_series(spark, d)


def weekly(spark, d):
    return views.orders_series(spark, d, "week")


def grid(spark, d):
    return merging.complete_grid(daily(spark, d))


def filled(spark, d):
    return cleaning.fill_time(grid(spark, d))


def supplier_grid(spark, d):
    return merging.complete_grid(views.supplier_series(spark, d))


def weekly_filled(spark, d):
    return cleaning.fill_time(merging.complete_grid(weekly(spark, d)))


def prepared(spark, d):
    return preprocess(grid(spark, d), select=True)


def staged(spark, d):
    """Prepared rows, written once for the several jobs of a model."""
    done = prepared(spark, d)
    return replace(done, rows=stage_table(done.rows, "prepared"))


def staged_split(spark, d):
    return forecasting.prepare(staged(spark, d).data)


def orders_by_nation(spark, d):
    orders = views.table(spark, d, "orders")
    customers = views.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    nations = views.table(spark, d, "nation").select("n_nationkey", "n_name")
    located = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return located.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("geo"), F.col("o_orderpriority").alias("query"), F.col("o_orderdate").alias("ts")
    )


def text_extract(spark, d):
    """The grid as a service delivers it: text for small values, a marker column."""
    small = F.when(F.col("y") < 100_000, "<1").otherwise(F.col("y").cast("bigint").cast("string"))
    return grid(spark, d).withColumn("y", small).withColumn("isPartial", F.col("ds") == F.lit(TODAY))


# Sources, sinks and ingest.


@query
def read_trends(spark, d):
    """Land a wide extract as CSV, read it back typed."""
    path = scratch(spark, "extract")
    wide = extracts.to_wide(daily(spark, d), PRIORITIES, ("group_id", "ds"))
    wide.write.option("header", True).csv(path)
    schema = extracts.wide_schema(PRIORITIES, index="ds", partial=False)
    schema.fields.insert(0, wide.schema["group_id"])
    schema.names.insert(0, "group_id")
    landed = extracts.read_trends(spark, path, "csv", schema)
    return extracts.to_long(landed, PRIORITIES, index="ds")


@query
def to_wide(spark, d):
    return extracts.to_wide(daily(spark, d), PRIORITIES, ("group_id", "ds"))


@query
def to_long(spark, d):
    return extracts.to_long(to_wide(spark, d), PRIORITIES, index="ds")


@query
def clean(spark, d):
    return cleaning.clean(text_extract(spark, d))


@query
def drop_partial(spark, d):
    return cleaning.drop_partial(text_extract(spark, d))


@query
def filter_timeframe(spark, d):
    recent = selection.filter_timeframe(views.table(spark, d, "orders"), "today 12-m", TODAY, "o_orderdate")
    return recent.select("o_orderkey", F.to_date("o_orderdate").alias("ds"), "o_totalprice")


@query
def filter_timeframe_dates(spark, d):
    return selection.filter_timeframe(daily(spark, d), "1996-03-01 1997-02-28")


@query
def filter_geo(spark, d):
    located = selection.filter_geo(orders_by_nation(spark, d), "NATION_7")
    return located.groupBy("geo", "query").agg(F.count("*").alias("n"))


@query
def merge_periods(spark, d):
    early = selection.filter_timeframe(daily(spark, d), "1995-01-01 1998-12-31")
    late = selection.filter_timeframe(daily(spark, d), "1998-06-01 2001-12-31").withColumn("y", F.col("y") * 2)
    return merging.merge_periods([early, late])


@query
def merge_batches(spark, d):
    first = daily(spark, d).where(F.col("series_id").isin(PRIORITIES[:3]))
    return merging.merge_batches([first, daily(spark, d).where(F.col("series_id").isin(PRIORITIES[3:]))])


@query
def merge_wide(spark, d):
    """Two batches of keywords, one of them from 1996 on, that share a keyword."""
    whole = daily(spark, d).groupBy("series_id", "ds").agg(F.sum("y").alias("y"))
    first = extracts.to_wide(whole, PRIORITIES[:3])
    later = extracts.to_wide(whole.where("ds >= '1996-01-01'"), PRIORITIES[2:])
    return merging.merge_wide([first, later], "ds")


@query
def complete_grid(spark, d):
    return grid(spark, d)


@query
def batch_keywords(spark, d):
    suppliers = views.table(spark, d, "supplier")
    words = suppliers.select(F.col("s_name").alias("keyword"), F.col("s_suppkey").alias("ordinal"))
    return merging.batch_keywords(words, 7)


@query
def write_raw(spark, d):
    path = scratch(spark, "raw")
    extracts.write_raw(daily(spark, d), path, "today 5-y", "")
    return spark.read.parquet(f"{path}/data").select(*KEYS, "ds", "y", "geo")


@query
def extract_metadata(spark, d):
    about = extracts.extract_metadata(daily(spark, d), "today 5-y", "")
    return about.drop("collected_at")


@query
def extract_keywords(spark, d):
    return extracts.extract_keywords(daily(spark, d))


@query
def write_processed(spark, d):
    path = scratch(spark, "processed")
    done = prepared(spark, d)
    processed.write_processed(done.data, done.scalers, path)
    data, _ = processed.read_processed(spark, path, with_scalers=False)
    return rounded(data.select(*KEYS, "ds", "y", "year", "week_of_year"), 6, "y")


@query
def sequences_of_buckets(spark, d):
    """Windows of a processed table in buckets by series, read without a shuffle."""
    path = scratch(spark, "processed")
    processed.write_processed(filled(spark, d), None, path, buckets=8)
    rows = windows.make_sequences(processed.read_processed(spark, path, with_scalers=False)[0], 7)
    oldest, newest = F.element_at(F.element_at("x", 1), 1), F.element_at(F.element_at("x", 7), 1)
    return rows.select(*KEYS, "ds", oldest.cast("double").alias("oldest"), newest.cast("double").alias("newest"), F.col("yt").cast("double"))


@query
def read_processed_scalers(spark, d):
    path = scratch(spark, "processed")
    done = prepared(spark, d)
    processed.write_processed(done.data, done.scalers, path)
    _, scalers = processed.read_processed(spark, path)
    return rounded(scalers.where("column = 'y'"), 2, "shift", "scale")


@query
def interest_over_time(spark, d):
    return demand.interest_over_time(views.table(spark, d, "events"), "event_type", "ts")


@query
def interest_over_time_batched(spark, d):
    return demand.interest_over_time(views.table(spark, d, "events"), "user_id", "ts", "week")


@query
def related_queries(spark, d):
    log = views.table(spark, d, "events").select("user_id", F.col("event_type").alias("query"), "ts")
    return demand.related_queries(log, EVENT_TYPES, 3)


@query
def interest_over_time_sevens(spark, d):
    return demand.interest_over_time(views.table(spark, d, "events"), "user_id", "ts", "month", size=7)


@query
def trending(spark, d):
    return demand.trending(normalize_geo(orders_by_nation(spark, d)), "nation_7", 3, bucket="month")


@query
def predictions_wide(spark, d):
    return rounded(results.predictions_wide(views.plain_forecasts(filled(spark, d), 14), ["hold", "drift"]), 2, "hold", "drift")


@query
def results_summary(spark, d):
    series = filled(spark, d)
    scored = metrics.to_long_metrics(metrics.regression_metrics(views.lagged_forecasts(series)))
    summary = results.results_summary(daily(spark, d), scored, views.plain_forecasts(series, 14))
    return summary.select(
        *KEYS,
        "n_rows",
        "first_date",
        "last_date",
        F.array_join("models", ",").alias("models"),
        F.round(F.col("metrics")["lag1.mape"], 4).alias("lag1_mape"),
        F.round(F.col("metrics")["lag7.r2"], 6).alias("lag7_r2"),
        "prediction_periods",
    )


# Preprocessing and features.


@query
def missing_count(spark, d):
    return cleaning.missing_count(grid(spark, d))


@query
def fill_time(spark, d):
    return rounded(filled(spark, d), 4, "y")


@query
def drop_missing(spark, d):
    return cleaning.drop_missing(grid(spark, d))


@query
def smooth(spark, d):
    return rounded(cleaning.smooth(filled(spark, d), 7), 4, "y", "y_original")


@query
def smooth_even(spark, d):
    return rounded(cleaning.smooth(weekly(spark, d), 4), 2, "y", "y_original")


@query
def fit_scaler_minmax(spark, d):
    return scaling.fit_scaler(daily(spark, d))


@query
def scale_minmax(spark, d):
    return rounded(scaling.scale_series(daily(spark, d)), 9, "y")


@query
def scale_standard(spark, d):
    return rounded(scaling.scale_series(weekly(spark, d), "standard"), 6, "y")


@query
def apply_scaler(spark, d):
    """Daily values in the scale of the weekly ones."""
    return rounded(scaling.apply_scaler(daily(spark, d), scaling.fit_scaler(weekly(spark, d))), 9, "y")


@query
def inverse_scale(spark, d):
    series = daily(spark, d)
    scalers = scaling.fit_scaler(series)
    return rounded(scaling.inverse_scale(scaling.scale_series(series), scalers), 2, "y")


@query
def calendar_features(spark, d):
    return features.calendar_features(daily(spark, d))


@query
def cyclical_features(spark, d):
    rows = features.cyclical_features(features.calendar_features(daily(spark, d)))
    waves = ["month_sin", "month_cos", "day_sin", "day_cos", "dow_sin", "dow_cos"]
    return rounded(rows.select(*KEYS, "ds", *waves), 9, *waves)


@query
def select_target(spark, d):
    done = preprocess(grid(spark, d), target="1-URGENT")
    return rounded(done.data, 6, "y", "month_sin", "month_cos", "day_sin", "day_cos")


@query
def preprocess_all(spark, d):
    rows = preprocess(grid(spark, d)).data
    return rounded(rows.select(*KEYS, "ds", "y", "y_original", "year", "day_of_week", "week_of_year"), 6, "y", "y_original")


@query
def preprocess_drop(spark, d):
    config = DataConfig(interpolate_missing=False, smoothing_window=1)
    rows = preprocess(grid(spark, d), config).data
    return rounded(rows.select(*KEYS, "ds", "y", "day"), 6, "y")


@query
def make_sequences(spark, d):
    rows = windows.make_sequences(prepared(spark, d).data, length=30, steps=2)
    return rows.select(
        *KEYS,
        "ds",
        F.size("x").alias("x_rows"),
        F.size(F.col("x")[0]).alias("x_columns"),
        F.round(F.col("x")[0][0].cast("double"), 5).alias("oldest"),
        F.round(F.col("x")[29][0].cast("double"), 5).alias("newest"),
        F.col("x")[29][3].cast("int").alias("newest_day"),
        F.round(F.col("yt")[1].cast("double"), 5).alias("second_step"),
    )


@query
def temporal_split(spark, d):
    return splitting.temporal_split(weekly(spark, d))


@query
def adaptive_length(spark, d):
    return windows.adaptive_length(splitting.temporal_split(views.events_series(spark, d)))


@query
def split_sequences(spark, d):
    series = features.calendar_features(views.events_series(spark, d))
    rows = windows.split_sequences(splitting.temporal_split(series), features=["y", "day"])
    own = F.filter("x", lambda _, i: i % 2 == 0)
    total = F.aggregate(own, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return rows.select(*KEYS, "ds", "split", "length", F.size("x").alias("x_size"), total.alias("x_sum"), F.col("yt").cast("double").alias("yt"))


# Forecasting models.


@query
def fit_additive(spark, d):
    rows = additive.fit_additive(daily(spark, d))
    return rows.select(
        *KEYS, "t0", "last_ds", "n_obs", F.size("changepoints").alias("n_changepoints"), "y_scale", "changepoint_prior_scale"
    )


@query
def fit_additive_parameters(spark, d):
    rows = additive.fit_additive(weekly(spark, d))
    return rounded(rows.select(*KEYS, "k", "m", "sigma"), 4, "k", "m", "sigma")


@query
def custom_seasonalities(spark, d):
    extra = ({"name": "quarterly", "period": 91.3125, "fourier_order": 4},)
    rows = additive.fit_additive(daily(spark, d), ModelConfig(custom_seasonalities=extra))
    return rows.select(*KEYS, F.explode("terms").alias("t")).select(
        *KEYS, F.col("t.name").alias("name"), F.col("t.period").alias("period"), F.size("t.coef").alias("n_coef")
    )


def _fitted(split_df):
    return stage_table(additive.fit_additive(split_df.where("split <> 'test'")), "additive")


@query
def fit_additive_line(spark, d):
    """Without seasons and changepoints the fit is a line: slope and level in the data's units."""
    config = ModelConfig(yearly_seasonality=False, weekly_seasonality=False, n_changepoints=0)
    rows = additive.fit_additive(weekly(spark, d), config)
    slope = F.col("k") * F.col("y_scale") / F.col("t_days")
    return rows.select(*KEYS, F.round(slope, 0).alias("slope"), F.round(F.col("m") * F.col("y_scale") / 1000, 0).alias("level"))


@query
def custom_seasonality_fit(spark, d):
    """A line and one custom wave with weak priors are least squares: the wave's size in the data's units, in hundreds."""
    wave = {"name": "quarterly", "period": 91.3125, "fourier_order": 1, "mode": "additive", "prior_scale": 1000.0}
    config = ModelConfig(yearly_seasonality=False, weekly_seasonality=False, n_changepoints=0, custom_seasonalities=(wave,))
    rows = additive.fit_additive(weekly(spark, d), config)
    size = lambda i: F.round(F.col("terms")[0]["coef"][i] * F.col("y_scale") / 100, 0) + 0.0
    return rows.select(*KEYS, size(0).alias("sine"), size(1).alias("cosine"))


def given_models(spark, d):
    """A parameter row for each series, written by hand."""
    wave = "struct<name:string,period:double,mode:string,coef:array<double>>"
    terms = F.array(
        F.struct(F.lit("yearly"), F.lit(365.25), F.lit("multiplicative"), literal_array([0.1, 0.05, 0.01, 0.02])).cast(wave),
        F.struct(F.lit("weekly"), F.lit(7.0), F.lit("additive"), literal_array([0.02, -0.03])).cast(wave),
    )
    return daily(spark, d).select(*KEYS).distinct().select(
        *KEYS,
        F.lit(dt.date(1995, 1, 1)).alias("t0"),
        F.lit(1000.0).alias("t_days"),
        (F.length("series_id") * 100.0).alias("y_scale"),
        F.lit(0.5).alias("k"),
        F.lit(1.25).alias("m"),
        literal_array([0.25, 0.5]).alias("changepoints"),
        literal_array([0.1, -0.2]).alias("deltas"),
        terms.alias("terms"),
        F.lit(None).cast("string").alias("error"),
    )


@query
def predict_dates_given(spark, d):
    return rounded(additive.predict_dates(given_models(spark, d), daily(spark, d)), 5, "yhat")


@query
def components_given(spark, d):
    return rounded(additive.components(given_models(spark, d), daily(spark, d)), 5, "trend", "yearly", "weekly")


@query
def component_importance_given(spark, d):
    return rounded(additive.component_importance(given_models(spark, d), daily(spark, d)), 6, "importance")


def straight_models(spark, d, sigma):
    """The given models without bends of the trend, up to the last date, with that much noise."""
    none = F.array().cast("array<double>")
    ends = daily(spark, d).groupBy(*KEYS).agg(F.max("ds").alias("last_ds"))
    return given_models(spark, d).withColumns(
        {"changepoints": none, "deltas": none, "sigma": F.lit(sigma), "changepoint_prior_scale": F.lit(0.05)}
    ).join(ends, KEYS)


@query
def predict_horizon_given(spark, d):
    """Thirty days after the last, values and all."""
    ends = daily(spark, d).groupBy(*KEYS).agg(F.max("ds").alias("last_ds"))
    return rounded(additive.predict_horizon(given_models(spark, d).join(ends, KEYS), 30), 5, "yhat")


@query
def predict_interval_given(spark, d):
    """Without noise and bends each bound is the forecast."""
    ahead = additive.predict_horizon_interval(straight_models(spark, d, 0.0), 30)
    return rounded(ahead, 5, "yhat", "yhat_lower", "yhat_upper")


@query
def predict_interval_noise_given(spark, d):
    """Mean distance of the bounds from the forecast, in units of the noise: a quantile of the normal distribution."""
    ahead = additive.predict_horizon_interval(straight_models(spark, d, 1.0), 400, config=ModelConfig(interval_width=0.8))
    unit = F.length("series_id") * 100.0
    return ahead.groupBy(*KEYS).agg(
        F.count("*").alias("n"),
        F.round(F.avg((F.col("yhat") - F.col("yhat_lower")) / unit), 1).alias("below"),
        F.round(F.avg((F.col("yhat_upper") - F.col("yhat")) / unit), 1).alias("above"),
    )


@query
def predict_dates(spark, d):
    split_df = staged_split(spark, d)
    ahead = additive.predict_dates(_fitted(split_df), split_df.where("split = 'test'"))
    return ahead.select(*KEYS, "ds", finite("yhat").alias("forecast"))


@query
def predict_horizon(spark, d):
    models = stage_table(additive.fit_additive(weekly(spark, d)), "additive")
    ahead = additive.predict_horizon(models, 8, horizon.infer_freq(weekly(spark, d)))
    return ahead.select(*KEYS, "ds", F.col("yhat").isNotNull().alias("forecast"))


@query
def predict_interval(spark, d):
    models = stage_table(additive.fit_additive(daily(spark, d)), "additive")
    ahead = additive.predict_horizon_interval(models, 30)
    inside = (F.col("yhat_lower") < F.col("yhat")) & (F.col("yhat") < F.col("yhat_upper"))
    return ahead.select(*KEYS, "ds", inside.alias("inside"))


@query
def cv_cutoffs(spark, d):
    return additive.cv_cutoffs(daily(spark, d))


@query
def cross_validate(spark, d):
    scored = additive.cross_validate(daily(spark, d)).where("error is null")
    good = finite("yhat") & (F.col("yhat_lower") < F.col("yhat")) & (F.col("yhat") < F.col("yhat_upper"))
    return scored.groupBy(*KEYS, "cutoff").agg(
        F.count("*").alias("n"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.sum("y").alias("y_sum"),
        F.bool_and(good).alias("good"),
    )


@query
def cross_validation_errors(spark, d):
    """A month of events is too short for a cutoff."""
    return additive.cv_errors(additive.cross_validate(views.events_series(spark, d)))


@query
def cv_metrics(spark, d):
    scored = additive.cv_metrics(additive.cross_validate(daily(spark, d)))
    return scored.select(
        *KEYS,
        *[(finite(c) & (F.col(c) > 0)).alias(c) for c in ("cv_rmse", "cv_mae", "cv_mape")],
        F.col("cv_coverage").between(0.5, 1).alias("cv_coverage"),
    )


def cv_lagged(spark, d, rolling):
    """The metrics of a plain forecast: the value of a week before, within half of itself."""
    cutoffs = additive.cv_cutoffs(filled(spark, d))
    lagged = views.lagged_forecasts(filled(spark, d)).where("model = 'lag7'").drop("model")
    days = F.datediff("ds", "cutoff")
    scored = lagged.join(cutoffs, KEYS).where((days > 0) & (days <= 90))
    scored = scored.withColumns({"yhat_lower": F.col("yhat") * 0.5, "yhat_upper": F.col("yhat") * 1.5})
    table = additive.cv_metrics(scored, rolling)
    return table.select(
        *KEYS, F.round("cv_rmse", 1).alias("cv_rmse"), F.round("cv_mae", 1).alias("cv_mae"),
        F.round("cv_mape", 6).alias("cv_mape"), F.round("cv_coverage", 9).alias("cv_coverage"),
    )


@query
def cv_metrics_lagged(spark, d):
    return cv_lagged(spark, d, None)


@query
def cv_metrics_rolling(spark, d):
    return cv_lagged(spark, d, 0.1)


@query
def metrics_table_all(spark, d):
    """All metrics that occur."""
    scored = metrics.regression_metrics(views.lagged_forecasts(filled(spark, d)))
    table = metrics.metrics_table(metrics.to_long_metrics(scored, ["mape", "r2"]).where("model = 'lag1'"))
    return table


@query
def components(spark, d):
    split_df = staged_split(spark, d)
    parts = additive.components(_fitted(split_df), split_df)
    return parts.select(*KEYS, "ds", *[finite(c).alias(c) for c in ("trend", "yearly", "weekly")])


@query
def component_importance(spark, d):
    split_df = staged_split(spark, d)
    shares = additive.component_importance(_fitted(split_df), split_df.where("split <> 'test'"))
    return shares.groupBy(*KEYS).agg(
        F.count("*").alias("n_components"), F.round(F.sum("importance"), 6).alias("total")
    )


def _windows(spark, d):
    split_df = staged_split(spark, d)
    return split_df, windows.split_sequences(split_df)


@query
def fit_sequence(spark, d):
    """Every coefficient, by row of the window and input, and the intercept."""
    _, rows = _windows(spark, d)
    model = sequence.fit_sequence(rows)
    weights, intercept = model.coefficients()
    cells = [(i, name, float(v)) for i, w in enumerate(weights) for name, v in zip(model.features, w)]
    cells.append((len(weights), "intercept", float(intercept)))
    table = spark.createDataFrame(cells, "lag_row int, input string, weight double")
    return table.select("lag_row", "input", finite("weight").alias("fitted"))


@query
def predict_sequence_batch(spark, d):
    """Test windows: their number, and whether the forecasts beat the mean of the actuals."""
    _, rows = _windows(spark, d)
    scored = sequence.predict_sequence_batch(sequence.fit_sequence(rows), rows.where("split = 'test'"))
    error = F.col("y") - F.col("yhat")
    better = F.avg(error * error) < F.var_pop("y")
    return scored.groupBy(*KEYS).agg(F.count("*").alias("n"), F.bool_and(finite("yhat")).alias("all_finite"), better.alias("beats_mean"))


@query
def fit_sequence_trees(spark, d):
    """Boosted trees with the default settings: whether their last losses beat the mean of the actuals."""
    _, rows = _windows(spark, d)
    last = sequence.final_metrics(sequence.fit_sequence(rows, ModelConfig(sequence_kind="gbt")).history)
    metric = F.when(F.col("split") == "train", "loss").otherwise("val_loss").alias("metric")
    spread = rows.where("split <> 'test'").groupBy(metric).agg(F.var_pop("yt").alias("spread"))
    better = finite("value") & (F.col("value") < F.col("spread"))
    return last.join(spread, "metric").select("metric", better.alias("beats_mean"))


def one_lag(spark, d):
    """Windows of one lag of the weekly values, in millions."""
    series = splitting.temporal_split(weekly(spark, d).withColumn("y", F.col("y") / 1e6))
    return windows.split_sequences(series, longest=1, features=["y"])


ONE_LAG = ModelConfig(sequence_length=1, sequence_reg=0.0)


@query
def fit_sequence_one_lag(spark, d):
    weights, intercept = sequence.fit_sequence(one_lag(spark, d), ONE_LAG, ["y"]).coefficients()
    return spark.createDataFrame([(round(float(weights[0][0]), 6), round(float(intercept), 6))], "slope double, intercept double")


@query
def predict_sequence_one_lag(spark, d):
    rows = one_lag(spark, d)
    model = sequence.fit_sequence(rows, ONE_LAG, ["y"])
    return rounded(sequence.predict_sequence_batch(model, rows.where("split = 'test'")).drop("length"), 5, "y", "yhat")


@query
def save_load_sequence_one_lag(spark, d):
    path = scratch(spark, "model")
    rows = one_lag(spark, d)
    store.save_sequence(spark, sequence.fit_sequence(rows, ONE_LAG, ["y"]), path, ONE_LAG)
    model = store.load_sequence(spark, path)
    return rounded(sequence.predict_sequence_batch(model, rows.where("split = 'val'")).drop("length"), 5, "y", "yhat")


@query
def training_history_one_lag(spark, d):
    """The history saved with a model."""
    path = scratch(spark, "model")
    store.save_sequence(spark, sequence.fit_sequence(one_lag(spark, d), ONE_LAG, ["y"]), path, ONE_LAG)
    return rounded(store.load_sequence(spark, path).history, 6, "value")


@query
def forecast_recursive(spark, d):
    """A fixed autoregression of three lags, five steps ahead."""
    newest = in_time()
    ends = (
        filled(spark, d)
        .withColumn("window", F.collect_list("y").over(newest.rowsBetween(-2, 0)))
        .groupBy(*KEYS)
        .agg(F.max_by("window", "ds").alias("window"), F.max("ds").alias("last"))
    )
    drift = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: i * 1000.0)
    path = sequence.recursive_path(F.col("window"), drift, literal_array([0.2, 0.3, 0.5]), 3)
    rows = ends.select(*KEYS, "last", F.posexplode(path).alias("at", "yhat"))
    return rows.select(*KEYS, F.date_add("last", F.col("at") + 1).alias("ds"), F.round("yhat", 6).alias("yhat"))


# Two trees over the last three values, of different depths and weights.
GIVEN_TREES = Ensemble(
    feature=[2, 0, -1, -1, -1, 1, -1, -1],
    threshold=[700_000.0, 400_000.0, 0.0, 0.0, 0.0, 800_000.0, 0.0, 0.0],
    right=[4, 3, 2, 3, 4, 7, 6, 7],
    value=[0.0, 0.0, 750_000.0, 650_000.25, 350_000.0, 0.0, 40_000.5, -20_000.25],
    roots=[0, 5],
    weights=[1.0, 0.5],
    depth=2,
)
# Two hidden units over the last two values.
GIVEN_NETWORK = Network(
    mean=np.array([500_000.0, 400_000.0]),
    scale=np.array([250_000.0, 200_000.0]),
    inner=np.array([[0.5, -0.25], [0.75, 0.5]]),
    inner_bias=np.array([0.1, 0.2]),
    outer=np.array([300_000.0, -100_000.0]),
    outer_bias=np.array([250_000.0]),
)


def _fed_back(spark, d, kind, model, length):
    rows = filled(spark, d)
    given = sequence.SequenceModel(model, kind, length, ["y"])
    return rounded(sequence.forecast_recursive(given, rows, horizon.future_dates(rows, 6, "D")), 2, "yhat")


@query
def forecast_recursive_trees_given(spark, d):
    """Fixed trees, compiled and fed back for six days."""
    return _fed_back(spark, d, "gbt", GIVEN_TREES, 3)


@query
def forecast_recursive_network_given(spark, d):
    """A fixed network fed back for six days."""
    return _fed_back(spark, d, "network", GIVEN_NETWORK, 2)


@query
def fit_sequence_network(spark, d):
    """A network trained in epochs: whether it learns and its best losses beat the mean of the actuals."""
    rows = windows.split_sequences(staged_split(spark, d), features=["y"])
    config = ModelConfig(sequence_kind="network", sequence_units=16, sequence_epochs=10, sequence_learning_rate=0.02, sequence_dropout=0.0)
    best = sequence.fit_sequence(rows, config, ["y"]).history.groupBy("metric").agg(F.min("value").alias("value"))
    metric = F.when(F.col("split") == "train", "loss").otherwise("val_loss").alias("metric")
    spread = rows.where("split <> 'test'").groupBy(metric).agg(F.var_pop("yt").alias("spread"))
    better = finite("value") & (F.col("value") < F.col("spread"))
    return best.join(spread, "metric").select("metric", better.alias("beats_mean"))


@query
def regression_metrics(spark, d):
    table = metrics.regression_metrics(views.lagged_forecasts(filled(spark, d)))
    return table.select(
        *KEYS,
        "model",
        *[F.round(c, 1).alias(c) for c in ("mae", "rmse")],
        (F.round(F.col("mse") / 1e9, 4)).alias("mse"),
        *[F.round(c, 6).alias(c) for c in ("mape", "r2")],
    )


@query
def evaluate(spark, d):
    """Both models on the test rows; the one-step forecast has to beat the mean of the actuals."""
    split_df = staged_split(spark, d)
    config = ModelConfig()
    trained = forecasting.train_models(split_df, config=config)
    beats = (F.col("model") != "sequence") | (F.col("metric") != "r2") | (F.col("value") > 0)
    return forecasting.evaluate(trained, split_df, config).select(*KEYS, "model", "metric", (finite("value") & beats).alias("scored"))


@query
def evaluate_given(spark, d):
    """Given additive models on the test rows, every metric."""
    split_df = splitting.temporal_split(daily(spark, d))
    models = given_models(spark, d).withColumn("changepoint_prior_scale", F.lit(0.05))
    table = forecasting.evaluate(forecasting.Trained(additive=models, names=[additive.MODEL_NAME]), split_df)
    unit = F.when(F.col("metric") == "mse", 1e9).otherwise(1.0)
    return table.withColumn("value", F.round(F.col("value") / unit, 4))


@query
def train_models(spark, d):
    """Types asked for, trained in turn; an unknown one is skipped."""
    trained = forecasting.train_models(staged_split(spark, d), ["additive", "unheard-of", "sequence"])
    models = trained.additive.groupBy("group_id").agg(F.count("*").alias("n_models"))
    return models.withColumn("types", F.lit(",".join(trained.names)))


@query
def infer_freq_daily(spark, d):
    return horizon.infer_freq(daily(spark, d))


@query
def infer_freq_weekly(spark, d):
    return horizon.infer_freq(weekly(spark, d))


@query
def future_dates_weekly(spark, d):
    return horizon.future_dates(weekly(spark, d), 6)


@query
def future_dates_monthly(spark, d):
    return horizon.future_dates(views.orders_series(spark, d, "month"), 6)


def month_ends(spark, d):
    return views.orders_series(spark, d, "month").withColumn("ds", F.last_day("ds"))


@query
def infer_freq_month_end(spark, d):
    return horizon.infer_freq(month_ends(spark, d))


@query
def future_dates_month_end(spark, d):
    return horizon.future_dates(month_ends(spark, d), 14)


@query
def future_dates_quarterly(spark, d):
    return horizon.future_dates(views.orders_series(spark, d, "quarter"), 6)


@query
def future_dates_yearly(spark, d):
    return horizon.future_dates(views.orders_series(spark, d, "year"), 6)


@query
def forecast(spark, d):
    """Both models, in original units."""
    done = staged(spark, d)
    trained = forecasting.train_models(forecasting.prepare(done.data), periods=7)
    ahead = forecasting.forecast(trained, done.data, 7, scalers=done.scalers)
    return _plausible(ahead, grid(spark, d))


@query
def forecast_given(spark, d):
    """Given models of both types six days ahead, taken back to original units, in millions."""
    rows = stage_table(filled(spark, d), "filled")
    trees = sequence.SequenceModel(GIVEN_TREES, "gbt", 3, ["y"])
    trained = forecasting.Trained(straight_models(spark, d, 0.0), trees, names=[additive.MODEL_NAME, sequence.MODEL_NAME])
    ahead = forecasting.forecast(trained, rows, 6, scalers=scaling.fit_scaler(rows))
    return ahead.withColumns({c: F.round(F.col(c) / 1e6, 3) for c in ("yhat", "yhat_lower", "yhat_upper")})


def _plausible(forecasts, series):
    """Whether forecasts stay within the series' range, widened by itself on both sides."""
    span = series.groupBy(*KEYS).agg(F.min("y").alias("low"), F.max("y").alias("high"))
    width = F.col("high") - F.col("low")
    inside = F.col("yhat").between(F.col("low") - width, F.col("high") + width)
    return forecasts.join(span, KEYS).select(*KEYS, "model", "ds", (finite("yhat") & inside).alias("forecast"))


@query
def save_load_additive(spark, d):
    path = scratch(spark, "model")
    store.save_additive(additive.fit_additive(weekly(spark, d)), path)
    return store.load_additive(spark, path).select(*KEYS, "t0", "last_ds", "n_obs", "y_scale")


@query
def save_load_sequence(spark, d):
    """Whether a model that was saved and loaded forecasts every window as before."""
    path = scratch(spark, "model")
    _, rows = _windows(spark, d)
    model = sequence.fit_sequence(rows)
    store.save_sequence(spark, model, path)
    before = sequence.predict_sequence_batch(model, rows)
    again = sequence.predict_sequence_batch(store.load_sequence(spark, path), rows)
    again = again.select(*KEYS, "ds", F.col("yhat").alias("again"))
    same = F.bool_and((F.col("yhat") == F.col("again")) & finite("yhat"))
    return before.join(again, [*KEYS, "ds"]).groupBy(*KEYS, "split").agg(F.count("*").alias("n"), same.alias("same"))


@query
def training_history(spark, d):
    _, rows = _windows(spark, d)
    history = sequence.training_history(sequence.fit_sequence(rows), rows)
    return history.select("iteration", "metric", (finite("value") & (F.col("value") < 1)).alias("small"))


@query
def run_all_nations(spark, d):
    """Everything from raw series to forecasts, for all nations at once."""
    series = merging.complete_grid(views.nation_series(spark, d))
    done = forecasting.run(series, AppConfig(), periods=4)
    return _plausible(done["forecasts"], series)


@query
def preprocess_suppliers(spark, d):
    rows = preprocess(supplier_grid(spark, d)).data
    return rounded(rows.select(*KEYS, "ds", "y", "y_original"), 6, "y", "y_original")


@query
def split_suppliers(spark, d):
    return splitting.temporal_split(supplier_grid(spark, d)).groupBy(*KEYS, "split").agg(F.count("*").alias("n"))


@query
def fit_additive_suppliers(spark, d):
    rows = additive.fit_additive(views.supplier_series(spark, d))
    return rows.select(*KEYS, "t0", "last_ds", "n_obs", "y_scale")


@query
def forecast_suppliers(spark, d):
    models = stage_table(additive.fit_additive(views.supplier_series(spark, d)), "additive")
    ahead = additive.predict_horizon(models, 12, "W")
    return ahead.select(*KEYS, "ds", F.col("yhat").isNotNull().alias("forecast"))


# Reports.


@query
def correlation_suppliers(spark, d):
    """Supplier revenue within a nation, over the weeks both sold in."""
    return correlation.correlation_matrix(views.supplier_series(spark, d), 6)


@query
def correlation_matrix(spark, d):
    return correlation.correlation_matrix(daily(spark, d), 6)


@query
def correlation_lower(spark, d):
    return correlation.correlation_lower(views.nation_series(spark, d), 2)


@query
def correlation_lower_requested(spark, d):
    """Series in the order they were asked for."""
    return correlation.correlation_lower(daily(spark, d), 6, order=PRIORITIES[::-1])


@query
def correlation_strongest(spark, d):
    """The three strongest partners of each supplier in its nation."""
    best = correlation.correlation_matrix(views.supplier_series(spark, d), 6, size=8, top_k=3)
    return best.groupBy("group_id", "a").agg(F.count("*").alias("n"), F.max(F.abs("corr")).alias("strongest"))


@query
def strongest_partners(spark, d):
    """The strongest partner of each supplier in its nation, found without comparing all blocks."""
    best = partners.strongest_partners(views.supplier_series(spark, d), 1, size=16, pivots=8)
    return rounded(best.select("group_id", "a", F.abs("corr").alias("strongest")), 6, "strongest")


@query
def seasonal_decompose_weekly(spark, d):
    rows = decomposition.seasonal_decompose(weekly_filled(spark, d), 52)
    return rounded(rows, 4, "y", "trend", "seasonal", "resid")


@query
def seasonal_decompose_default(spark, d):
    rows = decomposition.seasonal_decompose(filled(spark, d))
    return rounded(rows.select(*KEYS, "ds", "period", "status", "trend", "seasonal"), 3, "trend", "seasonal")


@query
def overview(spark, d):
    return reports.overview(grid(spark, d))


@query
def last_n(spark, d):
    return reports.last_n(daily(spark, d), 10)


@query
def distribution(spark, d):
    return rounded(reports.distribution(daily(spark, d)), 2, "bin_from", "bin_to", "mean", "median")


@query
def metrics_table(spark, d):
    scored = metrics.regression_metrics(views.lagged_forecasts(filled(spark, d)))
    return metrics.metrics_table(metrics.to_long_metrics(scored, ["mape", "r2"]), ["mape", "r2"])


@query
def rank_models(spark, d):
    scored = metrics.regression_metrics(views.lagged_forecasts(filled(spark, d)))
    ranked = metrics.rank_models(metrics.to_long_metrics(scored))
    return ranked.select(*KEYS, "model", "metric", "rank")


@query
def forecast_summary(spark, d):
    return reports.forecast_summary(views.plain_forecasts(filled(spark, d), 14))


@query
def forecast_context(spark, d):
    series = filled(spark, d)
    rows = reports.forecast_context(series, views.plain_forecasts(series, 14))
    return rounded(rows, 2, "value")


@query
def backtest_table(spark, d):
    series = filled(spark, d)
    test = splitting.temporal_split(series).where("split = 'test'")
    return rounded(metrics.backtest_table(test, views.lagged_forecasts(series).drop("y")), 2, "actual", "predicted")


@query
def report_tables(spark, d):
    """Rows per table of a report."""
    series = filled(spark, d)
    scored = metrics.to_long_metrics(metrics.regression_metrics(views.lagged_forecasts(series)))
    tables = reports.report_tables(series, views.plain_forecasts(series, 14), scored)
    sizes = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    out = sizes[0]
    for size in sizes[1:]:
        out = out.unionByName(size)
    return out


@query
def report_values(spark, d):
    """Every row of every table of a report; ``item`` is a date, a series, a forecast's model and date, or a model."""
    series = filled(spark, d)
    scored = metrics.to_long_metrics(metrics.regression_metrics(views.lagged_forecasts(series)))
    tables = reports.report_tables(series, views.plain_forecasts(series, 14), scored)
    day = F.col("ds").cast("string")
    items = {
        "history": (F.col("series_id"), day, F.round("y", 6)),
        "correlation": (F.col("a"), F.col("b"), F.round("corr", 6)),
        "forecast": (F.col("series_id"), F.concat_ws(" ", "kind", day), F.round("value", 6)),
        "rmse": (F.col("series_id"), F.col("model"), F.round("value", 1)),
    }
    out = None
    for name, (key, item, value) in items.items():
        part = tables[name].select(
            F.lit(name).alias("name"), "group_id", key.alias("series_id"), item.alias("item"), value.alias("value")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _hourly(spark, d):
    return fine.cut_series(views.events_hourly(spark, d), size=256)


@query
def hourly_fill_time(spark, d):
    return rounded(fine.uncut(fine.fill_time(_hourly(spark, d))), 6, "y")


@query
def hourly_smooth(spark, d):
    rows = fine.smooth(fine.fill_time(_hourly(spark, d)), 24)
    return rounded(fine.uncut(rows), 6, "y", "y_original")


@query
def hourly_sequences(spark, d):
    """Windows of two days before each hour, and the next three values: their sizes, ends and sums."""
    rows = fine.make_sequences(fine.fill_time(_hourly(spark, d)), length=48, steps=3)
    first = F.element_at("x", 1)[0].cast("double")
    total = F.aggregate("x", F.lit(0.0), lambda acc, row: acc + row[0].cast("double"))
    ahead = F.aggregate("yt", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return rows.select(*KEYS, "ds", F.size("x").alias("n"), F.round(first, 4).alias("first"), F.round(total, 3).alias("total"), F.round(ahead, 4).alias("ahead"))


@query
def hourly_decompose(spark, d):
    rows = fine.seasonal_decompose(fine.fill_time(_hourly(spark, d)), 24)
    return rounded(rows.select(*KEYS, "ds", "period", "status", "trend", "seasonal", "resid"), 5, "trend", "seasonal", "resid")


# Trend, daily and weekly wave of a model written by hand.
GIVEN_FINE = """
select group_id, series_id, date'2024-01-01' as t0, 29.0D as t_days, 4.0D as y_scale, 0.5D as k, 0.25D as m, 0.1D as sigma,
  array(0.4D) as changepoints, array(-0.3D) as deltas,
  array(named_struct('name', 'weekly', 'period', 7.0D, 'mode', 'additive', 'coef', array(0.05D, -0.02D)),
    named_struct('name', 'daily', 'period', 1.0D, 'mode', 'additive', 'coef', array(0.2D, 0.1D, -0.05D, 0.03D))) as terms,
  cast(null as string) as error
from {series} group by group_id, series_id
"""


def _given_fine(spark, d):
    rows = views.events_hourly(spark, d)
    return spark.sql(GIVEN_FINE, series=rows), rows


@query
def hourly_components_given(spark, d):
    """Trend, weekly and daily component of a given model at every hour, and their sum."""
    models, rows = _given_fine(spark, d)
    parts = additive.components(models, rows, ("weekly", "daily"))
    both = parts.join(additive.predict_dates(models, rows), [*KEYS, "ds"])
    return rounded(both, 6, "trend", "weekly", "daily", "yhat")


@query
def hourly_component_importance_given(spark, d):
    models, rows = _given_fine(spark, d)
    return rounded(additive.component_importance(models, rows, ("weekly", "daily")), 6, "importance")


@query
def hourly_fit(spark, d):
    """Hourly models with a daily component: forecasts of a day ahead, which stay within the range of the data."""
    rows = views.events_hourly(spark, d)
    config = ModelConfig(yearly_seasonality=False, daily_seasonality=True)
    models = stage_table(fine_models.fit_additive(rows, config, size=256), "hourly-models")
    ahead = additive.predict_dates(models, fine_models.horizon_times(models, 24))
    span = rows.groupBy(*KEYS).agg(F.max("y").alias("top"))
    near = finite("yhat") & (F.abs("yhat") <= 2 * F.col("top"))
    return ahead.join(span, KEYS).select(*KEYS, "ds", near.alias("near"))
