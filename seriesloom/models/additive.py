"""The seasonal additive forecaster over many series.

Python runs only where a series is fitted or simulated; applying a fitted model
to dates is a column expression over the parameter table.
"""

from __future__ import annotations

import datetime as dt
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import ModelConfig
from ..functions import additive_terms as terms
from ..functions.calendar import known, step_date
from ..schema import KEYS, by_series, check_series, is_fine
from ..session import spread_series
from . import map_fit

MODEL_NAME = "additive"
EPOCH = dt.date(1970, 1, 1)

_TERM = (
    T.StructType()
    .add("name", "string")
    .add("period", "double")
    .add("mode", "string")
    .add("coef", T.ArrayType(T.DoubleType()))
)
PARAMS_SCHEMA = (
    T.StructType()
    .add("group_id", "string")
    .add("series_id", "string")
    .add("t0", "date")
    .add("t_days", "double")
    .add("y_scale", "double")
    .add("k", "double")
    .add("m", "double")
    .add("sigma", "double")
    .add("changepoints", T.ArrayType(T.DoubleType()))
    .add("deltas", T.ArrayType(T.DoubleType()))
    .add("terms", T.ArrayType(_TERM))
    .add("n_obs", "long")
    .add("last_ds", "date")
    .add("changepoint_prior_scale", "double")
    .add("passes", "integer")
    .add("converged", "boolean")
    .add("error", "string")
)
FORECAST_SCHEMA = "group_id string, series_id string, ds date, yhat double, yhat_lower double, yhat_upper double"


def _date(day: int) -> dt.date:
    return EPOCH + dt.timedelta(days=int(day))


def _day(date: dt.date) -> int:
    return (date - EPOCH).days


def _observations(df: DataFrame) -> DataFrame:
    """Mean, count and squared spread per date.

    Makes a date one row however often it is observed, so that what a task
    receives for a series is bounded by the calendar. Combines on the map side.
    """
    seen = check_series(df).where(known("y").isNotNull() & F.col("ds").isNotNull())
    return seen.groupBy(*KEYS, F.unix_date("ds").alias("day")).agg(
        F.avg("y").alias("mean"),
        F.count("*").cast("double").alias("weight"),
        (F.var_pop("y") * F.count("*")).alias("within"),
    )


def _fit_arrays(day: np.ndarray, mean: np.ndarray, weight: np.ndarray, within: np.ndarray, config: ModelConfig) -> dict:
    order = np.argsort(day)
    return map_fit.fit_map(day[order], mean[order], weight[order], float(within.sum()), config)


_FIT_INPUTS = ["day", "mean", "weight", "within"]
_FIT_FAILURES = (ValueError, ArithmeticError, np.linalg.LinAlgError)


def fit_additive(df: DataFrame, config: ModelConfig = ModelConfig(), spread: bool = True) -> DataFrame:
    """One parameter row per series. Rows without a date or value are left out.

    Series are dealt over all shuffle partitions; with ``spread`` off they are fitted
    where they lie, if the table is bucketed by series (see ``write_processed``).

    A series that cannot be fitted gets a row with ``error`` set; the others are
    not affected. Series finer than a day are fitted by ``models.fine``.
    """
    if config.daily_seasonality:
        raise ValueError("daily_seasonality needs series finer than a day")
    schema = to_arrow_schema(PARAMS_SCHEMA)

    def fit(rows: pa.Table) -> pa.Table:
        out = {name: rows.column(name)[0].as_py() for name in KEYS}
        try:
            fitted = _fit_arrays(*[rows.column(c).to_numpy() for c in _FIT_INPUTS], config)
            fitted["t0"], fitted["last_ds"] = _date(fitted["t0"]), _date(fitted.pop("last_day"))
            out.update(fitted, changepoint_prior_scale=config.changepoint_prior_scale)
        except _FIT_FAILURES as problem:
            out["error"] = str(problem)
        return pa.Table.from_pylist([out], schema=schema)

    rows = _observations(df)
    return (spread_series(rows) if spread else rows).groupBy(*KEYS).applyInArrow(fit, PARAMS_SCHEMA)


def usable(models: DataFrame) -> DataFrame:
    return models.where(F.col("error").isNull())


def model_errors(models: DataFrame, stage: str = "fit") -> DataFrame:
    failed = models.where(F.col("error").isNotNull())
    return failed.select(*KEYS, F.lit(MODEL_NAME).alias("model"), F.lit(stage).alias("stage"), "error")


def predict_dates(models: DataFrame, dates: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """yhat for the dates of a (group_id, series_id, ds) table, next to the columns to ``keep``."""
    joined = dates.select(*KEYS, "ds", *keep).join(usable(models), KEYS)
    return joined.select(*KEYS, "ds", *keep, terms.yhat(F.col("ds"), is_fine(dates)).alias("yhat"))


def horizon_dates(models: DataFrame, periods: int, freq: str | DataFrame = "D") -> DataFrame:
    """The ``periods`` dates after the end of training of each model.

    ``freq`` is one step (see ``step_date``) for all series, or the table of ``infer_freq``.
    """
    last = usable(models).select(*KEYS, "last_ds")
    if isinstance(freq, str):
        stepped = last.withColumns({"freq": F.lit(freq), "gap_days": F.lit(1)})
    else:
        stepped = last.join(freq, KEYS)
        if "gap_days" not in freq.columns:
            stepped = stepped.withColumn("gap_days", F.lit(1))
    ahead = stepped.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    return ahead.select(*KEYS, step_date(F.col("last_ds"), F.col("freq"), F.col("step"), F.col("gap_days")).alias("ds"))


def predict_horizon(models: DataFrame, periods: int, freq: str | DataFrame = "D") -> DataFrame:
    """yhat for the periods after training."""
    return predict_dates(models, horizon_dates(models, periods, freq))


def _seed(base: int, *key: str) -> int:
    return zlib.crc32("\x00".join(key).encode()) ^ base


def _params_of(row: dict) -> dict:
    return {**row, "t0": _day(row["t0"])}


def _interval_rows(group, series, ds, yhat, lower, upper) -> pd.DataFrame:
    return pd.DataFrame(
        {"group_id": group, "series_id": series, "ds": ds, "yhat": yhat, "yhat_lower": lower, "yhat_upper": upper}
    )


def predict_interval(models: DataFrame, dates: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """yhat with its uncertainty interval for the dates of a table.

    The dates of a series travel as one array next to its parameters, so that
    simulating needs no further grouping. The seed depends on the series only:
    a run repeats whatever the partitioning.
    """
    wanted = dates.where(F.col("ds").isNotNull()).groupBy(*KEYS).agg(F.array_sort(F.collect_set("ds")).alias("dates"))

    def simulate(batches):
        for batch in batches:
            for row in batch.to_dict("records"):
                days = np.array([_day(d) for d in row["dates"]])
                seed = _seed(config.random_state, row["group_id"], row["series_id"])
                values = map_fit.simulate(
                    _params_of(row), days, config.uncertainty_samples, config.interval_width, seed
                )
                yield _interval_rows(row["group_id"], row["series_id"], row["dates"], *values)

    return usable(models).drop("error").join(wanted, KEYS).mapInPandas(simulate, FORECAST_SCHEMA)


def predict_horizon_interval(
    models: DataFrame, periods: int, freq: str | DataFrame = "D", config: ModelConfig = ModelConfig()
) -> DataFrame:
    return predict_interval(models, horizon_dates(models, periods, freq), config)


def components(models: DataFrame, df: DataFrame, names=("yearly", "weekly")) -> DataFrame:
    """Trend and seasonal values on the dates of ``df``, one column per component."""
    at, fine = F.col("ds"), is_fine(df)
    joined = df.select(*KEYS, "ds").join(usable(models), KEYS)
    return joined.select(
        *KEYS, "ds", terms.trend(at, fine).alias("trend"), *[terms.component(at, n, fine).alias(n) for n in names]
    )


def component_importance(models: DataFrame, df: DataFrame, names=("yearly", "weekly")) -> DataFrame:
    """Spread of each component over the dates of ``df``, in percent of their sum.

    If every spread is zero they stay zero. A series without a usable model has
    no rows.
    """
    parts = ["trend", *names]
    spread = components(models, df, names).groupBy(*KEYS).agg(*[F.stddev_pop(c).alias(c) for c in parts])
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in parts), F.lit(0.0))
    shares = {c: F.when(total > 0, F.col(c) / total * 100).otherwise(F.col(c)) for c in parts}
    return spread.select(*KEYS, *[e.alias(c) for c, e in shares.items()]).unpivot(
        KEYS, parts, "component", "importance"
    ).where(F.col("importance").isNotNull())


def cv_cutoffs(df: DataFrame, initial: int = 730, period: int = 180, horizon: int = 90) -> DataFrame:
    """Cutoffs of each series: from ``horizon`` days before its end, back by
    ``period`` while ``initial`` days of history remain."""
    span = df.where(known("y").isNotNull()).groupBy(*KEYS).agg(F.min("ds").alias("first"), F.max("ds").alias("last"))
    room = F.datediff("last", "first") - horizon - initial
    return (
        span.withColumn("room", room)
        .where(F.col("room") >= 0)
        .withColumn("back", F.explode(F.sequence(F.lit(0), F.floor(F.col("room") / period))))
        .select(*KEYS, F.date_sub("last", (F.lit(horizon) + F.col("back") * period).cast("int")).alias("cutoff"))
    )


_CV_SCHEMA = (
    "group_id string, series_id string, cutoff date, ds date, y double, yhat double, yhat_lower double, "
    "yhat_upper double, error string"
)


def cross_validate(
    df: DataFrame, config: ModelConfig = ModelConfig(), initial: int = 730, period: int = 180, horizon: int = 90
) -> DataFrame:
    """Rolling-origin forecasts: fit up to each cutoff, score the horizon after it.

    Each cutoff of a series is a task's work of its own, with the history up to it;
    a series comes at most (span - initial - horizon) / period + 1 times. A series too
    short for a cutoff, a cutoff without rows to score and a fit that fails give a row
    with ``error`` and no date; see ``cv_errors``.
    """
    cutoffs = cv_cutoffs(df, initial, period, horizon)
    rows = _observations(df)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reach = F.unix_date("cutoff") + horizon
    dealt = rows.join(cutoffs, KEYS).where(F.col("day") <= reach).repartition(tasks, *KEYS, "cutoff")

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        group, series, cutoff = (rows[c].iat[0] for c in (*KEYS, "cutoff"))
        edge = _day(cutoff)
        past, ahead = rows[rows["day"] <= edge], rows[rows["day"] > edge].sort_values("day")
        try:
            if ahead.empty:
                raise ValueError("No rows after the cutoff")
            params = _fit_arrays(*[past[c].to_numpy() for c in _FIT_INPUTS], config)
            days = ahead["day"].to_numpy()
            seed = _seed(config.random_state, group, series, cutoff.isoformat())
            values = map_fit.simulate(params, days, config.uncertainty_samples, config.interval_width, seed)
        except _FIT_FAILURES as problem:
            failed = pd.DataFrame({"group_id": [group], "series_id": [series], "cutoff": [cutoff], "ds": [None]})
            return failed.assign(y=np.nan, yhat=np.nan, yhat_lower=np.nan, yhat_upper=np.nan, error=str(problem))
        part = _interval_rows(group, series, [_date(d) for d in days], *values)
        part.insert(2, "cutoff", cutoff)
        part.insert(4, "y", ahead["mean"].to_numpy())
        return part.assign(error=None)

    scored = dealt.groupBy(*KEYS, "cutoff").applyInPandas(score, _CV_SCHEMA)
    short = df.select(*KEYS).distinct().join(cutoffs.select(*KEYS).distinct(), KEYS, "left_anti")
    names = [part.split()[0] for part in _CV_SCHEMA.split(", ")]
    empty = {c: F.lit(None) for c in names if c not in KEYS}
    empty["error"] = F.lit("Too short for a cutoff")
    return scored.unionByName(short.select(*KEYS, *[v.alias(c) for c, v in empty.items()]))


def cv_errors(scored: DataFrame) -> DataFrame:
    """The series and cutoffs that could not be scored, and why."""
    return scored.where(F.col("error").isNotNull()).select(*KEYS, "cutoff", "error")


_CV_METRICS = ["cv_rmse", "cv_mae", "cv_mape", "cv_coverage"]


def cv_metrics(scored: DataFrame, rolling: float | None = 0.1) -> DataFrame:
    """cv_rmse, cv_mae, cv_mape (a fraction) and cv_coverage of each series.

    Rows are put in order of their horizon. Each metric is taken over a window of
    the share ``rolling`` of a series' rows, ending at each horizon that has so many
    rows up to it, and averaged over those windows; of the horizon that a window
    starts in, its mean counts for the rows that are still missing. With ``rolling``
    None each day of the horizon is a window. Days with a zero actual have no mape.
    Rows with an ``error`` take no part.
    """
    if "error" in scored.columns:
        scored = scored.where(F.col("error").isNull())
    error = F.col("y") - F.col("yhat")
    inside = (F.col("y") >= F.col("yhat_lower")) & (F.col("y") <= F.col("yhat_upper"))
    means = {
        "cv_rmse": F.avg(error * error),
        "cv_mae": F.avg(F.abs(error)),
        "cv_mape": F.avg(F.when(F.col("y") != 0, F.abs(error / F.col("y")))),
        "cv_coverage": F.avg(inside.cast("double")),
    }
    by_day = scored.groupBy(*KEYS, F.datediff("ds", "cutoff").alias("h")).agg(
        F.count("*").alias("n"), *[m.alias(c) for c, m in means.items()]
    )
    windows = by_day if rolling is None else _rolling(by_day, rolling)
    windows = windows.withColumn("cv_rmse", F.sqrt("cv_rmse"))
    return windows.groupBy(*KEYS).agg(*[F.avg(c).alias(c) for c in _CV_METRICS])


def _rolling(by_day: DataFrame, share: float) -> DataFrame:
    """Means over windows of rows that end at each horizon; a series has a row per day of it at most."""
    series = by_series()
    in_horizon = series.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    counted = by_day.withColumn("upto", F.sum("n").over(in_horizon)).withColumn("total", F.sum("n").over(series))
    counted = counted.withColumn("width", F.greatest(F.lit(1), F.floor(F.col("total") * share)))
    # Sums of a metric over the days that have it, up to a horizon.
    for c in _CV_METRICS:
        counted = counted.withColumn(f"{c}_sum", F.coalesce(F.sum(F.col(c) * F.col("n")).over(in_horizon), F.lit(0.0)))
        counted = counted.withColumn(f"{c}_n", F.sum(F.when(F.col(c).isNotNull(), F.col("n")).otherwise(0)).over(in_horizon))
    starts = counted.select(
        *KEYS, (F.col("upto") - F.col("n")).alias("from_row"), F.col("upto").alias("to_row"),
        *[F.col(c).alias(f"{c}_first") for c in _CV_METRICS],
        *[F.col(f"{c}_{kind}").alias(f"{c}_first_{kind}") for c in _CV_METRICS for kind in ("sum", "n")],
    )
    begin = F.col("upto") - F.col("width")
    # The day the window starts in: rows before ``begin`` are not in it.
    paired = counted.where(begin >= 0).join(starts, KEYS).where((F.col("from_row") <= begin) & (begin < F.col("to_row")))
    part = F.col("to_row") - begin
    out = {}
    for c in _CV_METRICS:
        own = F.col(f"{c}_first")
        whole_sum, whole_n = F.col(f"{c}_sum") - F.col(f"{c}_first_sum"), F.col(f"{c}_n") - F.col(f"{c}_first_n")
        total = whole_sum + F.coalesce(own * part, F.lit(0.0))
        rows = whole_n + F.when(own.isNotNull(), part).otherwise(0)
        out[c] = F.when(rows > 0, total / rows)
    return paired.select(*KEYS, "h", *[v.alias(c) for c, v in out.items()])
