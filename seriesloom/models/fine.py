"""The additive model of series finer than a day, with its daily component.

A series may be too long for a task, so its rows are summed where they lie: each piece
gives the Gram matrix of its design, and the fit of a series works on the sum of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import ModelConfig
from ..functions.additive_terms import days_of
from ..functions.calendar import known
from ..operators.fine import PIECE, cut_series
from ..schema import KEYS, check_fine
from ..session import stage_table
from . import additive, map_fit

# Pieces whose sums one task adds up first.
FAN = 64

# The parameters of ``additive``, but for the end of training, which is a point in time.
PARAMS_SCHEMA = T.StructType(
    [T.StructField("last_ds", T.TimestampNTZType()) if f.name == "last_ds" else f for f in additive.PARAMS_SCHEMA.fields]
)
_SUMS = "group_id string, series_id string, block long, gram array<double>, moment array<double>, total double, within double"


def _headers(cut: DataFrame, config: ModelConfig) -> DataFrame:
    """Per series what its design needs: start, span, scale, counts and the times of its changepoints."""
    head = cut.groupBy(*KEYS).agg(
        F.floor(F.min("day")).cast("int").alias("t0_day"),
        F.max("day").alias("last_day"),
        F.max("ds").alias("last_ds"),
        F.max(F.abs("y")).alias("top"),
        F.count("*").alias("n"),
        F.sum("weight").alias("n_obs"),
    )
    reach = F.floor(F.col("n") * F.lit(config.changepoint_range))
    bends = F.greatest(F.least(F.lit(config.n_changepoints), reach - 1), F.lit(0))
    head = head.withColumn("reach", reach).withColumn("bends", bends)
    wanted = head.where("bends > 0").select(*KEYS, "reach", "bends", F.explode(F.sequence(F.lit(1), F.col("bends"))).alias("i"))
    # The rounding of an even spread over the first rows.
    wanted = wanted.select(*KEYS, F.bround(F.col("i") * (F.col("reach") - 1) / F.col("bends"), 0).cast("long").alias("at"))
    times = cut.join(wanted, [*KEYS, "at"]).groupBy(*KEYS).agg(F.array_sort(F.collect_list("day")).alias("bend_days"))
    head = head.join(times, KEYS, "left")
    return head.select(
        *KEYS,
        "t0_day",
        "last_ds",
        "n",
        "n_obs",
        (F.col("last_day") - F.col("t0_day")).alias("t_days"),
        F.when(F.col("top") > 0, F.col("top")).otherwise(1.0).alias("y_scale"),
        F.coalesce("bend_days", F.array().cast("array<double>")).alias("bend_days"),
    )


def fit_additive(df: DataFrame, config: ModelConfig = ModelConfig(), size: int = PIECE) -> DataFrame:
    """One parameter row per series of points in time; see ``additive.fit_additive``.

    Times are days with a fraction, from the midnight before the first row on. Repeated
    times count as observations of their mean. Seasons are additive: multiplicative ones
    need passes over the rows and are refused. Rows without a time or value are left out;
    a series that cannot be fitted gets a row with ``error``.
    """
    terms = map_fit.terms_of(config)
    if any(term.mode != "additive" for term in terms):
        raise ValueError("Series finer than a day take additive seasons only")
    rows = check_fine(df).where(known("y").isNotNull() & F.col("ds").isNotNull())
    seen = rows.groupBy(*KEYS, F.col("ds").cast("timestamp_ntz").alias("ds")).agg(
        F.avg("y").alias("y"), F.count("*").cast("double").alias("weight"), (F.var_pop("y") * F.count("*")).alias("within")
    )
    cut = cut_series(seen, size).withColumn("day", days_of(F.col("ds"), fine=True))
    head = stage_table(_headers(cut, config), "headers")

    def summed(rows: pa.Table) -> pa.Table:
        first = {name: rows[name][0].as_py() for name in (*KEYS, "t0_day", "t_days", "y_scale", "bend_days", "piece")}
        days = rows["day"].to_numpy()
        span = first["t_days"] or 1.0
        bends = (np.array(first["bend_days"]) - first["t0_day"]) / span
        design = map_fit.additive_design(days, (days - first["t0_day"]) / span, bends, terms)
        ridge = map_fit.Ridge.of(design, rows["y"].to_numpy() / first["y_scale"], rows["weight"].to_numpy())
        within = rows["within"].to_numpy().sum() / first["y_scale"] ** 2
        return _packed(first, first["piece"] // FAN, ridge, within)

    def added(rows: pa.Table) -> pa.Table:
        return _packed({name: rows[name][0].as_py() for name in KEYS}, rows["block"][0].as_py(), *_total(rows))

    def solved(rows: pa.Table, about: pa.Table) -> pa.Table:
        row = about.to_pylist()[0]
        out = {name: row[name] for name in KEYS}
        try:
            if row["n"] < 2:
                raise ValueError("A series needs two times with a value")
            ridge, within = _total(rows)
            if not np.isfinite(ridge.moment).all() or not np.isfinite(row["y_scale"]):
                raise ValueError("A series needs finite values")
            bends = (np.array(row["bend_days"]) - row["t0_day"]) / row["t_days"]
            out |= map_fit.fit_summed(ridge, row["n_obs"], within, bends, terms, config)
            out |= {"t0": additive._date(row["t0_day"]), "t_days": row["t_days"], "y_scale": row["y_scale"], "last_ds": row["last_ds"]}
            out["changepoint_prior_scale"] = config.changepoint_prior_scale
        except additive._FIT_FAILURES as problem:
            out["error"] = str(problem)
        return pa.Table.from_pylist([out], schema=to_arrow_schema(PARAMS_SCHEMA))

    sums = cut.join(head, KEYS).groupBy(*KEYS, "piece").applyInArrow(summed, _SUMS)
    sums = sums.groupBy(*KEYS, "block").applyInArrow(added, _SUMS)
    return sums.groupBy(*KEYS).cogroup(head.groupBy(*KEYS)).applyInArrow(solved, PARAMS_SCHEMA)


def _packed(key: dict, block: int, ridge: map_fit.Ridge, within: float) -> pa.Table:
    return pa.table(
        {
            "group_id": pa.array([key["group_id"]], pa.string()),
            "series_id": pa.array([key["series_id"]], pa.string()),
            "block": pa.array([block], pa.int64()),
            "gram": pa.array([ridge.gram.ravel()], pa.list_(pa.float64())),
            "moment": pa.array([ridge.moment], pa.list_(pa.float64())),
            "total": [float(ridge.total)],
            "within": [float(within)],
        }
    )


def _total(rows: pa.Table) -> tuple[map_fit.Ridge, float]:
    """The sums of several pieces, always in the same order."""
    order = np.argsort(rows["total"].to_numpy(), kind="stable")
    gram, moment = (np.array(rows[c].to_pylist())[order].sum(axis=0) for c in ("gram", "moment"))
    size = len(moment)
    ridge = map_fit.Ridge(gram.reshape(size, size), moment, float(rows["total"].to_numpy()[order].sum()))
    return ridge, float(rows["within"].to_numpy()[order].sum())


def horizon_times(models: DataFrame, periods: int, seconds: int = 3600) -> DataFrame:
    """The ``periods`` times after the end of training of each model, ``seconds`` apart."""
    ahead = additive.usable(models).select(*KEYS, "last_ds", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    return ahead.select(*KEYS, F.timestamp_add("SECOND", F.col("step") * seconds, F.col("last_ds")).alias("ds"))
