"""From raw series to scored models and forecasts, for all series at once."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AppConfig, ModelConfig
from ..models import additive, sequence, store
from ..operators.horizon import future_dates
from ..operators.metrics import METRICS, regression_metrics, to_long_metrics
from ..operators.reports import report_tables
from ..operators.scaling import inverse_scale
from ..operators.splitting import temporal_split
from ..operators.windows import adaptive_length, split_sequences
from ..schema import KEYS
from ..session import spread_series, stage_table
from ..sources.results import results_summary, write_predictions, write_summary
from .preprocess import preprocess

log = logging.getLogger(__name__)

ALL_TYPES = (sequence.MODEL_NAME, additive.MODEL_NAME)
METRICS_SCHEMA = "group_id string, series_id string, model string, metric string, value double"
FORECASTS_SCHEMA = (
    "group_id string, series_id string, model string, ds date, yhat double, yhat_lower double, yhat_upper double"
)
ERRORS_SCHEMA = "group_id string, series_id string, model string, stage string, error string"


@dataclass
class Trained:
    """Models by type; ``errors`` says which series or types failed, and where.

    ``tables`` has those of registered types beside the additive one.
    """

    additive: DataFrame | None = None
    sequence: sequence.SequenceModel | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    errors: list[DataFrame] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def prepare(rows: DataFrame, config: ModelConfig = ModelConfig()) -> DataFrame:
    """Processed rows with their split, placed for model fitting."""
    return temporal_split(spread_series(rows), config.test_size, config.validation_split)


def _type_error(split_df: DataFrame, model: str, stage: str, problem: Exception) -> DataFrame:
    none = F.lit(None).cast("string")
    return split_df.sparkSession.range(1).select(
        none.alias("group_id"),
        none.alias("series_id"),
        F.lit(model).alias("model"),
        F.lit(stage).alias("stage"),
        F.lit(str(problem)).alias("error"),
    )


def train_models(
    split_df: DataFrame, types=ALL_TYPES, config: ModelConfig = ModelConfig(), periods: int = 30
) -> Trained:
    """Fit every registered type asked for. An unknown type is skipped, a failing one isolated.

    Boosted trees that forecast each step directly (``sequence_direct``) are trained for
    ``periods`` steps ahead; all other models forecast one step, which is fed back.
    """
    out = Trained()
    for kind in types:
        try:
            if kind == additive.MODEL_NAME:
                # Fitted on train and val rows; evaluation and forecast both read it.
                models = additive.fit_additive(split_df.where(F.col("split") != "test"), config)
                out.additive = stage_table(models, "additive-models")
                out.errors.append(additive.model_errors(out.additive))
            elif kind == sequence.MODEL_NAME:
                direct = config.sequence_kind == "gbt" and config.sequence_direct
                steps = sequence.horizon_steps(periods) if direct else None
                windows = split_sequences(split_df, config.sequence_length, steps=steps)
                out.sequence = sequence.fit_sequence(windows, config)
                out.errors.append(sequence.sequence_errors(split_df, windows))
            elif kind in store.list_models():
                rows = split_df.where(F.col("split") != "test")
                out.tables[kind] = stage_table(store.get_model(kind).fit(rows, config), f"{kind}-models")
            else:
                log.warning("Unknown model type: %s", kind)
                continue
            out.names.append(kind)
        except Exception as problem:  # one type must not stop the others
            log.error("Failed to train %s: %s", kind, problem)
            out.errors.append(_type_error(split_df, kind, "fit", problem))
    return out


def score_test(trained: Trained, split_df: DataFrame, config: ModelConfig = ModelConfig()) -> dict[str, DataFrame]:
    """Actual and forecast on the test rows, per model type."""
    scored = {}
    if trained.additive is not None:
        test = split_df.where(F.col("split") == "test")
        scored[additive.MODEL_NAME] = additive.predict_dates(trained.additive, test, keep=("y",))
    if trained.sequence is not None:
        windows = split_sequences(split_df, config.sequence_length).where(F.col("split") == "test")
        scored[sequence.MODEL_NAME] = sequence.predict_sequence_batch(trained.sequence, windows)
    for name, models in trained.tables.items():
        test = split_df.where(F.col("split") == "test")
        scored[name] = store.get_model(name).predict(models, test, keep=("y",))
    return scored


def _model_metrics(trained: Trained, model: str, scored: DataFrame) -> DataFrame:
    """metrics rows of one model type: the common five, and its own."""
    common = regression_metrics(scored, KEYS)
    if model in trained.tables:
        return to_long_metrics(common.withColumn("model", F.lit(model)))
    if model == additive.MODEL_NAME:
        own = additive.usable(trained.additive).select(*KEYS, "changepoint_prior_scale")
        names = [*METRICS, "changepoint_prior_scale"]
    else:
        own = sequence.loss_metrics(scored)
        names = [*METRICS, "test_loss", "test_mae", "test_mape"]
    return to_long_metrics(common.join(own, KEYS).withColumn("model", F.lit(model)), names)


def evaluate(
    trained: Trained, split_df: DataFrame, config: ModelConfig = ModelConfig(), scalers: DataFrame | None = None
) -> DataFrame:
    """metrics(group_id, series_id, model, metric, value) on the test rows.

    Next to the common five a type adds its own: the additive model its prior
    scale, the sequence model its test losses. Values are in the units of
    ``split_df``, or with ``scalers`` in original ones. A series whose model
    failed has no rows here and one in ``errors``.
    """
    parts = []
    for model, scored in score_test(trained, split_df, config).items():
        if scalers is not None:
            scored = inverse_scale(scored, scalers, columns=["y"], scaler_column={"yhat": "y"})
        parts.append(_model_metrics(trained, model, scored))
    return _union(parts, split_df, METRICS_SCHEMA)


def _one_by_one(trained: Trained, like: DataFrame, stage: str, build) -> list[DataFrame]:
    """Run ``build`` for each model type by itself; one that fails becomes an error row."""
    done = []
    for name in trained.names:
        single = replace(
            trained,
            additive=trained.additive if name == additive.MODEL_NAME else None,
            sequence=trained.sequence if name == sequence.MODEL_NAME else None,
            tables={k: v for k, v in trained.tables.items() if k == name},
        )
        try:
            done.append(stage_table(build(single), f"{stage}-{name}"))
        except Exception as problem:  # one type must not stop the others
            log.error("Failed to %s with %s: %s", stage, name, problem)
            trained.errors.append(_type_error(like, name, stage, problem))
    return done


def forecast(
    trained: Trained,
    processed: DataFrame,
    periods: int,
    config: ModelConfig = ModelConfig(),
    freq: str | None = None,
    scalers: DataFrame | None = None,
    compat_roll: bool = False,
    intervals: bool = True,
) -> DataFrame:
    """forecasts(group_id, series_id, model, ds, yhat, yhat_lower, yhat_upper).

    Dates follow the last row of each series by its own step. With ``scalers``
    values are in original units. Without ``intervals`` no futures are simulated:
    yhat is then a column expression and the bounds are null.
    """
    future = future_dates(processed, periods, freq)
    none = F.lit(None).cast("double")
    parts = []
    if trained.additive is not None:
        if intervals:
            ahead = additive.predict_interval(trained.additive, future, config)
        else:
            ahead = additive.predict_dates(trained.additive, future)
            ahead = ahead.withColumns({"yhat_lower": none, "yhat_upper": none})
        parts.append(ahead.withColumn("model", F.lit(additive.MODEL_NAME)))
    for name, models in trained.tables.items():
        ahead = store.get_model(name).predict(models, future)
        parts.append(ahead.withColumns({"yhat_lower": none, "yhat_upper": none, "model": F.lit(name)}))
    if trained.sequence is not None:
        fitted = trained.sequence
        lengths = adaptive_length(prepare(processed, config), fitted.length)
        if fitted.direct:
            ahead = sequence.forecast_direct(fitted, processed, future, lengths)
        else:
            ahead = sequence.forecast_recursive(fitted, processed, future, lengths, compat_roll)
        parts.append(
            ahead.select(
                *KEYS,
                "ds",
                "yhat",
                none.alias("yhat_lower"),
                none.alias("yhat_upper"),
                F.lit(sequence.MODEL_NAME).alias("model"),
            )
        )
    out = _union(parts, processed, FORECASTS_SCHEMA)
    if scalers is not None:
        out = inverse_scale(out, scalers, columns=[], scaler_column={c: "y" for c in ("yhat", "yhat_lower", "yhat_upper")})
    return out.select(*KEYS, "model", "ds", "yhat", "yhat_lower", "yhat_upper")


def _union(parts: list[DataFrame], like: DataFrame, schema: str) -> DataFrame:
    if not parts:
        return like.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def run(
    raw: DataFrame,
    config: AppConfig = AppConfig(),
    target: str | None = None,
    periods: int = 30,
    types=ALL_TYPES,
    freq: str | None = None,
    output: str | None = None,
    original_units: bool = False,
    intervals: bool = True,
) -> dict:
    """Preprocess, train, score, forecast and report; all series unless one is named.

    The raw, the processed and the split rows are read by several later steps, so
    each is written once to the shared folder. A model type that fails at any step is reported in
    ``errors`` and the others go on. With ``output`` predictions and summary are
    written there.
    """
    raw = stage_table(raw, "raw")
    prepared = preprocess(raw, config.data, target, select=True, model_config=config.model)
    rows = stage_table(prepared.rows, "processed")
    processed = replace(prepared, rows=rows)
    scalers = processed.scalers
    split_df = stage_table(prepare(processed.data, config.model), "split")
    trained = train_models(split_df, types, config.model, periods)
    metrics = _union(
        _one_by_one(
            trained,
            raw,
            "evaluate",
            lambda single: evaluate(single, split_df, config.model, scalers if original_units else None),
        ),
        raw,
        METRICS_SCHEMA,
    )
    forecasts = _union(
        _one_by_one(
            trained,
            raw,
            "forecast",
            lambda single: forecast(single, processed.data, periods, config.model, freq, scalers, intervals=intervals),
        ),
        raw,
        FORECASTS_SCHEMA,
    )
    chosen = raw if target is None else raw.join(rows.select(*KEYS).distinct(), KEYS, "left_semi")
    summary = results_summary(chosen, metrics, forecasts)
    if output is not None:
        write_predictions(forecasts, f"{output}/predictions", trained.names)
        write_summary(summary, f"{output}/summary")
    return {
        "processed": processed,
        "split": split_df,
        "models": trained,
        "metrics": metrics,
        "errors": _union(trained.errors, raw, ERRORS_SCHEMA),
        "forecasts": forecasts,
        "summary": summary,
        "report": report_tables(chosen, forecasts, metrics),
    }
