"""Saving, loading and describing models."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession

from ..config import ModelConfig
from . import additive, sequence
from .network import Network


@dataclass(frozen=True)
class TableModel:
    """A model type whose models are a table, a row for each series.

    ``fit(rows, config)`` makes it of processed rows, and ``predict(models, dates,
    keep)`` gives ``yhat`` for the dates of a table, next to the columns to keep.
    """

    fit: Callable
    predict: Callable


# The registry: model type → how it is trained. ``plans.forecasting`` trains, scores
# and forecasts the types named here; ``register`` adds one.
_TYPES = {
    additive.MODEL_NAME: TableModel(additive.fit_additive, additive.predict_dates),
    sequence.MODEL_NAME: sequence.fit_sequence,
}
_SEQUENCE_KINDS = {"linear": LinearRegressionModel, "gbt": GBTRegressionModel}


def register(name: str, kind) -> None:
    _TYPES[name] = kind


def unregister(name: str) -> None:
    del _TYPES[name]


def list_models() -> list[str]:
    return list(_TYPES)


def get_model(name: str):
    if name not in _TYPES:
        raise ValueError(f"No model type {name!r}; there are {list_models()}")
    return _TYPES[name]


def get_params(config: ModelConfig) -> dict:
    return asdict(config)


def set_params(config: ModelConfig, **params) -> ModelConfig:
    return replace(config, **params)


def _write_metadata(spark: SparkSession, path: str, payload: dict) -> None:
    payload = {**payload, "saved_at": dt.datetime.now(dt.timezone.utc).isoformat()}
    spark.createDataFrame([(json.dumps(payload),)], "value string").write.mode("overwrite").text(f"{path}/metadata")


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The description saved with a model; empty if it has been lost."""
    try:
        row = spark.read.text(f"{path}/metadata").first()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return {}
        raise
    return json.loads(row["value"]) if row else {}


def save_additive(models: DataFrame, path: str, config: ModelConfig = ModelConfig()) -> None:
    models.write.mode("overwrite").parquet(f"{path}/params")
    payload = {
        "model_type": additive.MODEL_NAME,
        "is_trained": True,
        "config": get_params(config),
        "feature_names": ["ds"],
        "target_name": "y",
    }
    _write_metadata(models.sparkSession, path, payload)


def load_additive(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(additive.PARAMS_SCHEMA).parquet(f"{path}/params")


def save_sequence(
    spark: SparkSession, model: sequence.SequenceModel, path: str, config: ModelConfig = ModelConfig()
) -> None:
    if model.kind == "network":
        model.model.save(spark, f"{path}/model")
    else:
        model.model.write().overwrite().save(f"{path}/model")
    if model.history is not None:
        model.history.write.mode("overwrite").parquet(f"{path}/history")
    payload = {
        "model_type": sequence.MODEL_NAME,
        "is_trained": True,
        "config": get_params(config),
        "feature_names": model.features,
        "target_name": "y",
        "kind": model.kind,
        "length": model.length,
        "direct": model.direct,
    }
    _write_metadata(spark, path, payload)


def load_sequence(spark: SparkSession, path: str) -> sequence.SequenceModel:
    """Without its description the model is taken to have the default shape."""
    about = read_metadata(spark, path)
    defaults = ModelConfig()
    kind = about.get("kind", defaults.sequence_kind)
    model = Network.load(spark, f"{path}/model") if kind == "network" else _SEQUENCE_KINDS[kind].load(f"{path}/model")
    features = about.get("feature_names") or ["y", *sequence.CALENDAR_FEATURES]
    length = about.get("length", defaults.sequence_length)
    return sequence.SequenceModel(model, kind, length, features, about.get("direct", False), _history(spark, path))


def _history(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("iteration int, metric string, value double").parquet(f"{path}/history")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def model_summary(metadata: dict, metrics: dict | None = None) -> str:
    """What a saved model is, and its latest numeric metrics, one fact a line."""
    facts = {k: metadata.get(k) for k in ("model_type", "is_trained", "target_name", "feature_names", "saved_at")}
    facts.update({k: f"{v:.4f}" for k, v in (metrics or {}).items() if isinstance(v, (int, float))})
    return "\n".join(f"{name} = {value}" for name, value in facts.items())
