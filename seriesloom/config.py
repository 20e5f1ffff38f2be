"""Settings, with the defaults every operator falls back to."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields

import yaml


# The defaults below are those a user of such settings expects.


@dataclass(frozen=True)
class DataConfig:
    geo: str = ""  # worldwide
    timeframe: str = "today 5-y"
    normalize: bool = True
    interpolate_missing: bool = True
    smoothing_window: int = 7
    # The defaults fit the scaler on all rows and smooth with a centered frame,
    # which lets test rows influence training rows. These two switch that off.
    fit_on: str = "all"  # or "train"
    causal: bool = False


@dataclass(frozen=True)
class ModelConfig:
    test_size: float = 0.2
    validation_split: float = 0.1
    random_state: int = 42
    # lag-window model
    sequence_length: int = 30
    sequence_kind: str = "linear"  # or "gbt" or "network"
    sequence_direct: bool = True  # trees are trained for each step ahead; if not, their forecasts are fed back
    sequence_reg: float = 1e-4
    sequence_max_iter: int = 20
    # the network: hidden units, steps of an epoch, and when its training slows down and ends
    sequence_units: int = 64
    sequence_epochs: int = 100
    sequence_batches: int = 4
    sequence_learning_rate: float = 0.001
    sequence_dropout: float = 0.2
    early_stopping_patience: int = 10
    reduce_lr_patience: int = 5
    # seasonal additive model
    changepoint_prior_scale: float = 0.05
    seasonality_prior_scale: float = 10.0
    n_changepoints: int = 25
    changepoint_range: float = 0.8
    seasonality_mode: str = "additive"
    yearly_seasonality: bool = True
    weekly_seasonality: bool = True
    daily_seasonality: bool = False  # for series finer than a day (models.fine); refused for others, on which it is constant
    interval_width: float = 0.95
    uncertainty_samples: int = 1000
    custom_seasonalities: tuple = ()
    # most rounds of a fit, and passes between trend and multiplicative seasons; the parameters say whether it settled
    fit_rounds: int = 300
    fit_passes: int = 15


@dataclass(frozen=True)
class AppConfig:
    data: DataConfig = field(default_factory=DataConfig)
    model: ModelConfig = field(default_factory=ModelConfig)

    @classmethod
    def from_yaml(cls, path: str) -> "AppConfig":
        """Read a settings file; a section or key left out keeps its default."""
        with open(path) as handle:
            raw = yaml.safe_load(handle) or {}
        return cls(
            data=_section(DataConfig, raw.get("data")),
            model=_section(ModelConfig, raw.get("model")),
        )

    def to_yaml(self, path: str) -> None:
        payload = asdict(self)
        payload["model"]["custom_seasonalities"] = [dict(s) for s in self.model.custom_seasonalities]
        with open(path, "w") as handle:
            yaml.safe_dump(payload, handle, sort_keys=False)


def _section(kind, values):
    values = dict(values or {})
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"Unknown {kind.__name__} settings: {sorted(unknown)}")
    if "custom_seasonalities" in values:
        values["custom_seasonalities"] = tuple(values["custom_seasonalities"] or ())
    return kind(**values)
