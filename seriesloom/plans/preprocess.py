"""The preprocessing plan: fill, smooth, scale, calendar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DataConfig, ModelConfig
from ..operators.cleaning import drop_missing, fill_time, smooth
from ..operators.features import calendar_features, cyclical_features, select_target
from ..operators.scaling import scale_series, scalers_of
from ..operators.selection import resolve_target, select_series
from ..operators.splitting import temporal_split


@dataclass(frozen=True)
class Processed:
    """A processed table. Its rows carry the shift and scale of their series."""

    rows: DataFrame
    scaled: bool

    @property
    def data(self) -> DataFrame:
        carried = [c for c in self.rows.columns if c.endswith(("_shift", "_scale"))]
        return self.rows.drop(*carried)

    @property
    def scalers(self) -> DataFrame | None:
        return scalers_of(self.rows) if self.scaled else None


def preprocess(
    df: DataFrame,
    config: DataConfig = DataConfig(),
    target: str | None = None,
    select: bool = False,
    model_config: ModelConfig = ModelConfig(),
) -> Processed:
    """Fill (or drop) missing dates, smooth, scale, and add calendar columns.

    All windows share the (group, series) distribution, so the plan has one
    shuffle of the rows; the scaler rides along on the rows instead of being
    joined back. With a ``target`` (or ``select``) only model input columns stay.
    """
    target = resolve_target(df, target)
    if config.interpolate_missing:
        # Filling looks at one series only, so the filter can go to the scan.
        rows = fill_time(select_series(df, target))
    else:
        rows = select_series(drop_missing(df), target)
    rows = smooth(rows, config.smoothing_window, config.causal)
    if config.normalize:
        if config.fit_on == "train":
            split = temporal_split(rows, model_config.test_size, model_config.validation_split)
            rows = scale_series(split, fit=F.col("split") == "train", keep_scalers=True).drop("split")
        else:
            rows = scale_series(rows, keep_scalers=True)
    rows = cyclical_features(calendar_features(rows))
    if target is not None or select:
        rows = select_target(rows)
    return Processed(rows, config.normalize)
