import datetime as dt

import pytest

from seriesloom import AppConfig, DataConfig, ModelConfig
from seriesloom.functions.calendar import parse_timeframe
from seriesloom.models.additive import fit_additive


def test_defaults():
    config = AppConfig()
    assert config.data == DataConfig() and config.model == ModelConfig()
    assert config.data.geo == "" and config.data.timeframe == "today 5-y" and config.data.normalize
    assert config.data.smoothing_window == 7 and config.data.interpolate_missing
    assert config.model.test_size == 0.2 and config.model.validation_split == 0.1
    assert config.model.changepoint_prior_scale == 0.05 and config.model.interval_width == 0.95


def test_daily_waves_are_refused_for_dates(year_long):
    with pytest.raises(ValueError, match="finer than a day"):
        fit_additive(year_long, ModelConfig(daily_seasonality=True))


def test_yaml_round_trip(tmp_path):
    config = AppConfig(
        data=DataConfig(smoothing_window=3),
        model=ModelConfig(custom_seasonalities=({"name": "m", "period": 30.5, "fourier_order": 5},)),
    )
    config.to_yaml(tmp_path / "c.yaml")
    assert AppConfig.from_yaml(tmp_path / "c.yaml") == config


def test_yaml_keeps_defaults_and_rejects_unknown_keys(tmp_path):
    (tmp_path / "part.yaml").write_text("data:\n  geo: KR\n")
    assert AppConfig.from_yaml(tmp_path / "part.yaml").data == DataConfig(geo="KR")
    (tmp_path / "bad.yaml").write_text("data:\n  gep: KR\n")
    with pytest.raises(ValueError, match="gep"):
        AppConfig.from_yaml(tmp_path / "bad.yaml")


@pytest.mark.parametrize(
    "text, start",
    [("today 5-y", dt.date(2019, 12, 3)), ("today 3-m", dt.date(2024, 9, 2)), ("Today 7-d", dt.date(2024, 11, 24))],
)
def test_relative_timeframe(text, start):
    assert parse_timeframe(text, dt.date(2024, 12, 1)) == (start.isoformat(), "2024-12-01")


def test_absolute_timeframe_passes_through():
    assert parse_timeframe("2020-01-01 2021-01-01") == ("2020-01-01", "2021-01-01")
    assert parse_timeframe("now 7-d") == ("now", "7-d")


@pytest.mark.parametrize("text", ["today 5-x", "today", "2020-01-01", "a b c", "today x-y"])
def test_malformed_timeframe(text):
    with pytest.raises(ValueError):
        parse_timeframe(text)
