from __future__ import annotations

import datetime as dt
import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from seriesloom.schema import SERIES_SCHEMA  # noqa: E402
from seriesloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("OFF")
    return session


def long_frame(spark, wide: pd.DataFrame, group: str = "g"):
    """A wide pandas frame (date index, column per keyword) as a series table."""
    rows = [
        (group, name, day.date(), None if pd.isna(value) else float(value))
        for name in wide.columns
        for day, value in wide[name].items()
    ]
    return spark.createDataFrame(rows, SERIES_SCHEMA)


def series_of(df, name: str, column: str = "y") -> pd.Series:
    """One series of a result, by date."""
    rows = df.where(df.series_id == name).orderBy("ds").toPandas()
    return pd.Series(rows[column].to_numpy(), index=pd.to_datetime(rows["ds"]))


@pytest.fixture(scope="session")
def year_wide():
    """Two waves over 2020, five values of the first missing."""
    days = pd.date_range("2020-01-01", "2020-12-31")
    at = np.arange(len(days))
    wide = pd.DataFrame(
        {
            "keyword1": 50 * np.sin(2 * np.pi * at / 365) + 50,
            "keyword2": 30 * np.cos(2 * np.pi * at / 365) + 60,
        },
        index=days,
    )
    wide.iloc[10:15, 0] = np.nan
    return wide


@pytest.fixture(scope="session")
def year_long(spark, year_wide):
    return long_frame(spark, year_wide).cache()


@pytest.fixture(scope="session")
def four_years():
    """Trend, yearly wave and noise of standard deviation 5."""
    days = pd.date_range("2020-01-01", "2023-12-31")
    at = np.arange(len(days))
    noise = np.random.default_rng(7).normal(0, 5, len(days))
    return pd.Series(np.linspace(100, 200, len(days)) + 10 * np.sin(2 * np.pi * at / 365.25) + noise, index=days)


@pytest.fixture(scope="session")
def three_waves():
    days = pd.date_range("2020-01-01", "2021-12-31")
    at, rng = np.arange(len(days)), np.random.default_rng(3)
    return pd.DataFrame(
        {
            "keyword1": 50 * np.sin(2 * np.pi * at / 365) + 50 + rng.normal(0, 5, len(days)),
            "keyword2": 30 * np.cos(2 * np.pi * at / 365) + 60 + rng.normal(0, 3, len(days)),
            "keyword3": 40 * np.sin(2 * np.pi * at / 180) + 45 + rng.normal(0, 4, len(days)),
        },
        index=days,
    )


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)
