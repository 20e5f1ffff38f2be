"""Trend series analytics and forecasting over long tables, on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames, so a job is a chain of
``df.transform(operator)`` calls that Catalyst plans as a whole.
"""

from .config import AppConfig, DataConfig, ModelConfig

__all__ = ["AppConfig", "DataConfig", "ModelConfig"]
__version__ = "0.1.0"
