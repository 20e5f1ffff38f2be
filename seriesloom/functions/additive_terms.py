"""The additive model as column expressions over its parameter row.

A parameter row holds, per series, the trend (``k``, ``m`` and the rate changes
``deltas`` at ``changepoints``, times scaled to [0, 1] over the training span)
and ``terms``, an array of seasonal terms struct(name, period, mode, coef) with
coef = [a1, b1, a2, b2, …] of a_n·sin(2πnt/period) + b_n·cos(2πnt/period), t in
days since 1970-01-01. Values are in units of ``y_scale``. ``ds`` is a date, or for
series finer than a day a timestamp, whose t has a fraction.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import array_sum


MICROS_A_DAY = 86_400_000_000


def days_of(ds: Column, fine: bool = False) -> Column:
    """Days since 1970-01-01, by the wall clock."""
    if not fine:
        return F.unix_date(ds)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ds.cast("timestamp_ntz")) / F.lit(MICROS_A_DAY)


def scaled_time(ds: Column, fine: bool = False) -> Column:
    if fine:
        return (days_of(ds, True) - F.unix_date("t0")) / F.col("t_days")
    return F.datediff(ds, F.col("t0")) / F.col("t_days")


def trend(ds: Column, fine: bool = False) -> Column:
    """Piecewise linear trend, in units of the data."""
    t = scaled_time(ds, fine)
    bends = array_sum(F.zip_with("changepoints", "deltas", lambda s, d: d * F.greatest(t - s, F.lit(0.0))))
    return (F.col("m") + F.col("k") * t + bends) * F.col("y_scale")


def _wave(term: Column, ds: Column, fine: bool) -> Column:
    angle = F.lit(2 * math.pi) * days_of(ds, fine) / term["period"]

    def part(coef: Column, i: Column) -> Column:
        harmonic = angle * (F.floor(i / 2) + 1)
        return coef * F.when(i % 2 == 0, F.sin(harmonic)).otherwise(F.cos(harmonic))

    return array_sum(F.transform(term["coef"], part))


def seasonal(ds: Column, mode: str, fine: bool = False) -> Column:
    """Sum of the seasonal terms of one mode, unscaled."""
    terms = F.filter("terms", lambda s: s["mode"] == mode)
    return array_sum(F.transform(terms, lambda s: _wave(s, ds, fine)))


def component(ds: Column, name: str, fine: bool = False) -> Column:
    """One seasonal term: a share of the trend if multiplicative, else in data units."""
    term = F.filter("terms", lambda s: s["name"] == name)
    value = array_sum(F.transform(term, lambda s: _wave(s, ds, fine)))
    additive = F.exists(term, lambda s: s["mode"] == "additive")
    return F.when(F.size(term) > 0, value * F.when(additive, F.col("y_scale")).otherwise(1.0))


def yhat(ds: Column, fine: bool = False) -> Column:
    return trend(ds, fine) * (1 + seasonal(ds, "multiplicative", fine)) + seasonal(ds, "additive", fine) * F.col("y_scale")
