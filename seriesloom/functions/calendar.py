"""Date expressions and timeframe parsing."""

from __future__ import annotations

import datetime as dt
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days one unit of a relative timeframe stands for.
DAYS_PER_UNIT = {"y": 365, "m": 30, "d": 1}


def parse_timeframe(timeframe: str, today: dt.date | None = None) -> tuple[str, str]:
    """``today 5-y`` / ``today 12-m`` / ``today 7-d`` or ``START END`` → (start, end).

    Two tokens that do not start with ``today`` are returned as they are.
    """
    tokens = timeframe.split(" ")
    if len(tokens) != 2:
        raise ValueError(f"A timeframe has two parts: {timeframe!r}")
    if tokens[0].lower() != "today":
        return tokens[0], tokens[1]
    span = re.fullmatch(r"([+-]?\d+)-([ymd])", tokens[1])
    if span is None:
        raise ValueError(f"Not a number of years, months or days: {tokens[1]!r}")
    end = today or dt.datetime.now(dt.timezone.utc).date()
    start = end - dt.timedelta(days=int(span[1]) * DAYS_PER_UNIT[span[2]])
    return start.isoformat(), end.isoformat()


BUCKETS = ("day", "week", "month", "quarter", "year")


def bucket_date(ts: str, bucket: str) -> Column:
    """First day of the bucket a time falls in; buckets are days or longer."""
    if bucket not in BUCKETS:
        raise ValueError(f"No bucket {bucket!r}; there are {list(BUCKETS)}")
    day = F.to_date(ts)
    return day if bucket == "day" else F.trunc(day, bucket)


def known(column: str) -> Column:
    """The value, or null for NaN: a missing number may arrive as either."""
    return F.when(~F.isnan(column), F.col(column))


def calendar_columns(ds: str = "ds") -> dict[str, Column]:
    """Calendar fields of a date; Monday is day 0 and weeks are ISO weeks."""
    return {
        "year": F.year(ds),
        "month": F.month(ds),
        "day": F.dayofmonth(ds),
        "day_of_week": F.weekday(ds),
        "week_of_year": F.weekofyear(ds),
    }


def cycle_columns() -> dict[str, Column]:
    """Calendar fields placed on a circle, so that the last value meets the first."""
    cycles = {"month": ("month", 12), "day": ("day", 31), "dow": ("day_of_week", 7)}
    out = {}
    for name, (field, length) in cycles.items():
        angle = F.lit(2 * math.pi) * F.col(field) / F.lit(length)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


# Months of one step of a calendar class; a class with E keeps to the ends of months.
MONTHS = {"M": 1, "Q": 3, "Y": 12}


def step_date(anchor: Column, freq: Column, steps: Column, days: Column | None = None) -> Column:
    """``anchor`` moved by ``steps`` of ``freq``.

    W is a week; M, Q and Y are months, quarters and years from the anchor, and
    ME, QE and YE the same from one month's end to another's; D is ``days`` days
    (one, if not given or null).
    """
    out = F.when(freq == "W", F.date_add(anchor, (steps * 7).cast("int")))
    for name, months in MONTHS.items():
        moved = F.add_months(anchor, (steps * months).cast("int"))
        out = out.when(freq == name, moved).when(freq == f"{name}E", F.last_day(moved))
    each = F.lit(1) if days is None else F.coalesce(days, F.lit(1))
    return out.otherwise(F.date_add(anchor, (steps * each).cast("int")))
