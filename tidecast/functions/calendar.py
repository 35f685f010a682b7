"""Calendar and cyclical feature expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_columns(t: str) -> dict[str, Column]:
    """month, day_of_week (Monday = 0), ISO week, quarter, weekend, month start, month end."""
    c = F.col(t)
    return {
        "month": F.month(c),
        "day_of_week": F.weekday(c),
        "week_of_year": F.coalesce(F.weekofyear(c), F.lit(0)),
        "quarter": F.quarter(c),
        "is_weekend": F.coalesce(F.weekday(c).isin(5, 6), F.lit(False)).cast("int"),
        "is_month_start": F.coalesce(F.dayofmonth(c) == 1, F.lit(False)).cast("int"),
        "is_month_end": F.coalesce(F.to_date(c) == F.last_day(c), F.lit(False)).cast("int"),
    }


def order_time_columns(ts: str) -> dict[str, Column]:
    """Month, weekday and ISO week of an order timestamp."""
    c = F.col(ts)
    return {
        "order_month": F.month(c),
        "order_dayofweek": F.weekday(c),
        "order_weekofyear": F.coalesce(F.weekofyear(c), F.lit(0)),
    }


def cyclical(c: Column, period: int, prefix: str) -> dict[str, Column]:
    """Sine and cosine of a periodic value; a missing value counts as 0."""
    angle = F.coalesce(c.cast("double"), F.lit(0.0)) * F.lit(2 * math.pi / period)
    return {f"{prefix}_sin": F.sin(angle), f"{prefix}_cos": F.cos(angle)}


def week_columns(week: Column) -> dict[str, Column]:
    """13-week quarter, 52-week year and week within the year of a running week number."""
    w = week.cast("int") - 1
    return {
        "quarter": (F.floor(w / 13) + 1).cast("int"),
        "year": (F.floor(w / 52) + 1).cast("int"),
        "week_in_year": (F.pmod(w, F.lit(52)) + 1).cast("int"),
    }


def harmonics(pos: Column, period: int = 7) -> dict[str, Column]:
    """Linear position and one sine/cosine pair, usable past the end of the series."""
    angle = pos.cast("double") * F.lit(2 * math.pi / period)
    return {"x_t": pos.cast("double"), "x_sin": F.sin(angle), "x_cos": F.cos(angle)}


CALENDAR_CYCLES = {"month": 12, "week_of_year": 52, "day_of_week": 7, "quarter": 4}


def calendar_cycles(columns: dict[str, Column]) -> dict[str, Column]:
    """Cyclical pairs for every calendar column that has a natural period."""
    out: dict[str, Column] = {}
    for name, period in CALENDAR_CYCLES.items():
        if name in columns:
            out.update(cyclical(columns[name], period, name))
    return out
