"""Calendar features of local time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.panel import seconds


def local(ds: str = "ds", tz: str = "UTC") -> Column:
    return F.from_utc_timestamp(F.col(ds), tz).cast("timestamp_ntz")


def _wave(x: Column, period: float, name: str) -> list[Column]:
    turn = x * F.lit(2 * math.pi / period)
    return [F.sin(turn).cast("float").alias(f"{name}_sin"), F.cos(turn).cast("float").alias(f"{name}_cos")]


def calendar_columns(ds: str = "ds", tz: str = "UTC") -> list[Column]:
    at = local(ds, tz)
    hour, dow, month = F.hour(at), F.weekday(at), F.month(at)
    parts = {"hour": hour, "dayofweek": dow, "day": F.dayofmonth(at), "month": month}
    return [
        *(c.cast("short").alias(n) for n, c in parts.items()), (dow >= 5).alias("is_weekend"),
        *_wave(hour, 24, "hour"), *_wave(dow, 7, "dayofweek"), *_wave(month - 1, 12, "month"),
    ]


def fourier_columns(ds: str = "ds", *, periods: dict[str, float], order: int = 2) -> list[Column]:
    """Sine and cosine of hours since 1970 for each period in hours and each order."""
    hours = seconds(ds) / 3600.0
    out = []
    for name, period in periods.items():
        for k in range(1, order + 1):
            turn = hours * F.lit(2 * math.pi * k / period)
            out += [F.sin(turn).cast("float").alias(f"fourier_{name}_sin_{k}"), F.cos(turn).cast("float").alias(f"fourier_{name}_cos_{k}")]
    return out


def with_holidays(df: DataFrame, holidays: DataFrame, *, ds: str = "ds", tz: str = "UTC") -> DataFrame:
    """is_holiday and is_holiday_eve. ``holidays`` has a date column ``day``: a few rows a year."""
    days = holidays.select(F.col("day").alias("_day")).distinct()
    at, eve = F.to_date(local(ds, tz)), F.to_date(F.from_utc_timestamp(F.col(ds) + F.expr("INTERVAL 24 HOURS"), tz))
    first = df.join(days.select(F.col("_day").alias("_a")), at == F.col("_a"), "left")
    both = first.join(days.select(F.col("_day").alias("_b")), eve == F.col("_b"), "left")
    return both.select(*df.columns, F.col("_a").isNotNull().alias("is_holiday"), F.col("_b").isNotNull().alias("is_holiday_eve"))


def degree_days(temp: str, *, heating: float = 18.0, cooling: float = 18.0) -> list[Column]:
    t, zero = F.col(temp), F.lit(0.0)
    return [
        F.when(t.isNotNull(), F.greatest(heating - t, zero)).cast("float").alias(f"{temp}_hdd{heating:g}"),
        F.when(t.isNotNull(), F.greatest(t - cooling, zero)).cast("float").alias(f"{temp}_cdd{cooling:g}"),
    ]
