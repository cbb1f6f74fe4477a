"""Temporal alignment: wall clock to UTC, duplicates, full grids, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.panel import missing


def to_utc(df: DataFrame, *, tz: str, ds: str = "ds", seq: str | None = None, by: str = "unique_id") -> DataFrame:
    """Wall-clock ``ds`` to UTC. The first occurrence of a repeated hour is summer time, later ones
    (by ``seq``) standard time; an hour that the clock skips becomes null."""
    order = Window.partitionBy(by, ds).orderBy(seq or ds)
    once = F.to_utc_timestamp(ds, tz)
    later = once + F.expr("INTERVAL 1 HOUR")
    again = (F.row_number().over(order) > 1) & (F.from_utc_timestamp(later, tz) == F.col(ds))
    utc = F.when(F.from_utc_timestamp(once, tz) == F.col(ds), F.when(again, later).otherwise(once))
    return df.withColumn(ds, utc.cast("timestamp_ntz"))


def deduplicate(df: DataFrame, *, policy: str = "mean", values: tuple[str, ...] = ("y",), seq: str | None = None) -> DataFrame:
    """One row for each (unique_id, ds): the mean of what is known, or the first or last arrival."""
    if policy == "mean":
        return df.groupBy("unique_id", "ds").agg(*(F.avg(missing(v)).alias(v) for v in values))
    pick = {"first": F.min_by, "last": F.max_by}[policy]
    whole = F.struct(*values)
    kept = df.groupBy("unique_id", "ds").agg(pick(whole, F.col(seq)).alias("kept"))
    return kept.select("unique_id", "ds", *(F.col(f"kept.{v}").alias(v) for v in values))


def full_grid(df: DataFrame, *, step_seconds: int) -> DataFrame:
    """Each series from its first to its last instant without gaps; new rows hold nulls."""
    span = df.groupBy("unique_id").agg(F.min("ds").alias("low"), F.max("ds").alias("high"))
    grid = span.select("unique_id", F.explode(F.sequence("low", "high", F.expr(f"INTERVAL {step_seconds} SECONDS"))).alias("ds"))
    return grid.join(df, ["unique_id", "ds"], "left")


def resample_mean(df: DataFrame, *, freq: str = "1 day", step_seconds: int = 86400, value: str = "y") -> DataFrame:
    """Bucket means at a coarser step; empty buckets between the first and the last are null."""
    bucket = F.window("ds", freq)["start"].cast("timestamp_ntz")
    means = df.groupBy("unique_id", bucket.alias("ds")).agg(F.avg(missing(value)).alias(value))
    return full_grid(means, step_seconds=step_seconds)
