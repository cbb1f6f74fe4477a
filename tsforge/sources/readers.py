"""Readers of landed payloads, each to (unique_id, ds, value) rows of half-open [start, end).

The network has no place in a job: a fetcher lands files, and these parse them where they lie.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
import warnings
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsforge.operators.align import deduplicate, to_utc
from tsforge.spec import VintageError

#: Bounds of each source's values. Fixed values.
BOUNDS = {"klines": (0.0, 1e7), "weather": (-40.0, 55.0), "grid_demand": (0.0, 60000.0), "meters": (0.0, 50000.0)}


@dataclass(frozen=True)
class SourceSpec:
    source_id: str
    value: str = "y"
    freq: str = "h"
    vintage_aware: bool = False


def ranged(df: DataFrame, start: datetime, end: datetime, ids: list[str] | None = None) -> DataFrame:
    out = df.where((F.col("ds") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ds") < F.lit(end).cast("timestamp_ntz")))
    return out if ids is None else out.where(F.col("unique_id").isin(ids))


def require_no_vintage(spec: SourceSpec, as_of: datetime | None) -> None:
    if as_of is not None and not spec.vintage_aware:
        raise VintageError(f"{spec.source_id} has no vintages")


def out_of_bounds(df: DataFrame, kind: str, value: str = "y") -> DataFrame:
    low, high = BOUNDS[kind]
    return df.where(F.col(value).isNotNull() & ~F.col(value).between(low, high))


def _last_of_each(df: DataFrame, seq: Column) -> DataFrame:
    order = Window.partitionBy("unique_id", "ds").orderBy(seq.desc())
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _naive(t: Column) -> Column:
    return F.to_utc_timestamp(t, F.expr("current_timezone()")).cast("timestamp_ntz")


def klines(spark: SparkSession, path: str, *, symbol: str) -> DataFrame:
    """Files of JSON arrays of rows: open time in milliseconds first, the close price fifth."""
    pages = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("page"))
    rows = pages.select("page", F.posexplode(F.from_json("value", "array<array<string>>")).alias("n", "row"))
    ds = _naive(F.timestamp_millis(F.col("row")[0].cast("long")))
    parsed = rows.select(F.lit(symbol).alias("unique_id"), ds.alias("ds"), F.col("row")[4].cast("double").alias("y"), F.struct("page", "n").alias("seq"))
    return _last_of_each(parsed, F.col("seq")).drop("seq")


def weather(spark: SparkSession, path: str, *, location: str) -> DataFrame:
    """{"hourly": {"time": [...], "temperature_2m": [...]}} in UTC."""
    schema = "hourly struct<time array<string>, temperature_2m array<double>>"
    zipped = F.arrays_zip(F.col("j.hourly.time").alias("t"), F.col("j.hourly.temperature_2m").alias("v"))
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j")).select(F.posexplode(zipped).alias("n", "x"))
    parsed = rows.select(F.lit(location).alias("unique_id"), F.to_timestamp_ntz(F.col("x.t"), F.lit("yyyy-MM-dd'T'HH:mm")).alias("ds"), F.col("x.v").alias("temp_c"), "n")
    return _last_of_each(parsed, F.col("n")).drop("n")


def grid_demand(spark: SparkSession, path: str, *, title: str, unique_id: str = "ES") -> DataFrame:
    """{"included": [{"attributes": {"title", "values": [{"datetime" with offset, "value"}]}}]}."""
    schema = "included array<struct<attributes struct<title string, values array<struct<datetime string, value double>>>>>"
    found = spark.read.text(path, wholetext=True).select(F.explode(F.filter(F.from_json("value", schema)["included"], lambda x: x["attributes"]["title"] == title)).alias("s"))
    rows = found.select(F.explode("s.attributes.values").alias("v"))
    return rows.select(F.lit(unique_id).alias("unique_id"), _naive(F.to_timestamp("v.datetime")).alias("ds"), F.col("v.value").alias("y"))


def meters(spark: SparkSession, path: str, *, tz: str = "Europe/Lisbon") -> DataFrame:
    """A wide CSV with semicolons and decimal commas, quarter hours in wall-clock time, one column
    for each meter: long, in UTC, means of an hour."""
    wide = spark.read.option("sep", ";").option("header", True).csv(path)
    first, *names = wide.columns
    seq = wide.withColumn("seq", F.monotonically_increasing_id())
    long = seq.unpivot([first, "seq"], names, "unique_id", "raw")
    rows = long.select("unique_id", F.col(first).try_cast("timestamp_ntz").alias("ds"), F.regexp_replace("raw", ",", ".").try_cast("double").alias("y"), "seq")
    utc = to_utc(rows, tz=tz, seq="seq").where("ds IS NOT NULL")
    return deduplicate(utc).groupBy("unique_id", F.date_trunc("hour", "ds").cast("timestamp_ntz").alias("ds")).agg(F.avg("y").alias("y"))


def date_chunks(start: datetime, end: datetime, *, max_days: int = 364) -> list[tuple[datetime, datetime]]:
    out = []
    while start < end:
        stop = min(end, start + timedelta(days=max_days))
        out.append((start, stop))
        start = stop
    return out


def cache_key(source_id: str, start: datetime, end: datetime, ids: list[str] | None = None, as_of: datetime | None = None) -> str:
    """Whatever the order of the ids."""
    what = [source_id, start.isoformat(), end.isoformat(), sorted(ids) if ids is not None else None, as_of and as_of.isoformat()]
    return hashlib.sha256(json.dumps(what).encode()).hexdigest()[:16]


class SourceUnavailable(RuntimeError):
    """A source can't be reached now."""


class StaleWarning(UserWarning):
    """What is served is older than asked for."""


def cached(spark: SparkSession, folder: str, key: str, fetch, *, max_age: timedelta | None = None) -> DataFrame:
    """The newest table under ``folder``/``key``, fetched and written where there is none or it is
    older than ``max_age``. A table counts once Spark's committer has put _SUCCESS beside it, and
    a new one stands beside the old, so readers never see half of one. Where the source is
    unavailable the old one is served with a warning."""
    fs, root = spark._jvm.org.apache.hadoop.fs, f"{folder}/{key}"
    place = fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    held = []
    for status in system.listStatus(place) if system.exists(place) else []:
        done = fs.Path(status.getPath(), "_SUCCESS")
        if system.exists(done):
            held.append((system.getFileStatus(done).getModificationTime() / 1000, status.getPath().toString()))
    if held and (max_age is None or time.time() - max(held)[0] <= max_age.total_seconds()):
        return spark.read.parquet(max(held)[1])
    path = f"{root}/{uuid.uuid4().hex}"
    try:
        fetch().write.parquet(path)
    except SourceUnavailable:
        if not held:
            raise
        warnings.warn(f"source of {key} is unavailable, an older table is served", StaleWarning, stacklevel=2)
        return spark.read.parquet(max(held)[1])
    return spark.read.parquet(path)


def fetched(df: DataFrame, spec: SourceSpec, *, start: datetime, end: datetime, ids: list[str] | None = None, as_of: datetime | None = None) -> DataFrame:
    """A source's rows of [start, end) as they were known at ``as_of`` (latest, if None). Sources
    with vintages have a column as_of: of each instant the last vintage that isn't later holds."""
    require_no_vintage(spec, as_of)
    rows = ranged(df, start, end, ids)
    if not spec.vintage_aware:
        return rows
    known = rows if as_of is None else rows.where(F.col("as_of") <= F.lit(as_of).cast("timestamp_ntz"))
    return _last_of_each(known, F.col("as_of"))


def write_run(tables: dict[str, DataFrame], folder: str, *, by: str = "model_id") -> None:
    """A run's tables, hive-partitioned by model or detector and sorted within files."""
    for name, df in tables.items():
        keys = [c for c in ("unique_id", "window_id", "ds") if c in df.columns]
        rows = df.sortWithinPartitions(*keys) if keys else df
        writer = rows.write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(by) if by in df.columns else writer).parquet(f"{folder}/{name}")
