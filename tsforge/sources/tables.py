"""Panels made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsforge.operators.align import full_grid
from tsforge.panel import Panel
from tsforge.spec import PanelSpec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y"), "event_id")


def hourly_events(spark: SparkSession, sf_dir: str) -> Panel:
    """Events an hour by type."""
    rows = event_rows(spark, sf_dir).withColumn("ds", F.date_trunc("hour", "ds").cast("timestamp_ntz"))
    df = full_grid(rows.groupBy("unique_id", "ds").agg(F.count("*").cast("double").alias("y")), step_seconds=3600)
    return Panel(df, PanelSpec("events", "h", (24, 168)))


def daily_shipments(spark: SparkSession, sf_dir: str) -> Panel:
    """Quantity shipped a day by return flag."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("unique_id"), F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ds"), "l_quantity")
    df = full_grid(rows.groupBy("unique_id", "ds").agg(F.sum("l_quantity").cast("double").alias("y")), step_seconds=86400)
    return Panel(df, PanelSpec("shipments", "D", (7,)))
