"""As-of joins: what was known at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, *, by: str = "unique_id", on: str = "ds", value: str = "value") -> DataFrame:
    """Each left row with the right side's ``value`` of the same key at the latest instant that
    isn't later (and that instant). One sort of both sides together; no pairs are formed. Of right
    rows of one instant the largest value holds."""
    l = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))  # noqa: E741
    r = right.groupBy(by, on).agg(F.max(value).alias("_v")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    back = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_v").alias("value"), F.col(on).alias("at"))), True).over(back)
    return both.withColumn("_k", known).where("_side = 1").select(*left.columns, F.col("_k.value").alias(value), F.col("_k.at").alias("known_at"))


def vintages_at(table: DataFrame, cutoffs: DataFrame, *, value: str) -> DataFrame:
    """Bitemporal rows (unique_id, ds, as_of, value): for each cutoff the latest vintage of every
    instant behind it that was known by then. Cutoffs are the windows of a plan."""
    seen = table.join(F.broadcast(cutoffs.select("window_id", "cutoff", "last_pred")), (F.col("as_of") <= F.col("cutoff")) & (F.col("ds") > F.col("cutoff")) & (F.col("ds") <= F.col("last_pred")))
    return seen.groupBy("window_id", "unique_id", "ds").agg(F.max_by(value, "as_of").alias(value), F.max("as_of").alias("as_of"))
