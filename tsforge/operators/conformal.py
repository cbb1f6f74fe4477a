"""Scoring frames and split-conformal anomaly scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.panel import missing
from tsforge.spec import quantile_column


def scoring_frame(forecasts: DataFrame, windows: DataFrame, *, model_id: str, stage: str, step: int) -> DataFrame:
    """One model's rows of one stage on the whole grid: every series that any model forecasts, at
    every instant (``step`` seconds apart) of the stage's windows. What a failed window lacks is a
    row of nulls."""
    held = F.broadcast(windows.where(F.col("stage") == stage))
    rows = forecasts.where(F.col("model_id") == model_id).join(held, "window_id", "left_semi")
    instants = held.select(F.explode(F.sequence("first_pred", "last_pred", F.expr(f"INTERVAL {step} SECONDS"))).alias("ds")).distinct()
    return forecasts.select("unique_id").distinct().crossJoin(F.broadcast(instants)).join(rows, ["unique_id", "ds"], "left")


def residuals(frame: DataFrame, *, alpha: float = 0.05) -> DataFrame:
    """Distance outside the central interval, in widths of it; negative inside. side: +1 above."""
    y, lo, hi = missing("y"), missing(quantile_column(alpha / 2)), missing(quantile_column(1 - alpha / 2))
    width = F.when(hi > lo, hi - lo)
    side = F.when(y - hi >= lo - y, 1).otherwise(-1).cast("byte")
    residual = F.when(y.isNotNull(), F.greatest(lo - y, y - hi) / width)
    return frame.select("unique_id", "ds", "cutoff", residual.alias("residual"), side.alias("side"))


def split_conformal_scores(calibration: DataFrame, rows: DataFrame, *, min_calibration: int = 50) -> DataFrame:
    """-log10 of the share of the series' calibration residuals that are at least as large. Both
    sides are ranked in one window by series and residual, so no pairs are formed."""
    pool = calibration.where("residual IS NOT NULL").select("unique_id", F.lit(None).cast("timestamp_ntz").alias("ds"), "residual", F.lit(None).cast("byte").alias("side"), F.lit(1).alias("in_pool"))
    asked = rows.select("unique_id", "ds", "residual", "side", F.lit(0).alias("in_pool"))
    both = pool.unionByName(asked)
    # Ties count as at least as large: the frame ends with the row's own residual.
    down = Window.partitionBy("unique_id").orderBy(F.desc_nulls_last("residual")).rangeBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumn("ge", F.sum("in_pool").over(down)).withColumn("calib_n", F.sum("in_pool").over(Window.partitionBy("unique_id")))
    p = (1 + F.col("ge")) / (F.col("calib_n") + 1)
    scorable = F.col("residual").isNotNull() & (F.col("calib_n") >= min_calibration)
    return ranked.where("in_pool = 0").select("unique_id", "ds", F.when(scorable, -F.log10(p)).alias("score"), scorable.alias("scorable"), F.when(scorable, F.col("residual")).alias("severity"), F.col("calib_n").cast("int").alias("calib_n"), "side")
