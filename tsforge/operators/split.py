"""Rolling-origin windows: a small table, one row for each window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.panel import Panel, at_seconds, seconds
from tsforge.spec import BacktestPlan, PanelError


def windows(panel: Panel, plan: BacktestPlan) -> DataFrame:
    """window_id, stage, train_start, cutoff, first_pred, last_pred. The last windows are the
    holdout; those that start before the data or train on too little are left out."""
    step = panel.spec.step
    span = panel.span().select(seconds("first_ds").alias("first"), seconds("last_ds").alias("last"))
    planned = span.select("first", F.expr(f"(last - first) div {step} + 1").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(plan.n_windows - 1))).alias("planned"))
    cutoff = F.col("n") - 1 - plan.gap - plan.h - (plan.n_windows - 1 - F.col("planned")) * plan.step
    start = F.lit(0) if plan.mode == "expanding" else F.col("cut") - plan.train_size + 1
    least = max(plan.min_train_size, 1)
    kept = planned.withColumn("cut", cutoff).withColumn("start", start).where((F.col("cut") >= 0) & (F.col("start") >= 0) & (F.col("cut") - F.col("start") + 1 >= least))

    def at(index) -> F.Column:
        return at_seconds(F.col("first") + index * step)

    # One row for each window of the plan, so the numbering needs no more than one task.
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("n").orderBy("planned")) - 1
    stage = F.when(F.col("planned") >= plan.n_windows - plan.holdout_windows, "holdout").otherwise("dev")
    return kept.select(
        number.cast("short").alias("window_id"), stage.alias("stage"), at(F.col("start")).alias("train_start"), at(F.col("cut")).alias("cutoff"),
        at(F.col("cut") + plan.gap + 1).alias("first_pred"), at(F.col("cut") + plan.gap + plan.h).alias("last_pred"),
    )


def require_windows(table: DataFrame) -> DataFrame:
    if table.isEmpty():
        raise PanelError("the panel is too short for any window of the plan")
    return table


def with_train_counts(panel: Panel, table: DataFrame) -> DataFrame:
    """n_train_obs and n_series of each window."""
    y = panel.spec.target
    inside = F.col("ds").between(F.col("train_start"), F.col("cutoff"))
    rows = panel.df.where(F.col(y).isNotNull()).join(F.broadcast(table), inside)
    counts = rows.groupBy("window_id").agg(F.count("*").alias("n_train_obs"), F.count_distinct("unique_id").cast("int").alias("n_series"))
    return table.join(counts, "window_id", "left").na.fill(0)


def dev_only(panel: Panel, table: DataFrame) -> Panel:
    """The panel without anything behind the last development window."""
    end = table.where("stage = 'dev'").agg(F.max("last_pred")).first()[0]
    if end is None:
        raise PanelError("no development window")
    return Panel(panel.df.where(F.col("ds") <= F.lit(end)), panel.spec, panel.static)
