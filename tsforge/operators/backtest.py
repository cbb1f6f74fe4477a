"""Backtests of the baseline models, all windows and models in one plan.

Windows meet the panel in one broadcast range join (a windows table has one row for each origin).
Everything that the five models need of a training slice is one grouped aggregate over series and
window, which Spark sums up where rows are read; the horizon is exploded from that small table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.operators.split import windows as make_windows
from tsforge.panel import by_series, Panel, at_seconds, missing, seconds
from tsforge.spec import BacktestPlan, LeakError, normal_quantile, quantile_column

MODELS = ("naive", "drift", "seasonal_naive", "window_average", "historic_average")
MIN_CONTEXT = {"naive": 2, "drift": 2, "window_average": 1, "historic_average": 1}


@dataclass(frozen=True)
class Backtest:
    forecasts: DataFrame
    windows: DataFrame
    model_runs: DataFrame


def _filled(panel: Panel) -> DataFrame:
    """Target and its differences, forward filled; filled_at tells where a value comes from."""
    back = by_series().rowsBetween(Window.unboundedPreceding, 0)
    y = missing(panel.spec.target)
    m = panel.spec.mase_season
    base = panel.df.select("unique_id", "ds", F.last(y, True).over(back).alias("v"), F.last(F.when(y.isNotNull(), F.col("ds")), True).over(back).alias("filled_at"))
    for name, k in (("1", 1), ("m", m)):
        base = base.withColumn(f"v{name}", F.lag("v", k).over(by_series())).withColumn(f"at{name}", F.lag("filled_at", k).over(by_series())).withColumn(f"ds{name}", F.lag("ds", k).over(by_series()))
    return base


def train_states(panel: Panel, table: DataFrame, *, average: int) -> DataFrame:
    """One row for each (series, window): what the baselines know of the training slice."""
    m, step = panel.spec.mase_season, panel.spec.step
    rows = _filled(panel).join(F.broadcast(table), F.col("ds").between(F.col("train_start"), F.col("cutoff")))
    v = F.when(F.col("filled_at") >= F.col("train_start"), F.col("v"))
    one = F.when(F.col("at1") >= F.col("train_start"), v - F.col("v1"))
    season = F.when(F.col("atm") >= F.col("train_start"), v - F.col("vm"))
    rows = rows.select("unique_id", "window_id", "cutoff", "first_pred", "ds", v.alias("v"), one.alias("d1"), season.alias("dm"))
    behind = ((seconds("cutoff") - seconds("ds")) / step).cast("int")
    recent = F.col("behind") < average
    return rows.withColumn("behind", behind).groupBy("unique_id", "window_id", "cutoff", "first_pred").agg(
        F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("n_missing"),
        F.max_by("v", "ds").alias("last"), F.min_by("v", "ds").alias("first"), F.stddev_samp("d1").alias("sd_step"), F.stddev_samp("dm").alias("sd_season"),
        F.avg("v").alias("mean_all"), F.stddev_samp("v").alias("sd_all"),
        F.avg(F.when(recent, F.col("v"))).alias("mean_recent"), F.stddev_samp(F.when(recent, F.col("v"))).alias("sd_recent"),
        F.map_from_entries(F.collect_list(F.when(F.col("behind") < m, F.struct("behind", "v")))).alias("season"),
    )


def _steps(model: str, m: int) -> tuple[Column, Column]:
    """Forecast and sigma at h_step, from a training state."""
    h, n = F.col("h_step"), F.col("n")
    slope = F.try_divide(F.col("last") - F.col("first"), n - 1)
    return {
        "naive": (F.col("last"), F.col("sd_step") * F.sqrt(h)),
        "drift": (F.col("last") + slope * h, F.col("sd_step") * F.sqrt(h * (1 + h / F.greatest(n - 1, F.lit(1))))),
        "seasonal_naive": (F.try_element_at("season", (m - 1 - (h - 1) % m).cast("int")), F.col("sd_season") * F.sqrt(F.floor((h - 1) / m) + 1)),
        "window_average": (F.col("mean_recent"), F.col("sd_recent")),
        "historic_average": (F.col("mean_all"), F.col("sd_all") * F.sqrt(1 + 1 / n)),
    }[model]


def backtest(panel: Panel, plan: BacktestPlan, *, models: tuple[str, ...] = MODELS, average: int | None = None) -> Backtest:
    m, step = panel.spec.mase_season, panel.spec.step
    table = make_windows(panel, plan)
    states = train_states(panel, table, average=average or m)
    enough = {k: MIN_CONTEXT.get(k, m + 2) for k in models}
    ready = states.where("n_missing = 0").select("*", F.explode(F.sequence(F.lit(1), F.lit(plan.h))).alias("h_step"))
    each = F.array(*(F.struct(F.lit(k).alias("model_id"), F.lit(enough[k]).alias("least"), *(c.alias(a) for c, a in zip(_steps(k, m), ("y_hat", "sigma"), strict=True))) for k in models))
    rows = ready.withColumn("each", F.explode(each)).where(F.col("n") >= F.col("each.least"))
    ds = at_seconds(seconds("first_pred") + (F.col("h_step") - 1) * step)
    y_hat, sigma = F.col("each.y_hat"), F.col("each.sigma")
    quantiles = [(y_hat + sigma * normal_quantile(q)).alias(quantile_column(q)) for q in plan.quantiles]
    predicted = rows.select("unique_id", F.col("each.model_id").alias("model_id"), "window_id", "cutoff", ds.alias("ds"), F.col("h_step").cast("short").alias("h_step"), y_hat.alias("y_hat"), sigma.alias("sigma"), *quantiles)
    actual = panel.df.select("unique_id", "ds", missing(panel.spec.target).alias("y"))
    forecasts = predicted.join(actual, ["unique_id", "ds"], "left")
    least = F.create_map(*(F.lit(x) for kv in enough.items() for x in kv))
    runs = states.groupBy("window_id").agg(F.min("n").alias("n"), F.sum("n_missing").alias("n_missing")).withColumn("model_id", F.explode(F.array(*map(F.lit, models))))
    status = F.when(F.col("n") < least[F.col("model_id")], "skipped").when(F.col("n_missing") > 0, "failed").otherwise("ok")
    return Backtest(forecasts, table, runs.select("model_id", "window_id", status.alias("status"), "n_missing"))


def repair_quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quantiles of each row in ascending order; missing ones keep their place. crossed says where."""
    known = F.array_sort(F.filter(F.array(*(missing(c) for c in columns)), lambda x: x.isNotNull()))
    fixed = []
    for i, c in enumerate(columns):
        place = sum((missing(b).isNotNull().cast("int") for b in columns[:i]), F.lit(0)) + 1
        fixed.append(F.when(missing(c).isNotNull(), F.try_element_at(known, place)))
    crossed = F.lit(False)
    for c, f in zip(columns, fixed, strict=True):
        crossed = crossed | F.coalesce(missing(c) != f, F.lit(False))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, *(f.alias(c) for f, c in zip(fixed, columns, strict=True)), crossed.alias("crossed"))


def prediction_faults(predicted: DataFrame, table: DataFrame, ids: DataFrame, *, h: int) -> DataFrame:
    """What a forecaster's rows break, counted by window: rows at or before the cutoff, repeated
    keys, instants outside the window, and missing or unknown series."""
    joined = predicted.join(F.broadcast(table), "window_id")
    keys = joined.groupBy("window_id", "cutoff", "first_pred", "last_pred", "unique_id", "ds").agg(F.count("*").alias("n"))
    known = keys.join(ids.select("unique_id", F.lit(True).alias("known")), "unique_id", "left")
    by = known.groupBy("window_id").agg(
        F.count_if(F.col("ds") <= F.col("cutoff")).alias("n_leaks"), F.count_if(F.col("n") > 1).alias("n_repeated"),
        F.count_if(~F.col("ds").between(F.col("first_pred"), F.col("last_pred"))).alias("n_outside"), F.count_if(F.col("known").isNull()).alias("n_unknown"),
        F.count_if(F.col("known")).alias("n_known"),
    )
    expected = ids.agg((F.count_distinct("unique_id") * h).alias("expected"))
    return by.crossJoin(F.broadcast(expected)).select("window_id", "n_leaks", "n_repeated", "n_outside", "n_unknown", (F.col("expected") - F.col("n_known")).alias("n_absent"))


def require_no_leak(faults: DataFrame) -> None:
    if not faults.where("n_leaks > 0").isEmpty():
        raise LeakError("a prediction lies at or before its cutoff")
