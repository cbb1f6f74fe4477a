"""Forecasters beyond the baselines: theta, exponential smoothing and ridge-Fourier by series, and
gradient-boosted trees over the feature frame of all series at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.functions import metrics
from tsforge.operators import features
from tsforge.operators.runs import Forecaster, run_forecasters
from tsforge.operators.split import dev_only
from tsforge.operators.split import windows as make_windows
from tsforge.panel import Panel, at_seconds, by_series, missing, seconds
from tsforge.spec import BacktestPlan

SCHEMA = "unique_id string, model_id string, window_id short, cutoff timestamp_ntz, ds timestamp_ntz, h_step short, y_hat double"


def _seasonal_shape(y: np.ndarray, m: int) -> np.ndarray:
    """Mean deviation from the level at each place of the season; zeros where too short."""
    if len(y) < 2 * m:
        return np.zeros(m)
    return np.array([(y - y.mean())[k::m].mean() for k in range(m)])


def theta(y: np.ndarray, h: int, m: int) -> np.ndarray:
    """Half the trend of a line plus smoothing, on the seasonally adjusted series."""
    shape = _seasonal_shape(y, m)
    flat = y - shape[np.arange(len(y)) % m]
    slope = np.polyfit(np.arange(len(y)), flat, 1)[0] if len(y) > 1 else 0.0
    level = _smoothed(flat)
    return level + slope / 2 * np.arange(1, h + 1) + shape[(len(y) + np.arange(h)) % m]


def _smoothed(y: np.ndarray) -> float:
    """The level of simple exponential smoothing with the best of a few weights."""
    best = (np.inf, y[-1])
    for a in (0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9):
        level, loss = y[0], 0.0
        for v in y[1:]:
            loss += (v - level) ** 2
            level += a * (v - level)
        best = min(best, (loss, level))
    return best[1]


def ets(y: np.ndarray, h: int, m: int) -> np.ndarray:
    shape = _seasonal_shape(y, m)
    return np.full(h, _smoothed(y - shape[np.arange(len(y)) % m])) + shape[(len(y) + np.arange(h)) % m]


def ridge_fourier(y: np.ndarray, h: int, m: int, *, order: int = 3, ridge: float = 1.0) -> np.ndarray:
    def design(t: np.ndarray) -> np.ndarray:
        waves = [f(2 * np.pi * k * t / m) for k in range(1, min(order, m // 2) + 1) for f in (np.sin, np.cos)]
        return np.column_stack([np.ones(len(t)), t / len(y), *waves])

    x = design(np.arange(len(y)))
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1))
    return design(np.arange(len(y), len(y) + h)) @ np.linalg.solve(x.T @ x + penalty, x.T @ y)


MODELS: dict[str, Callable] = {"theta": theta, "ets": ets, "ridge_fourier": ridge_fourier}


def backtest_series(panel: Panel, plan: BacktestPlan, *, models: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """Each (series, window) is one group: a training slice, forecast by all models."""
    table, m, step = make_windows(panel, plan), panel.spec.mase_season, pd.Timedelta(seconds=panel.spec.step)
    rows = panel.df.select("unique_id", "ds", missing(panel.spec.target).alias("v")).join(F.broadcast(table), F.col("ds").between(F.col("train_start"), F.col("cutoff")))
    h = plan.h

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("ds")
        y = df["v"].ffill().dropna().to_numpy(float)
        parts = []
        for name in models if len(y) >= m + 2 else ():
            head = df.iloc[0]
            parts.append(pd.DataFrame({
                "unique_id": head["unique_id"], "model_id": name, "window_id": head["window_id"], "cutoff": head["cutoff"],
                "ds": [head["first_pred"] + k * step for k in range(h)], "h_step": np.arange(1, h + 1, dtype=np.int16), "y_hat": MODELS[name](y, h, m),
            }))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["unique_id", "model_id", "window_id", "cutoff", "ds", "h_step", "y_hat"])

    return rows.groupBy("unique_id", "window_id").applyInPandas(run, SCHEMA)


def boosted_direct(panel: Panel, plan: BacktestPlan, *, lags: tuple[int, ...] = (1, 2, 7, 14), trees: int = 20, depth: int = 4) -> DataFrame:
    """One model for every step of the horizon at once, the step being a feature: what is known at
    the cutoff predicts the step-th row behind it. One fit for each window, over all series. Gaps
    of the inputs hold the last value known by then, labels stay as they are; a series without any
    value before its lags gets no forecast (``without_forecast`` lists those)."""
    table = make_windows(panel, plan)
    target, back = panel.spec.target, by_series().rowsBetween(Window.unboundedPreceding, 0)
    truth = panel.df.select("unique_id", "ds", missing(target).alias("truth"))
    panel = Panel(panel.df.withColumn(target, F.last(missing(target), True).over(back)), panel.spec, panel.static)
    y = features.source(panel, target)
    lagged = features.feature_frame(panel, [features.lag(y, k) for k in (k for k in lags if k > 1)] + [features.roll(y, panel.spec.mase_season)])
    known = lagged.join(panel.df.select("unique_id", "ds", F.col(target).alias("now")).join(truth, ["unique_id", "ds"]), ["unique_id", "ds"])
    inputs = [c for c in known.columns if c not in ("unique_id", "ds", "truth")]
    steps = range(1 + plan.gap, plan.h + plan.gap + 1)
    led = known.select("unique_id", "ds", *inputs, *(F.lead("truth", k).over(by_series()).alias(f"now_{k}") for k in steps))
    ahead = [F.struct(F.lit(float(k)).alias("step"), F.col(f"now_{k}").alias("label"), at_seconds(seconds("ds") + k * panel.spec.step).alias("target_ds")) for k in steps]
    rows = led.na.drop(subset=inputs).select("unique_id", "ds", *inputs, F.explode(F.array(*ahead)).alias("a")).select("unique_id", "ds", *inputs, "a.*")
    shaped = VectorAssembler(inputCols=[*inputs, "step"], outputCol="features").transform(rows)
    out = None
    for w in table.collect():  # a handful of windows, each one distributed fit
        train = shaped.where((F.col("target_ds") <= F.lit(w["cutoff"])) & (F.col("ds") >= F.lit(w["train_start"])) & F.col("label").isNotNull())
        model = GBTRegressor(labelCol="label", maxIter=trees, maxDepth=depth, seed=1).fit(train)
        made = model.transform(shaped.where(F.col("ds") == F.lit(w["cutoff"]))).select(
            "unique_id", F.lit("boosted_direct").alias("model_id"), F.lit(w["window_id"]).cast("short").alias("window_id"), F.lit(w["cutoff"]).cast("timestamp_ntz").alias("cutoff"),
            F.col("target_ds").alias("ds"), (F.col("step") - plan.gap).cast("short").alias("h_step"), F.col("prediction").alias("y_hat"),
        )
        out = made if out is None else out.union(made)
    return out


def without_forecast(panel: Panel, forecasts: DataFrame, windows: DataFrame) -> DataFrame:
    """(unique_id, window_id) that a model gave no forecast for."""
    every = panel.ids().crossJoin(F.broadcast(windows.select("window_id")))
    return every.join(forecasts.select("unique_id", "window_id").distinct(), ["unique_id", "window_id"], "left_anti")


@dataclass(frozen=True)
class TuningResult:
    """``table``: (model_id, value) of every candidate, the best first; a candidate without a
    finite value stands last with the worst."""

    best: str
    table: DataFrame
    plan: BacktestPlan
    n_windows: int


def tune(panel: Panel, plan: BacktestPlan, candidates: dict[str, Forecaster], folder: str, *, metric: str = "mase", direction: str = "minimize") -> TuningResult:
    """The candidates (models with their settings) on the development windows alone, of a panel
    that ends with the last of them, by a column of the leaderboard."""
    if direction not in ("minimize", "maximize"):
        raise ValueError("direction is minimize or maximize")
    dev = dev_only(panel, make_windows(panel, plan))
    dev_plan = replace(plan, n_windows=plan.n_windows - plan.holdout_windows, holdout_windows=0)
    run = run_forecasters(dev, dev_plan, candidates, folder)
    scored = metrics.scored(run.forecasts, metrics.mase_denominators(dev, run.windows))
    board = metrics.leaderboard(scored, quantiles=plan.quantiles).where("overall")
    if metric not in board.columns:
        raise ValueError(f"the leaderboard has no {metric}")
    worst = float("inf") if direction == "minimize" else float("-inf")
    every = panel.df.sparkSession.createDataFrame([(c,) for c in candidates], "model_id string")
    value = F.coalesce(missing(metric), F.lit(worst))
    found = every.join(board.select("model_id", metric), "model_id", "left").select("model_id", value.alias("value"))
    table = found.orderBy("value" if direction == "minimize" else F.desc("value"), "model_id")
    return TuningResult(table.first()["model_id"], table, dev_plan, run.windows.count())


def tune_window_average(panel: Panel, plan: BacktestPlan, candidates: tuple[int, ...] = (3, 7, 14, 28)) -> DataFrame:
    """(average, mae) of every candidate on the development windows, in one plan."""
    table = make_windows(panel, plan).where("stage = 'dev'")
    y = missing(panel.spec.target)
    rows = panel.df.select("unique_id", "ds", y.alias("v")).join(F.broadcast(table), F.col("ds").between(F.col("train_start"), F.col("last_pred")))
    behind = F.floor(F.timestamp_diff("SECOND", "ds", "cutoff") / panel.spec.step)
    train = rows.where("ds <= cutoff").withColumn("behind", behind)
    levels = train.groupBy("unique_id", "window_id").agg(*(F.avg(F.when(F.col("behind") < k, F.col("v"))).alias(str(k)) for k in candidates))
    long = levels.unpivot(["unique_id", "window_id"], [str(k) for k in candidates], "average", "y_hat")
    scored = rows.where("ds >= first_pred").join(long, ["unique_id", "window_id"])
    return scored.groupBy(F.col("average").cast("int").alias("average")).agg(F.avg(F.abs(F.col("v") - F.col("y_hat"))).alias("mae"))
