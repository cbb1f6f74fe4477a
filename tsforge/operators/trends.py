"""Backtests of piecewise linear trends with seasons and regressors, a fit for each (series, window).

Like the models that choose their own form, a series is gathered once and cut by the windows, a fit
is a row that becomes a row of numbers (its state), and windows without a refit take the latest
earlier state. Quantiles come from paths whose draws are seeded by the series and the window's
cutoff, so they don't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.functions import trend
from tsforge.operators.automodels import with_refits
from tsforge.operators.backtest import Backtest
from tsforge.operators.split import require_windows
from tsforge.operators.split import windows as make_windows
from tsforge.panel import Panel, missing, seconds
from tsforge.spec import BacktestPlan, PanelError, quantile_column


@dataclass(frozen=True)
class TrendModel:
    """``regressors``: future columns of the panel; ``holidays``: days whose flag is one regressor."""

    shape: trend.Shape = trend.Shape()
    regressors: tuple[str, ...] = ()
    holidays: tuple[date, ...] = ()
    samples: int = 200
    seed: int = 0
    min_context: int = 14
    name: str = "trend"

    def __post_init__(self):
        if self.samples < 1:
            raise ValueError("samples is 1 or more")

    def inputs(self, at: np.ndarray, given: list[Sequence[float | None]]) -> np.ndarray:
        """A column for each regressor, and one for holidays."""
        columns = [np.array(g, float) for g in given]
        if self.holidays:
            days = {(d - date(1970, 1, 1)).days for d in self.holidays}
            columns.append(np.isin(at // 86400, list(days)).astype(float))
        return np.column_stack(columns) if columns else np.empty((len(at), 0))

    def draws(self, series: str, cutoff: float) -> np.random.Generator:
        key = hashlib.blake2b(f"{self.seed}|{cutoff}|{series}".encode(), digest_size=8).digest()
        return np.random.default_rng(int.from_bytes(key, "little"))


def _gathered(panel: Panel, model: TrendModel) -> DataFrame:
    if absent := set(model.regressors) - set(panel.spec.futr_exog):
        raise PanelError(f"{sorted(absent)} aren't known ahead of time")
    values = [missing(c).alias(f"x{k}") for k, c in enumerate(model.regressors)]
    row = F.struct(seconds("ds").cast("double").alias("at"), "ds", missing(panel.spec.target).alias("y"), *values)
    return panel.df.groupBy("unique_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def _arrays(inside, model: TrendModel) -> list:
    names = ["at", "y", *(f"x{k}" for k in range(len(model.regressors)))]
    return [inside.getField(n).alias(n) for n in names]


def fitted_trends(panel: Panel, model: TrendModel, origins: DataFrame) -> DataFrame:
    """unique_id, window_id and the fitted state (an array of numbers) of each slice with enough values."""
    tasks = int(panel.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = F.filter("rows", lambda r: r["ds"].between(F.col("train_start"), F.col("cutoff")))
    cut = _gathered(panel, model).crossJoin(F.broadcast(origins)).select("unique_id", "window_id", *_arrays(inside, model))
    given = [f"x{k}" for k in range(len(model.regressors))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            states = []
            for r in df.to_dict("records"):
                at = np.array(r["at"], float)
                states.append(trend.fit(at, np.array(r["y"], float), model.inputs(at, [r[c] for c in given]), model.shape).numbers())
            yield df[["unique_id", "window_id"]].assign(state=states)

    enough = cut.where(F.size(F.filter("y", lambda v: v.isNotNull())) >= model.min_context).repartition(tasks, "unique_id", "window_id")
    return enough.mapInPandas(run, "unique_id string, window_id short, state array<double>")


def trend_backtest(panel: Panel, plan: BacktestPlan, model: TrendModel = TrendModel()) -> Backtest:
    """One fit serves all windows unless the plan says how often to refit. A window whose future
    regressors have gaps has no forecast at those steps."""
    table = require_windows(make_windows(panel, plan))
    refit_every = plan.refit_every or plan.n_windows
    marked = with_refits(table, refit_every)
    states = fitted_trends(panel, model, marked.where("refit").select("window_id", "train_start", "cutoff")).withColumnRenamed("window_id", "fit_window")
    inside = F.filter("rows", lambda r: r["ds"].between(F.col("first_pred"), F.col("last_pred")))
    target = marked.select("window_id", "cutoff", "first_pred", "last_pred", "fit_window", seconds("cutoff").cast("double").alias("cut"))
    ahead = _gathered(panel, model).crossJoin(F.broadcast(target)).select("unique_id", "window_id", "cutoff", "fit_window", "cut", inside.getField("ds").alias("ds"), *_arrays(inside, model))
    names, given = [quantile_column(q) for q in plan.quantiles], [f"x{k}" for k in range(len(model.regressors))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for r in df.to_dict("records"):
                at = np.array(r["at"], float)
                found, inputs = trend.Fit.of(r["state"]), model.inputs(at, [r[c] for c in given])
                paths = found.samples(model.shape, at, inputs, n=model.samples, rng=model.draws(r["unique_id"], r["cut"]))
                made = pd.DataFrame({"unique_id": r["unique_id"], "window_id": np.int16(r["window_id"]), "cutoff": r["cutoff"], "ds": r["ds"], "h_step": np.arange(1, len(at) + 1, dtype=np.int16), "y_hat": found.predict(model.shape, at, inputs)})
                made[names] = np.quantile(paths, plan.quantiles, axis=0).T
                yield made.dropna(subset=["y_hat"])

    schema = "unique_id string, window_id short, cutoff timestamp_ntz, ds timestamp_ntz, h_step short, y_hat double, " + ", ".join(f"{n} double" for n in names)
    made = ahead.join(states, ["unique_id", "fit_window"]).mapInPandas(run, schema)
    actual = panel.df.select("unique_id", "ds", missing(panel.spec.target).alias("y"))
    forecasts = made.select("unique_id", F.lit(model.name).alias("model_id"), "window_id", "cutoff", "ds", "h_step", "y_hat", *names).join(actual, ["unique_id", "ds"], "left")
    served = states.select("fit_window").distinct().withColumn("served", F.lit(True))
    status = F.when(F.col("served"), "ok").otherwise("skipped")
    runs = marked.join(served, "fit_window", "left").select(F.lit(model.name).alias("model_id"), "window_id", status.alias("status"), "refit", "fit_window", F.lit(refit_every).cast("short").alias("refit_every"))
    return Backtest(forecasts, table, runs)
