"""Backtests of any forecasters: each (model, window) writes its forecasts to a folder, and one
row tells how that went."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tsforge.operators.backtest import Backtest, prediction_faults, repair_quantiles, require_no_leak
from tsforge.operators.split import require_windows
from tsforge.operators.split import windows as make_windows
from tsforge.panel import Panel, missing
from tsforge.sources.shared import stored
from tsforge.spec import BacktestPlan, LeakError, PanelError, PanelSpec, quantile_column

#: Given the panel up to the cutoff, the window's row and what is known ahead over the window:
#: unique_id, ds, y_hat and any quantile columns.
Forecaster = Callable[[Panel, Row, DataFrame], DataFrame]


@dataclass(frozen=True)
class Stateful:
    """A forecaster in two parts: ``fit`` gives its fitted state as a frame, of the panel up to the
    cutoff and the window's row; ``predict`` gives forecasts from that state, the row of this or a
    later window and what is known ahead there. The state is written where it is made, and later
    windows read it until the next fit. ``expensive`` ones fit once unless the plan says otherwise."""

    fit: Callable[[Panel, Row], DataFrame]
    predict: Callable[[DataFrame, Row, DataFrame], DataFrame]
    expensive: bool = False

    def refit_every(self, plan: BacktestPlan, n_windows: int) -> int:
        return plan.refit_every or (n_windows if self.expensive else 1)


RUN_SCHEMA = (
    "model_id string, window_id short, status string, error string, refit boolean, refit_every short, fit_seconds float, predict_seconds float,"
    " n_params long, is_zero_shot boolean, quantile_crossings int"
)


def normalise_prediction(made: DataFrame, plan: BacktestPlan) -> DataFrame:
    """The columns of a forecast in their order and types; quantiles that a model doesn't give are
    null. Raises PanelError where keys or forecasts are missing or instants have a time zone."""
    kinds = dict(made.dtypes)
    if absent := {"unique_id", "ds", "y_hat"} - set(kinds):
        raise PanelError(f"a forecast lacks {sorted(absent)}")
    if kinds["ds"] != "timestamp_ntz":
        raise PanelError(f"ds is {kinds['ds']}, not timestamp_ntz")
    quantiles = [quantile_column(q) for q in plan.quantiles]
    return made.select(
        F.col("unique_id").cast("string").alias("unique_id"), "ds", missing("y_hat").alias("y_hat"),
        *((missing(c) if c in kinds else F.lit(None).cast("double")).alias(c) for c in quantiles),
    )


def require_future(frame: DataFrame, window: Row, spec: PanelSpec, ids: DataFrame) -> DataFrame:
    """A frame of what is known ahead: every future column, none of the target's or of the past's,
    nothing at or before the cutoff, and a row for each series and step of the window."""
    columns = set(frame.columns)
    if told := columns & {spec.target, *spec.hist_exog}:
        raise LeakError(f"{sorted(told)} isn't known ahead of time")
    if absent := {"unique_id", "ds", *spec.futr_exog} - columns:
        raise PanelError(f"the future frame lacks {sorted(absent)}")
    held = frame.agg(F.min("ds").alias("first"), F.count_distinct("unique_id", "ds").alias("n")).first()
    if held["first"] is not None and held["first"] <= window["cutoff"]:
        raise LeakError("the future frame begins at or before the cutoff")
    steps = (window["last_pred"] - window["first_pred"]).total_seconds() // spec.step + 1
    if held["n"] != ids.count() * steps:
        raise PanelError(f"the future frame has {held['n']} rows, not one for each series and step")
    return frame


def run_forecasters(panel: Panel, plan: BacktestPlan, forecasters: dict[str, Forecaster | Stateful], folder: str) -> Backtest:
    """Every forecaster on every window. Stateful ones fit on every ``refit_every``-th window (and on
    the one behind a failed fit) and predict the others from the latest state. A forecast that looks behind the cutoff stops the run;
    any other fault fails its (model, window) alone, which the runs table says. Crossing quantiles
    are put in order and counted. Windows and models are a handful, each one Spark's work. The panel
    is written once, so that what it is made of isn't read again by each of them."""
    spark, panel = panel.df.sparkSession, Panel(stored(panel.df, "panel"), panel.spec, panel.static)
    table = require_windows(make_windows(panel, plan))
    quantiles = [quantile_column(q) for q in plan.quantiles]
    paths, runs, states = [], [], {}
    windows = table.orderBy("window_id").collect()
    for window in windows:
        train = Panel(panel.df.where(F.col("ds").between(F.lit(window["train_start"]), F.lit(window["cutoff"]))), panel.spec, panel.static)
        ahead = panel.futr(window["first_pred"], window["last_pred"])
        if panel.spec.futr_exog:
            require_future(ahead, window, panel.spec, panel.ids())
        here = table.where(F.col("window_id") == window["window_id"])
        for name, forecast in forecasters.items():
            path = f"{folder.rstrip('/')}/model_id={name}/window_id={window['window_id']}"
            start, fitted, error, crossings = time.monotonic(), None, None, 0
            every = forecast.refit_every(plan, len(windows)) if isinstance(forecast, Stateful) else 1
            state, used = states.get(name, (None, every))
            refit = used >= every
            try:
                if isinstance(forecast, Stateful):
                    if refit:
                        states.pop(name, None)
                        state = f"{folder.rstrip('/')}/states/model_id={name}/window_id={window['window_id']}"
                        forecast.fit(train, window).write.mode("overwrite").parquet(state)
                        fitted = time.monotonic()
                    states[name] = state, 1 if refit else used + 1
                    given = forecast.predict(spark.read.parquet(state), window, ahead)
                else:
                    given = forecast(train, window, ahead)
                made = normalise_prediction(given, plan)
                fitted = fitted or (time.monotonic() if refit else start)
                repair_quantiles(made, quantiles).write.mode("overwrite").parquet(path)
                written = spark.read.parquet(path)
                faults = prediction_faults(written.withColumn("window_id", F.lit(window["window_id"]).cast("short")), here, panel.ids(), h=plan.h)
                require_no_leak(faults)
                broken = faults.first()
                error = None if broken is None else ", ".join(f"{k} {broken[k]}" for k in ("n_repeated", "n_outside", "n_unknown", "n_absent") if broken[k])
                error = "no rows" if broken is None else error or None
                crossings = 0 if error else written.where("crossed").count()
            except LeakError:
                raise
            except Exception as e:  # a model's fault is its own
                error = f"{type(e).__name__}: {e}"
            done = time.monotonic()
            runs.append((name, window["window_id"], "failed" if error else "ok", error, refit, every, (fitted or done) - start, done - (fitted or done), None, False, crossings))
            if not error:
                paths.append((name, window, path))
    parts = [
        spark.read.parquet(path).select(
            "unique_id", F.lit(name).alias("model_id"), F.lit(w["window_id"]).cast("short").alias("window_id"), F.lit(w["cutoff"]).cast("timestamp_ntz").alias("cutoff"), "ds",
            (F.timestamp_diff("SECOND", F.lit(w["first_pred"]).cast("timestamp_ntz"), "ds") / panel.spec.step + 1).cast("short").alias("h_step"), "y_hat", *quantiles,
        )
        for name, w, path in paths
    ]
    if not parts:
        raise PanelError("no forecaster has a forecast; " + "; ".join(f"{r[0]}: {r[3]}" for r in runs))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    actual = panel.df.select("unique_id", "ds", missing(panel.spec.target).alias("y"))
    return Backtest(rows.join(actual, ["unique_id", "ds"], "left"), table, spark.createDataFrame(runs, RUN_SCHEMA))


def timings(runs: DataFrame, windows: DataFrame, *, stage: str | None = None) -> DataFrame:
    """What each model cost over a stage's windows; seconds of fitting are averaged over the
    windows that fitted, those of predicting over the ones that went well."""
    if stage is not None:
        runs = runs.join(F.broadcast(windows.where(F.col("stage") == stage)), "window_id", "left_semi")
    of = lambda s: F.count_if(F.col("status") == s)
    zero = F.bool_or("is_zero_shot")
    return runs.groupBy("model_id").agg(
        F.max("n_params").alias("n_params"), F.sum("fit_seconds").alias("fit_seconds_total"), F.avg(F.when(F.col("refit"), F.col("fit_seconds"))).alias("fit_seconds_mean"),
        F.sum("predict_seconds").alias("predict_seconds_total"), F.avg(F.when(F.col("status") == "ok", F.col("predict_seconds"))).alias("predict_seconds_mean"),
        F.count_if("refit").alias("n_refits"), of("ok").alias("n_windows_ok"), of("failed").alias("n_windows_failed"), of("skipped").alias("n_windows_skipped"),
        zero.alias("is_zero_shot"), F.when(zero, "zero-shot").otherwise("fitted").alias("training_regime"),
    )


def with_timings(board: DataFrame, runs: DataFrame, windows: DataFrame, *, stage: str | None = None) -> DataFrame:
    return board.join(F.broadcast(timings(runs, windows, stage=stage)), "model_id", "left")


def ranked(board: DataFrame) -> DataFrame:
    """The leaderboard with ``place``: the models of each series, and of all together, by their
    scaled error, unknown ones last."""
    order = Window.partitionBy("unique_id").orderBy(F.asc_nulls_last(missing("mase")), "model_id")
    return board.withColumn("place", F.row_number().over(order))
