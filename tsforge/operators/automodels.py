"""Models that choose their own form: seasonal ARIMA and exponential smoothing.

A fit is a row. Each series is gathered once and cut by the windows, every (series, window) is
exploded over the candidate forms, and these rows are dealt over all tasks, each of which is one
small fit. The best few by the criterion are fitted once more in full, the winner is found by
``min_by``, and what it needs to forecast (its fitted state) is a row keyed by (series, window).
Forecasts join states to windows: a window that doesn't refit takes the latest earlier one that
does, and forecasts from that one's cutoff on.

Intervals come from inner origins: the same model is fitted ``calibration`` times more on what
ends one horizon, two horizons ... before the cutoff, in the same pass, and the sizes of its errors
at each step, to both sides of the forecast, give the quantiles.

Gaps hold the last value before them, those at the beginning the mean; a slice shorter than
``min_context`` has no model, and its window is skipped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.functions import arima, ets
from tsforge.operators.backtest import Backtest
from tsforge.operators.runs import Stateful
from tsforge.operators.split import require_windows
from tsforge.operators.split import windows as make_windows
from tsforge.panel import Panel, at_seconds, missing, seconds
from tsforge.spec import BacktestPlan, PanelError, quantile_column

KEYS = ["unique_id", "window_id", "inner"]


class AutoModel(Protocol):
    """``hint`` is what a slice says beforehand, ``spec`` names a form, ``found`` are its numbers."""

    name: str
    shortlist: int

    def specs(self) -> list[str]: ...
    def hint(self, y: np.ndarray, m: int) -> str: ...
    def fit(self, y: np.ndarray, spec: str, hint: str, m: int) -> tuple[float, np.ndarray]: ...
    def finish(self, y: np.ndarray, spec: str, hint: str, m: int, found: np.ndarray) -> tuple[float, np.ndarray]: ...
    def state(self, y: np.ndarray, spec: str, hint: str, m: int, found: np.ndarray) -> np.ndarray: ...
    def forecast(self, state: np.ndarray, spec: str, h: int) -> np.ndarray: ...


@dataclass(frozen=True)
class AutoArima:
    """All orders within the bounds, by the conditional likelihood; the ``shortlist`` best of them
    (all, if it is 0) by the exact one."""

    max_p: int = 3
    max_q: int = 3
    max_season_p: int = 1
    max_season_q: int = 1
    max_order: int = 5
    shortlist: int = 5
    name: str = "auto_arima"

    def specs(self) -> list[str]:
        bounds = (self.max_p, self.max_q, self.max_season_p, self.max_season_q, 1)
        return [",".join(map(str, o)) for o in itertools.product(*(range(b + 1) for b in bounds)) if sum(o[:4]) <= self.max_order]

    @staticmethod
    def orders(spec: str, hint: str) -> tuple[arima.Model, int, int]:
        d, season = map(int, hint.split(","))
        return tuple(map(int, spec.split(","))), d, season

    def hint(self, y: np.ndarray, m: int) -> str:
        return "{},{}".format(*arima.differences(y, m))

    def fit(self, y: np.ndarray, spec: str, hint: str, m: int) -> tuple[float, np.ndarray]:
        return arima.fit_conditional(y, *self.orders(spec, hint), m)

    def finish(self, y: np.ndarray, spec: str, hint: str, m: int, found: np.ndarray) -> tuple[float, np.ndarray]:
        return arima.fit_exact(y, *self.orders(spec, hint), m, found)

    def state(self, y: np.ndarray, spec: str, hint: str, m: int, found: np.ndarray) -> np.ndarray:
        ar, ma, constant, values, last = arima.end_state(y, *self.orders(spec, hint), m, found)
        return np.r_[len(ar), len(ma), constant, ar, ma, values, last]

    def forecast(self, state: np.ndarray, spec: str, h: int) -> np.ndarray:
        p, q = int(state[0]), int(state[1])
        ar, ma, values, last = np.split(state[3:], np.cumsum([p, q, p]))
        return arima.forecast((ar, ma, float(state[2]), values, last), h)


@dataclass(frozen=True)
class AutoEts:
    """``model``: three letters for error, trend and season; Z leaves one open."""

    model: str = "ZZZ"
    shortlist: int = 1
    name: str = "auto_ets"

    def specs(self) -> list[str]:
        return ets.forms(self.model)

    def hint(self, y: np.ndarray, m: int) -> str:
        return ""

    def fit(self, y: np.ndarray, spec: str, hint: str, m: int) -> tuple[float, np.ndarray]:
        return ets.fit(y, spec, m)

    def finish(self, y: np.ndarray, spec: str, hint: str, m: int, found: np.ndarray) -> tuple[float, np.ndarray]:
        return ets.fit(y, spec, m)

    def state(self, y: np.ndarray, spec: str, hint: str, m: int, found: np.ndarray) -> np.ndarray:
        return ets.end_state(y, spec, m, found)

    def forecast(self, state: np.ndarray, spec: str, h: int) -> np.ndarray:
        return ets.forecast(state, spec, h)


def filled(values: Sequence[float | None]) -> np.ndarray:
    """Gaps with the last value before them, else with the mean, else with 0."""
    y = pd.Series(np.array(values, float)).ffill()
    return y.fillna(y.mean()).fillna(0.0).to_numpy()


def with_refits(table: DataFrame, refit_every: int) -> DataFrame:
    """The windows with refit, and the window whose fit each one uses (as of its cutoff) with that
    one's cutoff. A plan's windows fit into one task."""
    order = Window.partitionBy(F.lit(1)).orderBy("cutoff")
    placed = table.withColumn("refit", (F.row_number().over(order) - 1) % refit_every == 0)
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    latest = lambda c: F.last(F.when(F.col("refit"), F.col(c)), True).over(back)
    return placed.withColumns({"fit_window": latest("window_id"), "fit_cutoff": latest("cutoff")})


def slices(panel: Panel, origins: DataFrame) -> DataFrame:
    """unique_id, window_id, inner, cutoff and the array y of each slice; a series is gathered once."""
    rows = panel.df.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("ds", missing(panel.spec.target).alias("v")))).alias("rows"))
    inside = F.filter("rows", lambda r: r["ds"].between(F.col("train_start"), F.col("cutoff")))
    return rows.crossJoin(F.broadcast(origins)).select(*KEYS, "cutoff", F.transform(inside, lambda r: r["v"]).alias("y"))


def fitted_states(model: AutoModel, cut: DataFrame, m: int, *, min_context: int) -> DataFrame:
    """unique_id, window_id, inner, spec, hint, criterion and state of the best form of each slice."""
    tasks = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = "unique_id string, window_id short, inner int"

    def prepare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            df["y"] = [filled(y) for y in df["y"]]
            df["hint"] = [model.hint(y, m) for y in df["y"]]
            yield df[[*KEYS, "y", "hint"]]

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            fits = [model.fit(np.asarray(y), spec, hint, m) for y, spec, hint in zip(df["y"], df["spec"], df["hint"], strict=True)]
            df["criterion"], df["found"] = [float(c) for c, _ in fits], [x for _, x in fits]
            yield df[[*KEYS, "spec", "criterion", "found"]]

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for *key, y, hint, spec, found in df[[*KEYS, "y", "hint", "spec", "found"]].itertuples(index=False):
                y = np.asarray(y)
                criterion, found = model.finish(y, spec, hint, m, np.asarray(found))
                out.append((*key, spec, hint, float(criterion), model.state(y, spec, hint, m, found)))
            yield pd.DataFrame(out, columns=[*KEYS, "spec", "hint", "criterion", "state"])

    long = cut.where(F.size("y") >= min_context).mapInPandas(prepare, f"{keys}, y array<double>, hint string")
    tried = long.withColumn("spec", F.explode(F.array(*map(F.lit, model.specs())))).repartition(tasks, *KEYS, "spec")
    fits = tried.mapInPandas(fit, f"{keys}, spec string, criterion double, found array<double>").where(F.col("criterion") < float("inf"))
    if model.shortlist:
        order = Window.partitionBy(*KEYS).orderBy("criterion", "spec")
        fits = fits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= model.shortlist).drop("place")
    full = long.join(fits.drop("criterion"), KEYS).repartition(tasks, *KEYS, "spec").mapInPandas(finish, f"{keys}, spec string, hint string, criterion double, state array<double>")
    whole = F.struct("spec", "hint", "criterion", "state")
    return full.groupBy(*KEYS).agg(F.min_by(whole, F.struct("criterion", "spec")).alias("best")).select(*KEYS, "best.*")


def predicted(model: AutoModel, states: DataFrame, targets: DataFrame, *, h: int, step: int) -> DataFrame:
    """unique_id, window_id, inner, cutoff, ds, h_step, y_hat. ``targets``: window_id, inner, cutoff,
    first_pred, and the (fit_window, fit_cutoff) whose state is used."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            df["y_hat"] = [model.forecast(np.asarray(state), spec, int(ahead) + h - 1)[-h:] for state, spec, ahead in zip(df["state"], df["spec"], df["ahead"], strict=True)]
            yield df[[*KEYS, "cutoff", "first_pred", "y_hat"]]

    used = states.withColumnRenamed("window_id", "fit_window")
    ahead = ((seconds("first_pred") - seconds("fit_cutoff")) / step).cast("int")
    joined = used.join(F.broadcast(targets), ["fit_window", "inner"]).select(*KEYS, "cutoff", "first_pred", "spec", "state", ahead.alias("ahead"))
    made = joined.mapInPandas(run, "unique_id string, window_id short, inner int, cutoff timestamp_ntz, first_pred timestamp_ntz, y_hat array<double>")
    rows = made.select(*KEYS, "cutoff", "first_pred", F.posexplode("y_hat").alias("place", "y_hat"))
    return rows.select(*KEYS, "cutoff", at_seconds(seconds("first_pred") + F.col("place") * step).alias("ds"), (F.col("place") + 1).cast("short").alias("h_step"), "y_hat")


def calibrated_quantiles(levels: Sequence[int], quantiles: Sequence[float]) -> list[float]:
    """Those quantiles that the central intervals of ``levels`` (percent) have as ends, and 0.5."""
    if any(not 0 < level < 100 for level in levels):
        raise ValueError("levels are percentages between 0 and 100")
    ends = {round(side, 6) for level in levels for side in ((100 - level) / 200, 1 - (100 - level) / 200)}
    return [q for q in quantiles if round(q, 6) in ends | {0.5}]


def error_shifts(errors: DataFrame, keys: list[str], quantiles: Sequence[float]) -> DataFrame:
    """``keys`` and, for each quantile, how far it lies from the forecast: the quantile of the sizes
    of the errors (column e), each counted to both sides."""
    sides = errors.where(F.col("e").isNotNull()).select(*keys, F.explode(F.array(F.abs("e"), -F.abs("e"))).alias("e"))
    return sides.groupBy(*keys).agg(*(F.percentile("e", F.lit(q)).alias(quantile_column(q)) for q in quantiles))


def interval_columns(shifts: DataFrame, known: Sequence[float], wanted: Sequence[float]) -> list[Column]:
    """y_hat moved by the joined ``shifts``; quantiles without one are null, 0.5 is the forecast."""
    out = []
    for q in wanted:
        c = F.col("y_hat") if round(q, 6) == 0.5 else F.col("y_hat") + shifts[quantile_column(q)] if q in known else F.lit(None).cast("double")
        out.append(c.alias(quantile_column(q)))
    return out


def auto_backtest(panel: Panel, plan: BacktestPlan, model: AutoModel, *, season: int | None = None, calibration: int = 2, levels: Sequence[int] = (80, 95), min_context: int | None = None) -> Backtest:
    """The model on all windows of the plan. ``calibration``: inner origins (0: no intervals, at
    least 2 otherwise). Without ``plan.refit_every`` one fit, that of the first window, serves all
    windows if there are no intervals; with them every window refits, for errors are known up to
    the plan's own horizon alone."""
    m, step = season or panel.spec.mase_season, panel.spec.step
    if calibration == 1 or calibration < 0:
        raise ValueError("calibration takes two inner origins at least, or none")
    table = require_windows(make_windows(panel, plan))
    refit_every = plan.refit_every or (1 if calibration else plan.n_windows)
    if calibration and refit_every > 1:
        raise ValueError("intervals are calibrated for the plan's horizon, so every window has to refit: set refit_every=1 or calibration=0")
    least = min_context or (max(2 * m, calibration * plan.h + 1) if calibration else 2 * m)
    marked = with_refits(table, refit_every)
    # Inner origins end where their last step is still before the cutoff.
    each = F.explode(F.sequence(F.lit(0), F.lit(calibration))).alias("inner")
    back = F.when(F.col("inner") > 0, F.col("inner") * plan.h + plan.gap).otherwise(0)
    moved = lambda c: at_seconds(seconds(c) - back * step).alias(c)
    origins = marked.where("refit").select("*", each).select("window_id", "inner", "train_start", moved("cutoff"), moved("first_pred"), moved("fit_cutoff"), "fit_window")
    # A window counts by its whole slice; its inner origins are shorter.
    cut = slices(panel, origins.select("window_id", "inner", "train_start", "cutoff"))
    states = fitted_states(model, cut.where((F.col("inner") > 0) | (F.size("y") >= least)), m, min_context=2 * m)
    targets = marked.select("window_id", F.lit(0).alias("inner"), "cutoff", "first_pred", "fit_window", "fit_cutoff")
    inner = origins.where("inner > 0").select("window_id", "inner", "cutoff", "first_pred", "fit_window", "fit_cutoff")
    made = predicted(model, states, targets.unionByName(inner), h=plan.h, step=step)
    actual = panel.df.select("unique_id", "ds", missing(panel.spec.target).alias("y"))
    rows = made.join(actual, ["unique_id", "ds"], "left")
    known = calibrated_quantiles(levels, plan.quantiles) if calibration else []
    by = ["unique_id", "window_id", "h_step"]
    shifts = error_shifts(rows.where("inner > 0").select(*by, (F.col("y") - F.col("y_hat")).alias("e")), by, known) if known else None
    final = rows.where("inner = 0")
    final = final.join(shifts, by, "left") if known else final
    quantiles = interval_columns(shifts, known, plan.quantiles) if known else [F.lit(None).cast("double").alias(quantile_column(q)) for q in plan.quantiles]
    forecasts = final.select("unique_id", F.lit(model.name).alias("model_id"), "window_id", "cutoff", "ds", "h_step", "y_hat", *quantiles, "y")
    served = forecasts.select("window_id").distinct().withColumn("served", F.lit(True))
    status = F.when(F.col("served"), "ok").otherwise("skipped")
    runs = marked.join(served, "window_id", "left").select(F.lit(model.name).alias("model_id"), "window_id", status.alias("status"), "refit", "fit_window", F.lit(refit_every).cast("short").alias("refit_every"))
    return Backtest(forecasts, table, runs)


def stateful(model: AutoModel, panel: Panel, plan: BacktestPlan, *, season: int | None = None) -> Stateful:
    """The model for ``run_forecasters``, without intervals."""
    m, step = season or panel.spec.mase_season, panel.spec.step

    def fit(train: Panel, window) -> DataFrame:
        origin = train.df.sparkSession.createDataFrame([(window["window_id"], 0, window["train_start"], window["cutoff"])], "window_id short, inner int, train_start timestamp_ntz, cutoff timestamp_ntz")
        states = fitted_states(model, slices(train, origin), m, min_context=2 * m)
        return states.withColumn("fit_cutoff", F.lit(window["cutoff"]).cast("timestamp_ntz"))

    def predict(states: DataFrame, window, ahead: DataFrame) -> DataFrame:
        now = [F.lit(window[c]).cast("timestamp_ntz").alias(c) for c in ("cutoff", "first_pred")]
        targets = states.select(F.lit(window["window_id"]).cast("short").alias("window_id"), "inner", *now, F.col("window_id").alias("fit_window"), "fit_cutoff").distinct()
        return predicted(model, states.drop("fit_cutoff"), targets, h=plan.h, step=step).select("unique_id", "ds", "y_hat")

    return Stateful(fit, predict, expensive=True)


def calibrated(forecast, *, h: int, windows: int = 2, levels: Sequence[int] = (80, 95), quantiles: Sequence[float], gap: int = 0):
    """Any forecaster of ``run_forecasters``, with intervals: it runs on ``windows`` inner origins of
    the slice it is given, and its errors there by step give the quantiles."""
    if windows < 2:
        raise ValueError("calibration takes two inner origins at least")
    known = calibrated_quantiles(levels, quantiles)

    def run(train: Panel, window, ahead: DataFrame) -> DataFrame:
        step = pd.Timedelta(seconds=train.spec.step)
        ds, actual, errors = F.col("ds"), train.df.select("unique_id", "ds", missing(train.spec.target).alias("y")), None
        for k in range(1, windows + 1):
            cutoff = window["cutoff"] - (k * h + gap) * step
            if cutoff <= window["train_start"]:
                raise PanelError("the slice is too short for its inner origins")
            first, last = cutoff + (gap + 1) * step, cutoff + (gap + h) * step
            past = Panel(train.df.where(ds <= F.lit(cutoff).cast("timestamp_ntz")), train.spec, train.static)
            inner = type(window)(**(window.asDict() | {"cutoff": cutoff, "first_pred": first, "last_pred": last}))
            made = forecast(past, inner, train.futr(first, last)).join(actual, ["unique_id", "ds"])
            place = (F.timestamp_diff("SECOND", F.lit(first).cast("timestamp_ntz"), ds) / train.spec.step).cast("int")
            part = made.select("unique_id", place.alias("place"), (F.col("y") - F.col("y_hat")).alias("e"))
            errors = part if errors is None else errors.union(part)
        shifts = error_shifts(errors, ["unique_id", "place"], known)
        place = (F.timestamp_diff("SECOND", F.lit(window["first_pred"]).cast("timestamp_ntz"), ds) / train.spec.step).cast("int")
        made = forecast(train, window, ahead).select("unique_id", "ds", "y_hat", place.alias("place")).join(shifts, ["unique_id", "place"], "left")
        return made.select("unique_id", "ds", "y_hat", *interval_columns(shifts, known, known))

    return run
