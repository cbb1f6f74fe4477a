"""One model of all series that feeds on its own forecasts.

Training rows hold lags, rolling statistics, differences and rates of the target, made by windows
over each series, beside columns of the calendar. To forecast, each series carries the tail of its
last values. Every step the features of all series of a batch are computed from their tails, the
trees predict, and the predictions join the tails; so a step's short lags are forecasts themselves.
The trees go to the tasks as arrays (their number is a parameter), and each task takes its batches
of series through the whole horizon, in one pass.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tsforge.functions.calendar import local
from tsforge.operators import features, trees
from tsforge.panel import Panel, at_seconds, by_series, missing, seconds
from tsforge.sources.shared import stored


@dataclass(frozen=True)
class TargetFeatures:
    """What the model sees of the target; windows, differences and rates end ``shift`` rows back."""

    lags: tuple[int, ...] = (1, 2, 3, 24, 48, 168)
    windows: tuple[int, ...] = (24,)
    stats: tuple[str, ...] = ("mean", "std")
    diffs: tuple[int, ...] = (1, 24)
    rates: tuple[int, ...] = ()
    shift: int = 1

    def __post_init__(self):
        if unknown := set(self.stats) - set(TAIL_STATS):
            raise ValueError(f"unknown statistics {sorted(unknown)}")
        if min([self.shift, *self.lags, *self.windows, *self.diffs, *self.rates]) < 1:
            raise ValueError("lags, windows, differences, rates and the shift are 1 or more")

    @property
    def width(self) -> int:
        """Values that a row needs before it."""
        return max([*self.lags, *(self.shift + w - 1 for w in self.windows), *(self.shift + k for k in (*self.diffs, *self.rates))])

    def columns(self, panel: Panel) -> list[features.Feature]:
        y = features.source(panel, panel.spec.target)
        back = [features.lag(y, k) for k in self.lags]
        rolled = [features.roll(y, w, shift=self.shift, stat=s) for w in self.windows for s in self.stats]
        moved = [features.lag(features.diff(y, k), self.shift) for k in self.diffs]
        return back + rolled + moved + [features.pct_change(y, k, shift=self.shift) for k in self.rates]

    def of_tails(self, tails: np.ndarray) -> np.ndarray:
        """The same columns of the row behind each tail (a row of values, the latest last)."""
        end, s = tails.shape[1], self.shift
        at = lambda k: tails[:, end - k]
        out = [at(k) for k in self.lags] + [TAIL_STATS[stat](tails[:, end - s - w + 1 : end - s + 1]) for w in self.windows for stat in self.stats]
        out += [at(s) - at(s + k) for k in self.diffs]
        with np.errstate(divide="ignore", invalid="ignore"):
            out += [np.where(at(s + k) != 0, at(s) / at(s + k) - 1, np.nan) for k in self.rates]
        return np.column_stack(out)


TAIL_STATS = {
    "mean": lambda x: x.mean(axis=1), "std": lambda x: x.std(axis=1, ddof=1) if x.shape[1] > 1 else np.full(len(x), np.nan),
    "min": lambda x: x.min(axis=1), "max": lambda x: x.max(axis=1), "sum": lambda x: x.sum(axis=1), "median": lambda x: np.median(x, axis=1),
}

#: Calendar columns by their names; booleans count as 0 and 1.
CALENDAR = ("hour", "dayofweek", "month", "is_weekend")


def _calendar(tz: str) -> list:
    at = local("ds", tz)
    day = F.weekday(at)
    return [c.cast("double").alias(n) for n, c in zip(CALENDAR, (F.hour(at), day, F.month(at), day >= 5), strict=True)]


def _carried(panel: Panel) -> Panel:
    """Gaps of the target hold the value before them."""
    back = by_series().rowsBetween(Window.unboundedPreceding, 0)
    target = panel.spec.target
    return Panel(panel.df.withColumn(target, F.last(missing(target), True).over(back)), panel.spec, panel.static)


def design(panel: Panel, config: TargetFeatures) -> tuple[DataFrame, list[str]]:
    """unique_id, ds, label and the model's inputs with their names. Labels are the values as they
    are (rows without one go), inputs see gaps filled; rows whose past is too short go as well."""
    frame = features.feature_frame(_carried(panel), config.columns(panel))
    inputs = [c for c in frame.columns if c not in ("unique_id", "ds")]
    known = panel.df.select("unique_id", "ds", missing(panel.spec.target).alias("label")).where("label is not null")
    rows = frame.na.drop(subset=inputs).join(known, ["unique_id", "ds"])
    return rows.select("unique_id", "ds", "label", *inputs, *_calendar(panel.spec.tz_display)), [*inputs, *CALENDAR]


def fit(panel: Panel, config: TargetFeatures, *, rounds: int = 20, depth: int = 4, seed: int = 1) -> tuple[GBTRegressionModel, DataFrame, list[str]]:
    """(model, the design it was fitted on, names of its inputs). The design is written once, as
    fitting reads it many times."""
    rows, names = design(panel, config)
    rows = stored(rows, "design")
    shaped = VectorAssembler(inputCols=names, outputCol="inputs").transform(rows)
    return GBTRegressor(featuresCol="inputs", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed).fit(shaped), rows, names


def tails(panel: Panel, config: TargetFeatures, cutoff) -> DataFrame:
    """unique_id and its last ``width`` values up to the cutoff; series with fewer are left out."""
    first = F.lit(cutoff).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit((config.width - 1) * panel.spec.step))
    rows = _carried(panel).df.where(F.col("ds").between(first, F.lit(cutoff).cast("timestamp_ntz"))).select("unique_id", "ds", F.col(panel.spec.target).cast("double").alias("v"))
    held = rows.where("v is not null").groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("ds", "v"))).alias("rows"))
    return held.where(F.size("rows") == config.width).select("unique_id", F.transform("rows", lambda r: r["v"]).alias("tail"))


def forecast(panel: Panel, config: TargetFeatures, forest: trees.Forest, cutoff, *, steps: int) -> DataFrame:
    """unique_id, ds, y_hat of the ``steps`` steps behind the cutoff."""
    spark, step = panel.df.sparkSession, panel.spec.step
    at = at_seconds(seconds(F.lit(cutoff).cast("timestamp_ntz")) + (F.col("id") + 1) * step).alias("ds")
    ahead = spark.range(steps).select("id", at).select("id", "ds", *_calendar(panel.spec.tz_display)).orderBy("id").toPandas()  # a row for each step
    known, instants = ahead[list(CALENDAR)].to_numpy(float), ahead["ds"].to_numpy()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if df.empty:
                continue
            values = np.array(df["tail"].tolist(), float)
            for k in range(steps):
                inputs = np.hstack([config.of_tails(values[:, k:]), np.tile(known[k], (len(df), 1))])
                values = np.hstack([values, forest.predict(inputs)[:, None]])
            made = values[:, -steps:]
            yield pd.DataFrame({"unique_id": np.repeat(df["unique_id"].to_numpy(), steps), "ds": np.tile(instants, len(df)), "y_hat": made.reshape(-1)})

    return tails(panel, config, cutoff).mapInPandas(run, "unique_id string, ds timestamp_ntz, y_hat double")


def forecaster(config: TargetFeatures, folder: str, *, rounds: int = 20, depth: int = 4, seed: int = 1):
    """For ``run_forecasters``; models are saved below ``folder`` to read their trees."""

    def run(train: Panel, window: Row, ahead: DataFrame) -> DataFrame:
        model, *_ = fit(train, config, rounds=rounds, depth=depth, seed=seed)
        forest = trees.forest_of(model, f"{folder.rstrip('/')}/{uuid.uuid4().hex}")
        steps = round((window["last_pred"] - window["cutoff"]).total_seconds() / train.spec.step)
        made = forecast(train, config, forest, window["cutoff"], steps=steps)
        return made.where(F.col("ds") >= F.lit(window["first_pred"]).cast("timestamp_ntz"))

    return run
