"""Leak-safe window features. All of a frame's windows share one partitioning and one sort."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.functions import calendar
from tsforge.panel import by_series, Panel
from tsforge.spec import FeatureSpec, LeakError, usable_features

STATS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "median": lambda c: F.percentile(c, F.lit(0.5)),
}


@dataclass(frozen=True)
class Feature:
    """An expression over a panel's rows; ``along`` is a recursion over each series' values of it."""

    column: Column
    spec: FeatureSpec
    along: Callable[[pd.Series], pd.Series] | None = None


def source(panel: Panel, name: str) -> Feature:
    return Feature(F.col(name).cast("double"), FeatureSpec(name, panel.spec.max_lead(name)))


def lag(x: Feature, k: int) -> Feature:
    return Feature(F.lag(x.column, k).over(by_series()), x.spec.lagged(k, f"{x.spec.name}_lag{k}"))


def lead(x: Feature, k: int) -> Feature:
    return Feature(F.lead(x.column, k).over(by_series()), x.spec.led(k, f"{x.spec.name}_lead{k}"))


def diff(x: Feature, k: int = 1) -> Feature:
    """Uses the row itself, so it is known no further ahead than its source (not ``k`` rows
    further, as a lag of ``k`` rows would be)."""
    return Feature(x.column - F.lag(x.column, k).over(by_series()), FeatureSpec(f"{x.spec.name}_diff{k}", x.spec.max_lead))


def pct_change(x: Feature, k: int, *, shift: int = 1) -> Feature:
    now, before = F.lag(x.column, shift).over(by_series()), F.lag(x.column, shift + k).over(by_series())
    return Feature(F.when(before != 0, now / before - 1), x.spec.lagged(shift, f"{x.spec.name}_pct{k}_s{shift}"))


def roll(x: Feature, window: int, *, shift: int = 1, stat: str = "mean") -> Feature:
    """Over the ``window`` rows that end ``shift`` rows back; null unless all are known."""
    if shift < 1:
        raise LeakError("a rolling window ends one row back at least")
    frame = by_series().rowsBetween(-(shift + window - 1), -shift)
    value = F.when(F.count(x.column).over(frame) == window, STATS[stat](x.column).over(frame))
    return Feature(value, x.spec.lagged(shift, f"{x.spec.name}_roll{stat}{window}_s{shift}"))


def expand(x: Feature, *, shift: int = 1, stat: str = "mean") -> Feature:
    from pyspark.sql import Window

    frame = by_series().rowsBetween(Window.unboundedPreceding, -shift)
    return Feature(STATS[stat](x.column).over(frame), x.spec.lagged(shift, f"{x.spec.name}_expand{stat}_s{shift}"))


def ewm(x: Feature, *, halflife: float, shift: int = 1) -> Feature:
    """The mean of all known rows that lie ``shift`` rows back and more, with weights that halve
    every ``halflife`` rows by position. The recursion runs along each whole series, one series a
    task, however long it is or its gaps are."""

    def along(values: pd.Series) -> pd.Series:
        return values.shift(shift).ewm(halflife=halflife).mean()

    return Feature(x.column, x.spec.lagged(shift, f"{x.spec.name}_ewm{halflife:g}_s{shift}"), along)


def feature_frame(panel: Panel, features: list[Feature]) -> DataFrame:
    names = [f.spec.name for f in features]
    if len(set(names)) < len(names):
        raise ValueError("two features have one name")
    frame = panel.df.select("unique_id", "ds", *(f.column.alias(f.spec.name) for f in features))
    recursions = {f.spec.name: f.along for f in features if f.along}
    if not recursions:
        return frame

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        return rows.assign(**{name: along(rows[name]) for name, along in recursions.items()})

    made = frame.groupBy("unique_id").applyInPandas(run, frame.schema)
    # Pandas has no null beside nan.
    return made.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if c in recursions else F.col(c) for c in made.columns))


# Sets of features


def calendar_features(panel: Panel, *, holidays: DataFrame | None = None, periods: tuple[float, ...] = (24, 168, 8766), order: int = 2) -> tuple[DataFrame, list[FeatureSpec]]:
    """Calendar columns and Fourier terms of ``periods`` hours; all are known at any lead."""
    terms = calendar.fourier_columns(periods={f"{p:g}h": float(p) for p in periods}, order=order)
    frame = panel.df.select("unique_id", "ds", *calendar.calendar_columns(tz=panel.spec.tz_display), *terms)
    if holidays is not None:
        frame = calendar.with_holidays(frame, holidays, tz=panel.spec.tz_display)
    return frame, [FeatureSpec(c, math.inf) for c in frame.columns if c not in ("unique_id", "ds")]


def thermal_features(panel: Panel, *, column: str = "temp_c", heating: float = 18.0, cooling: float = 18.0, lags: tuple[int, ...] = (1, 24, 168)) -> list[Feature]:
    """The temperature, its heating and cooling degrees, and lags of each; a null temperature has
    null degrees."""
    warm = source(panel, column)
    degrees = calendar.degree_days(column, heating=heating, cooling=cooling)
    names = (f"{column}_hdd{heating:g}", f"{column}_cdd{cooling:g}")
    base = [warm, *(Feature(c, FeatureSpec(n, warm.spec.max_lead)) for n, c in zip(names, degrees, strict=True))]
    return base + [lag(x, k) for x in base for k in lags]


def feature_set(panel: Panel, lead: int, *, temperature: str | None = None, recursive: bool = False) -> DataFrame:
    """The target's and, with a temperature column, the thermal features that are usable ``lead``
    steps ahead, with the calendar's."""
    made = target_features(panel) + (thermal_features(panel, column=temperature) if temperature else [])
    usable = {f.name for f in usable_features([x.spec for x in made], lead, recursive=recursive)}
    frame, _ = calendar_features(panel)
    return feature_frame(panel, [x for x in made if x.spec.name in usable]).join(frame, ["unique_id", "ds"])


def target_features(panel: Panel, *, lags=(1, 2, 3, 24, 48, 168, 336), windows=(24, 168), stats=("mean", "std", "min", "max"), diffs=(1, 24), changes=(24, 168)) -> list[Feature]:
    y = source(panel, panel.spec.target)
    out = [lag(y, k) for k in lags] + [roll(y, w, stat=s) for w in windows for s in stats]
    return out + [lag(diff(y, k), 1) for k in diffs] + [pct_change(y, k) for k in changes]
