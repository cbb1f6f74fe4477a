"""Forecast metrics as expressions: one groupBy computes a whole family, over what is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.panel import by_series, Panel, missing
from tsforge.spec import QUANTILES, interval_levels, quantile_column


def _error() -> Column:
    return missing("y") - missing("y_hat")


def mae() -> Column:
    return F.avg(F.abs(_error()))


def rmse() -> Column:
    return F.sqrt(F.avg(_error() * _error()))


def mape() -> Column:
    return 100 * F.avg(F.when(missing("y") != 0, F.abs(_error()) / F.abs(missing("y"))))


def smape() -> Column:
    total = F.abs(missing("y")) + F.abs(missing("y_hat"))
    return F.avg(F.when(total > 0, 200 * F.abs(_error()) / total).otherwise(total * 0))


def mase(scale: str = "mase_denominator") -> Column:
    return F.avg(F.when(missing(scale) > 0, F.abs(_error()) / missing(scale)))


def pinball(q: float) -> Column:
    d = missing("y") - missing(quantile_column(q))
    return F.greatest(q * d, (q - 1) * d)


def point_metrics() -> list[Column]:
    return [
        F.count(_error()).alias("n_obs"), mae().alias("mae"), rmse().alias("rmse"), mape().alias("mape"), smape().alias("smape"), mase().alias("mase"),
        F.avg(F.when(_error().isNotNull(), missing("mase_denominator"))).alias("mase_denominator"),
    ]


def probabilistic_metrics(quantiles: Sequence[float] = QUANTILES) -> list[Column]:
    """Over the rows where the target and every quantile are known."""
    valid = missing("y").isNotNull()
    for q in quantiles:
        valid = valid & missing(quantile_column(q)).isNotNull()

    def mean(c: Column) -> Column:
        return F.avg(F.when(valid, c))

    losses = [pinball(q) for q in quantiles]
    total, area = losses[0], F.lit(0.0)
    for c in losses[1:]:
        total = total + c
    for a, b, x, y in zip(quantiles, quantiles[1:], losses, losses[1:], strict=False):
        area = area + (b - a) / 2 * (x + y)
    out = [F.count_if(valid).alias("n_obs_prob"), *(mean(c).alias(f"pinball_{quantile_column(q)}") for q, c in zip(quantiles, losses, strict=True))]
    out += [mean(total / len(losses)).alias("pinball_mean"), (2 * mean(area)).alias("crps")]
    for level, low, high in interval_levels(quantiles):
        lo, hi = missing(quantile_column(low)), missing(quantile_column(high))
        out += [mean(missing("y").between(lo, hi).cast("double")).alias(f"coverage_{level}"), mean(hi - lo).alias(f"width_{level}")]
    return out


def mase_denominators(panel: Panel, windows: DataFrame, *, season: int | None = None) -> DataFrame:
    """(unique_id, window_id, mase_denominator): the training slice's mean seasonal difference,
    null where there is none or it is zero."""
    m = season or panel.spec.mase_season
    y = missing(panel.spec.target)
    rows = panel.df.select("unique_id", "ds", F.abs(y - F.lag(y, m).over(by_series())).alias("d"), F.lag("ds", m).over(by_series()).alias("from"))
    inside = (F.col("ds") <= F.col("cutoff")) & (F.col("from") >= F.col("train_start"))
    found = rows.join(F.broadcast(windows), inside).groupBy("unique_id", "window_id").agg(F.nullif(F.avg("d"), F.lit(0.0)).alias("mase_denominator"))
    every = panel.ids().crossJoin(F.broadcast(windows.select("window_id")))
    return every.join(found, ["unique_id", "window_id"], "left")


def scored(forecasts: DataFrame, denominators: DataFrame) -> DataFrame:
    return forecasts.join(denominators, ["unique_id", "window_id"], "left")


def leaderboard(rows: DataFrame, *, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Per model and series, and per model over all rows (unique_id null): never a mean of means."""
    table = rows.groupingSets([["model_id", "unique_id"], ["model_id"]], "model_id", "unique_id")
    return table.agg(F.grouping("unique_id").cast("boolean").alias("overall"), *point_metrics(), *probabilistic_metrics(quantiles))


def by_step(rows: DataFrame) -> DataFrame:
    return rows.groupBy("model_id", "h_step").agg(*point_metrics())


def of_stage(forecasts: DataFrame, windows: DataFrame, stage: str | None) -> DataFrame:
    return forecasts if stage is None else forecasts.join(F.broadcast(windows.where(F.col("stage") == stage)), "window_id", "left_semi")
