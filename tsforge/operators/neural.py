"""Networks trained on all series: samples from one window pass, gradients summed in Spark.

Samples (arrays of a context, and of the steps behind it) are made by one window over each series and
written once. A training step takes the samples of one mini-batch, chosen by hashes of their keys;
every task adds up the gradients of its own, Spark adds the tasks' sums place by place, and the
driver, which holds nothing but the parameters, makes the step. The number of parameters is set by
the network's widths, whatever the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tsforge.functions.networks import Adam, Autoencoder, Network, QuantileForecaster
from tsforge.operators.adaptive import _at_least
from tsforge.operators.detectors import bridged, pool_severity, tails
from tsforge.panel import Panel, at_seconds, by_series, missing, seconds
from tsforge.spec import LeakError, quantile_column


def scalers(rows: DataFrame, value: str = "y") -> DataFrame:
    """unique_id, mean and spread (never zero) of the known values of each series."""
    v = missing(value)
    spread = F.when(F.stddev_pop(v) > 1e-8, F.stddev_pop(v)).otherwise(F.when(F.count(v) > 0, 1e-8).otherwise(1.0))
    return rows.groupBy("unique_id").agg(F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), spread.alias("spread"))


def scaled(rows: DataFrame, scale: DataFrame, value: str = "y") -> DataFrame:
    """unique_id, ds, v: values less their series' mean, in its spreads; as they are where a series
    has no scale. Extra columns stay."""
    rest = [c for c in rows.columns if c not in ("unique_id", "ds", value)]
    joined = rows.join(scale, "unique_id", "left")
    v = (missing(value) - F.coalesce("mean", F.lit(0.0))) / F.coalesce("spread", F.lit(1.0))
    return joined.select("unique_id", "ds", v.alias("v"), *rest)


def samples(rows: DataFrame, *, context: int, horizon: int) -> DataFrame:
    """unique_id, ds (the last row of the context), x and y (the ``horizon`` rows behind it; none, if
    that is 0) of every place where all of them are known."""
    x = F.collect_list("v").over(by_series().rowsBetween(-(context - 1), 0))
    y = F.collect_list("v").over(by_series().rowsBetween(1, horizon)) if horizon else F.array().cast("array<double>")
    made = rows.select("unique_id", "ds", x.alias("x"), y.alias("y"))
    return made.where((F.size("x") == context) & (F.size("y") == horizon))


@dataclass(frozen=True)
class Training:
    epochs: int = 8
    batches: int = 4
    rate: float = 0.01
    seed: int = 0


def batch_gradient(batch: DataFrame, net: Network, flat: np.ndarray) -> tuple[float, np.ndarray, int]:
    """(loss, gradient, samples), summed over the batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, slope, n = 0.0, np.zeros(len(flat)), 0
        for df in frames:
            for start in range(0, len(df), 512):
                part = df.iloc[start : start + 512]
                one, more = net.gradient(flat, np.array(part["x"].tolist(), float), np.array(part["y"].tolist(), float))
                loss, slope, n = loss + one, slope + more, n + len(part)
        if n:
            yield pd.DataFrame({"sums": [np.r_[slope, loss, n]]})

    sums = batch.select("x", "y").mapInPandas(run, "sums array<double>").select(F.posexplode("sums").alias("place", "s"))
    found = sums.groupBy("place").agg(F.sum("s").alias("s")).collect()  # a row for each parameter
    out = np.zeros(len(flat) + 2)
    for r in found:
        out[r["place"]] = r["s"]
    return float(out[-2]), out[:-2], int(out[-1])


def trained(written: DataFrame, net: Network, how: Training) -> tuple[np.ndarray, list[float]]:
    """(parameters, mean loss of each epoch). ``written`` are samples that are read, not made anew."""
    flat, adam, losses = net.start(how.seed), Adam(net.size(), how.rate), []
    for epoch in range(how.epochs):
        of = F.pmod(F.xxhash64("unique_id", "ds", F.lit(how.seed), F.lit(epoch)), F.lit(how.batches))
        loss = n = 0
        for b in range(how.batches):
            one, slope, count = batch_gradient(written.where(of == b), net, flat)
            if count:
                flat = adam.step(flat, slope / count)
                loss, n = loss + one, n + count
        if not n:
            raise ValueError("there is no sample to train on")
        losses.append(loss / n)
    return flat, losses


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A forecaster


def lstm_forecaster(folder: str, *, context: int, horizon: int, quantiles: Sequence[float], hidden: int = 16, how: Training = Training()):
    """For ``run_forecasters``: one network for all series, trained on the slice up to the cutoff.
    Forecasts and quantiles come from the last ``context`` rows of a series, with gaps filled by the
    value before them; a series without so many has none. ``horizon`` counts from the cutoff, a gap
    included. The point forecast is the median, for which 0.5 must be among ``quantiles``."""
    if 0.5 not in quantiles:
        raise ValueError("the median is the forecast")
    net = QuantileForecaster(horizon, tuple(quantiles), hidden=hidden)

    def run(train: Panel, window: Row, ahead: DataFrame) -> DataFrame:
        back = by_series().rowsBetween(Window.unboundedPreceding, 0)
        target, step = train.spec.target, train.spec.step
        known = train.df.select("unique_id", "ds", F.last(missing(target), True).over(back).alias("y"))
        scale = scalers(known)
        values = scaled(known, scale)
        flat, _ = trained(_written(samples(values, context=context, horizon=horizon), folder), net, how)

        def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                if len(df):
                    made = net.apply(flat, np.array(df["x"].tolist(), float)) * df["spread"].to_numpy()[:, None, None] + df["mean"].to_numpy()[:, None, None]
                    yield pd.DataFrame({"unique_id": df["unique_id"], "made": made.reshape(len(df), -1).tolist()})

        last = samples(values, context=context, horizon=0).where(F.col("ds") == F.lit(window["cutoff"]).cast("timestamp_ntz")).join(scale, "unique_id")
        wide = last.select("unique_id", "x", "mean", "spread").mapInPandas(predict, "unique_id string, made array<double>")
        n = len(net.quantiles)
        steps = wide.select("unique_id", "made", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))).alias("k"))
        q = [F.element_at("made", F.col("k") * n + j + 1) for j in range(n)]
        ds = at_seconds(seconds(F.lit(window["cutoff"]).cast("timestamp_ntz")) + (F.col("k") + 1) * step)
        rows = steps.select("unique_id", ds.alias("ds"), q[net.quantiles.index(0.5)].alias("y_hat"), *(c.alias(quantile_column(v)) for c, v in zip(q, net.quantiles, strict=True)))
        return rows.where(F.col("ds") >= F.lit(window["first_pred"]).cast("timestamp_ntz"))

    return run


# A detector


@dataclass(frozen=True)
class FittedAutoencoder:
    net: Autoencoder
    flat: np.ndarray
    losses: list[float]
    scale: DataFrame
    pool: DataFrame
    calib_n: int
    tail: DataFrame
    cutoff: object
    length: int
    alpha: float

    def score(self, rows: DataFrame) -> DataFrame:
        """unique_id, ds, score, scorable, severity, calib_n, side of a later frame (unique_id, ds, y).
        Its first windows reach back into the end of the frame that was fitted."""
        first = rows.agg(F.min("ds")).first()[0]
        if first is not None and first <= self.cutoff:
            raise LeakError("the frame begins before the end of what was fitted")
        values = scaled(bridged(rows.select("unique_id", "ds", "y"), self.tail), self.scale)
        own = values.where("not borrowed").select("unique_id", "ds")
        errors = reconstructed(samples(values, context=self.length, horizon=0), self.net, self.flat).join(own, ["unique_id", "ds"])
        asked = errors.select("unique_id", "ds", "side", F.col("error").alias("residual"))
        told = pool_severity(asked, self.pool, value="residual", alpha=self.alpha)
        ranked = _at_least(self.pool, asked.select("residual").distinct(), ()).select("residual", "ge")
        told = told.join(ranked, "residual")
        score = -F.log10((1 + F.col("ge")) / F.lit(self.calib_n + 1.0))
        out = own.join(told.select("unique_id", "ds", score.alias("score"), "severity", "side"), ["unique_id", "ds"], "left")
        known = F.col("score").isNotNull()
        return out.select("unique_id", "ds", "score", known.alias("scorable"), "severity", F.when(known, self.calib_n).otherwise(0).alias("calib_n"), F.coalesce("side", F.lit(0).cast("byte")).alias("side"))


def reconstructed(windows: DataFrame, net: Autoencoder, flat: np.ndarray) -> DataFrame:
    """unique_id, ds, error (mean square over the window) and side (of the last step's deviation)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for start in range(0, len(df), 512):
                part = df.iloc[start : start + 512]
                x = np.array(part["x"].tolist(), float)
                off = x - net.apply(flat, x)
                yield pd.DataFrame({"unique_id": part["unique_id"], "ds": part["ds"], "error": (off**2).mean(axis=1), "side": np.sign(off[:, -1]).astype(np.int8)})

    return windows.select("unique_id", "ds", "x").mapInPandas(run, "unique_id string, ds timestamp_ntz, error double, side byte")


def trimmed(windows: DataFrame, *, trim_z: float) -> DataFrame:
    """The windows without a point further than ``trim_z`` robust spreads from the median of all
    windows' points. Medians are approximate, to a hundred-thousandth of the ranks, so that no task
    holds all values."""
    points = windows.select(F.explode("x").alias("p"))
    middle = points.agg(F.percentile_approx("p", 0.5, 100_000)).first()[0]
    if middle is None:
        return windows
    spread = 1.4826 * points.agg(F.percentile_approx(F.abs(F.col("p") - middle), 0.5, 100_000)).first()[0]
    return windows.where(F.forall("x", lambda p: F.abs(p - middle) <= trim_z * max(spread, 1e-8)))


def fit_autoencoder(rows: DataFrame, folder: str, *, length: int = 24, net: Autoencoder = Autoencoder(), how: Training = Training(), calib_fraction: float = 0.3, trim_z: float = 5.0, alpha: float = 0.05) -> FittedAutoencoder:
    """Of a frame (unique_id, ds, y). Times are split in order: windows of the earlier ones, without
    what isn't normal, train the network, those of the later ones (whole windows that end there)
    are the pool of its errors. ``folder`` is one that all executors share."""
    if not 0 < calib_fraction < 1:
        raise ValueError("the calibration takes a part of the times")
    n = rows.select("ds").distinct().count()
    order = Window.partitionBy("day").orderBy("ds")
    times = rows.select("ds").distinct().withColumn("day", F.to_date("ds"))
    at = max(1, min(round(n * (1 - calib_fraction)), n - 1))
    days = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = times.groupBy("day").count().select("day", F.coalesce(F.sum("count").over(days), F.lit(0)).alias("before"))  # a row a day
    numbered = times.withColumn("k", F.row_number().over(order)).join(before, "day")
    split = numbered.where(F.col("k") + F.col("before") == at).agg(F.max("ds")).first()[0]
    earlier = F.col("ds") <= F.lit(split).cast("timestamp_ntz")
    scale = _written(scalers(rows.where(earlier)), folder)
    values = scaled(rows.select("unique_id", "ds", "y"), scale)
    windows = _written(samples(values, context=length, horizon=0), folder)
    flat, losses = trained(_written(trimmed(windows.where(earlier), trim_z=trim_z), folder), net, how)
    pool = _written(reconstructed(windows.where(~earlier), net, flat).select(F.col("error").alias("value"), F.col("error").alias("residual")), folder)
    return FittedAutoencoder(net, flat, losses, scale, pool.select("residual", "value"), pool.count(), _written(tails(rows.select("unique_id", "ds", "y"), length - 1), folder), rows.agg(F.max("ds")).first()[0], length, alpha)
