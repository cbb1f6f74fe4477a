"""Diagnostics of series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.panel import by_series, missing


def autocorrelation(df: DataFrame, *, max_lag: int = 200, value: str = "y") -> DataFrame:
    """(unique_id, lag, acf) over the rows that are known, by place."""
    known = df.select("unique_id", "ds", missing(value).alias("v")).where("v IS NOT NULL")
    centred = known.withColumn("c", F.col("v") - F.avg("v").over(Window.partitionBy("unique_id")))
    lags = range(1, max_lag + 1)
    moved = centred.select("unique_id", "c", *(F.lag("c", k).over(by_series()).alias(f"c{k}") for k in lags))
    sums = moved.groupBy("unique_id").agg(F.sum(F.col("c") * F.col("c")).alias("v"), *(F.sum(F.col("c") * F.col(f"c{k}")).alias(f"s{k}") for k in lags))
    wide = sums.select("unique_id", *(F.try_divide(f"s{k}", "v").alias(str(k)) for k in lags))
    return wide.unpivot(["unique_id"], [str(k) for k in lags], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def partial_autocorrelation(acf: DataFrame) -> DataFrame:
    """(unique_id, lag, pacf) by the Durbin-Levinson recursion; a group holds one row for each lag."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values("lag")["acf"].to_numpy()
        out, phi = [], np.zeros(0)
        for k in range(len(r)):
            last = (r[k] - phi @ r[:k][::-1]) / (1 - phi @ r[:k]) if k else r[0]
            phi = np.append(phi - last * phi[::-1], last)
            out.append(last)
        return pd.DataFrame({"unique_id": rows["unique_id"].iloc[0], "lag": np.arange(1, len(r) + 1, dtype=np.int32), "pacf": out})

    return acf.groupBy("unique_id").applyInPandas(solve, "unique_id string, lag int, pacf double")


def periodogram(df: DataFrame, *, value: str = "y") -> DataFrame:
    """(unique_id, period, power) of each linearly detrended series. A series is one group: its
    length is that of one regular grid."""

    def spectrum(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("ds")["v"].to_numpy()
        x = np.arange(len(y))
        if len(y) < 4:
            return pd.DataFrame({"unique_id": [], "period": [], "power": []})
        y = y - np.polyval(np.polyfit(x, y, 1), x)
        f, p = np.fft.rfftfreq(len(y))[1:], np.abs(np.fft.rfft(y)[1:]) ** 2 / len(y)
        return pd.DataFrame({"unique_id": rows["unique_id"].iloc[0], "period": 1 / f, "power": p})

    known = df.select("unique_id", "ds", missing(value).alias("v")).where("v IS NOT NULL")
    return known.groupBy("unique_id").applyInPandas(spectrum, "unique_id string, period double, power double")


def loess(y: np.ndarray, span: int, at: np.ndarray | None = None) -> np.ndarray:
    """Local lines through equally spaced values: at each place the ``span`` values nearest to it
    weigh by the cube of one minus the cube of their distance over the farthest one's (places
    may lie outside). A span beyond the series widens the distance in proportion."""
    n = len(y)
    at = np.arange(n, dtype=float) if at is None else np.asarray(at, float)
    q = min(span, n)
    together = max(1, 2_000_000 // q)
    if len(at) > together:
        return np.concatenate([loess(y, span, at[k : k + together]) for k in range(0, len(at), together)])
    first = np.clip(np.rint(at).astype(int) - q // 2, 0, n - q)
    x = first[:, None] + np.arange(q)
    away = np.abs(x - at[:, None])
    far = np.maximum(away.max(axis=1, keepdims=True), 1e-9) * max(1.0, span / n)
    w = np.clip(1 - (away / far) ** 3, 0, None) ** 3
    total = w.sum(axis=1)
    flat = total <= 1e-12
    w[flat], total[flat] = 1.0, q
    mx, my = (w * x).sum(axis=1) / total, (w * y[x]).sum(axis=1) / total
    dx = x - mx[:, None]
    sxx = (w * dx**2).sum(axis=1)
    slope = np.where(sxx > 1e-12, (w * dx * (y[x] - my[:, None])).sum(axis=1) / np.maximum(sxx, 1e-12), 0.0)
    return my + slope * (at - mx)


def _season(y: np.ndarray, period: int, span: int) -> np.ndarray:
    """The season of a detrended series: each place of the period smoothed over its cycles, less
    what a low pass leaves of that."""
    n = len(y)
    wide = np.empty(n + 2 * period)
    for k in range(period):
        cycle = y[k::period]
        wide[k::period] = loess(cycle, span, np.arange(-1, len(cycle) + 1))[: len(wide[k::period])]
    mean = lambda v, m: np.convolve(v, np.ones(m) / m, mode="valid")
    slow = loess(mean(mean(mean(wide, period), period), 3), period + 1 - period % 2)
    return wide[period : period + n] - slow


def mstl(y: np.ndarray, periods: tuple[int, ...], *, rounds: int = 2, inner: int = 2) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Trend and seasons by locally weighted smoothing, the shortest season first; a season needs
    two cycles. Each season is taken again from the rest without it, ``rounds`` times."""
    seasons = {p: np.zeros(len(y)) for p in periods}
    fit = [p for p in sorted(periods) if len(y) >= 2 * p]
    if not fit:
        return loess(y, max(3, len(y))) if len(y) > 2 else y.copy(), seasons
    trend = np.zeros(len(y))
    for _ in range(rounds):
        for i, p in enumerate(fit):
            rest, span = y - sum(s for q, s in seasons.items() if q != p), 7 + 4 * (i + 1)
            trend = np.zeros(len(y))
            for _ in range(inner):
                seasons[p] = _season(rest - trend, p, span)
                length = int(np.ceil(1.5 * p / (1 - 1.5 / span)))
                trend = loess(rest - seasons[p], length + 1 - length % 2)
    return trend, seasons


def lowess_fit(df: DataFrame, *, value: str = "y", share: float = 2 / 3) -> DataFrame:
    """(unique_id, ds, fit): local lines over the known rows of each series, by place."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        y = rows["v"].to_numpy(float)
        return pd.DataFrame({"unique_id": rows["unique_id"], "ds": rows["ds"], "fit": loess(y, max(2, int(share * len(y)))) if len(y) > 2 else y})

    known = df.select("unique_id", "ds", missing(value).alias("v")).where("v IS NOT NULL")
    return known.groupBy("unique_id").applyInPandas(run, "unique_id string, ds timestamp_ntz, fit double")


def decomposition(df: DataFrame, *, periods: tuple[int, ...] = (24, 168), value: str = "y") -> DataFrame:
    """(unique_id, ds, trend, seasonal_<p>..., remainder) of each series, gaps filled linearly. A
    series is one group."""
    names = [f"seasonal_{p}" for p in periods]

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        y = rows["v"].interpolate(limit_direction="both").fillna(0.0).to_numpy(float)
        trend, seasons = mstl(y, periods)
        return pd.DataFrame({"unique_id": rows["unique_id"], "ds": rows["ds"], "trend": trend, **{n: seasons[p] for n, p in zip(names, periods, strict=True)}, "remainder": y - trend - sum(seasons.values())})

    schema = "unique_id string, ds timestamp_ntz, trend double, " + "".join(f"{n} double, " for n in names) + "remainder double"
    return df.select("unique_id", "ds", missing(value).alias("v")).groupBy("unique_id").applyInPandas(split, schema)


def difficulty(parts: DataFrame, *, periods: tuple[int, ...] = (24, 168)) -> DataFrame:
    """The strength of trend and seasons of each series: the share of variance a component adds to
    the remainder's."""
    rest = F.var_samp("remainder")

    def strength(c: str):
        return F.greatest(F.lit(0.0), 1 - F.try_divide(rest, F.var_samp(F.col(c) + F.col("remainder"))))

    return parts.groupBy("unique_id").agg(strength("trend").alias("trend_strength"), *(strength(f"seasonal_{p}").alias(f"strength_{p}") for p in periods))
