"""Exponential smoothing of one series: errors, trends and seasons, additive or multiplicative.

A form is three letters: error (A, M), trend (N, A, D for a damped one) and season (N, A, M). Both
kinds of error lead to the same recursion and differ in their likelihood. Level and slope start
from fitted numbers, the season from the mean deviations of the first years.
"""

from __future__ import annotations

import math

import numpy as np

from tsforge.functions.arima import corrected
from tsforge.functions.optimise import minimise

DAMPING = (0.8, 0.98)


def forms(wanted: str = "ZZZ") -> list[str]:
    """The admissible forms that fit: Z is any, trend A is damped or not; a multiplicative season
    needs a multiplicative error, without which its variance has no bound."""
    error, trend, season = wanted
    every = [e + t + s for e in "AM" for t in "NAD" for s in "NAM" if e == "M" or s != "M"]
    return [f for f in every if error in (f[0], "Z") and (trend in (f[1], "Z") or (trend == "A" and f[1] == "D")) and season in (f[2], "Z")]


def starting_season(y: np.ndarray, m: int, kind: str) -> np.ndarray:
    """Of the first ten years: deviations from (or quotients by) the centred mean, by place."""
    if kind == "N":
        return np.zeros(1)
    part = y[: min(len(y), 10 * m + m)]
    kernel = np.full(m, 1 / m) if m % 2 else np.r_[0.5, np.ones(m - 1), 0.5] / m
    if len(part) >= 2 * m + 1:
        trend, first = np.convolve(part, kernel, "valid"), (len(kernel) - 1) // 2
    else:
        trend, first = np.full(len(part), part.mean()), 0
    body = part[first : first + len(trend)]
    flat = body - trend if kind == "A" else body / np.where(np.abs(trend) > 1e-12, trend, 1e-12)
    place = (np.arange(len(body)) + first) % m
    neutral = 0.0 if kind == "A" else 1.0
    shape = np.array([flat[place == k].mean() if (place == k).any() else neutral for k in range(m)])
    return shape - shape.mean() if kind == "A" else np.maximum(shape / shape.mean(), 0.01)


def run(y: list[float], form: str, weights: tuple[float, float, float, float], level: float, slope: float, season: list[float]) -> tuple[list[float], list[float], float, float, list[float]]:
    """(errors, expectations, level, slope, season) at the end; ``season`` starts with the place of the first row."""
    alpha, beta, gamma, phi = weights
    s, kind, m = list(season), form[2], len(season)
    out, means = [], []
    for t, v in enumerate(y):
        base = level + phi * slope
        if kind == "N":
            mean = base
        else:
            now = s[t % m]
            mean = base + now if kind == "A" else base * now
        e = v - mean
        out.append(e)
        means.append(mean)
        if kind == "M":
            step = e / now if now else 0.0
            s[t % m] = now + (gamma * e / base if base else 0.0)
        else:
            step = e
            if kind == "A":
                s[t % m] = now + gamma * e
        level, slope = base + alpha * step, phi * slope + beta * step
    turn = len(y) % m
    return out, means, level, slope, s[turn:] + s[:turn]


def weights_of(x: np.ndarray, form: str) -> tuple[float, float, float, float]:
    """Within their bounds: the slope's below the level's, the season's below what the level leaves."""
    squash = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    alpha = 1e-4 + 0.9998 * squash[0]
    rest = iter(squash[1:])
    beta = alpha * next(rest) if form[1] != "N" else 0.0
    gamma = (1 - alpha) * next(rest) if form[2] != "N" else 0.0
    phi = DAMPING[0] + (DAMPING[1] - DAMPING[0]) * next(rest) if form[1] == "D" else float(form[1] != "N")
    return float(alpha), float(beta), float(gamma), float(phi)


def n_weights(form: str) -> int:
    return 1 + (form[1] != "N") + (form[2] != "N") + (form[1] == "D")


def starts(y: np.ndarray, form: str, m: int) -> tuple[float, float, list[float]]:
    season = starting_season(y, m, form[2])
    head = min(len(y), max(10, 2 * m))
    place = np.arange(head) % len(season)
    flat = y[:head] - season[place] if form[2] != "M" else y[:head] / season[place]
    slope, level = np.polyfit(np.arange(1, head + 1), flat, 1) if form[1] != "N" else (0.0, flat.mean())
    return float(level), float(slope), season.tolist()


def likelihood(out: list[float], means: list[float], form: str) -> float:
    """Twice the negative log likelihood with the best variance, without its constant."""
    e = np.array(out)
    n, logs = len(e), 0.0
    if form[0] == "M":
        mean = np.array(means)
        if (mean <= 1e-10).any():
            return math.inf
        e, logs = e / mean, 2 * np.log(mean).sum()
    total = float(e @ e)
    return n * math.log(max(total, 1e-300)) + logs if math.isfinite(total) else math.inf


def fit(y: np.ndarray, form: str, m: int) -> tuple[float, np.ndarray]:
    """(criterion, [weights in their free form, level, slope]); infinite where the form doesn't suit the series."""
    seasonal = form[2] != "N"
    k = n_weights(form) + 1 + (form[1] != "N") + (m - 1 if seasonal else 0) + 1
    if ("M" in form and (y <= 0).any()) or (seasonal and (m < 2 or len(y) < 2 * m)) or len(y) < k + 2:
        return math.inf, np.empty(0)
    level, slope, season = starts(y, form, m)
    values, spread, n = y.tolist(), float(y.std()) or 1.0, n_weights(form)

    def parts(x: np.ndarray) -> tuple:
        return weights_of(x[:n], form), level + x[n] * spread, slope + (x[n + 1] * spread / len(y) if form[1] != "N" else 0.0), season

    def loss(x: np.ndarray) -> float:
        out, means, *_ = run(values, form, *parts(x))
        return likelihood(out, means, form) / len(y)

    # The likelihood may have several peaks along the level's weight.
    places = [np.r_[first, [other] * (n - 1), 0.0, [0.0] * (form[1] != "N")] for first in (-4.0, -1.5, 0.5, 2.5) for other in (-3.0, 0.0)[: 1 + (n > 1)]]
    ways = [minimise(loss, x, rounds=40, tolerance=1e-7) for x in sorted(places, key=loss)[:2]]
    x, value = min(ways, key=lambda w: w[1])
    weights, level, slope, _ = parts(x)
    return corrected(-value * len(y) / 2, k, len(y)), np.r_[weights, level, slope]


def end_state(y: np.ndarray, form: str, m: int, found: np.ndarray) -> np.ndarray:
    """[damping, level, slope, season from the next row on] behind the last row."""
    *_, season = starts(y, form, m)
    _, _, level, slope, season = run(y.tolist(), form, tuple(found[:4]), float(found[4]), float(found[5]), season)
    return np.r_[found[3], level, slope, season]


def forecast(state: np.ndarray, form: str, h: int) -> np.ndarray:
    phi, level, slope, *season = state
    steps = np.arange(1, h + 1)
    base = level + slope * np.cumsum(phi**steps)
    shape = np.array(season)[(steps - 1) % len(season)]
    return base if form[2] == "N" else base + shape if form[2] == "A" else base * shape
