"""Seasonal ARIMA models of one series: orders of differencing, two likelihoods, forecasts.

A model is (p, q, P, Q, c) beside the orders of differencing (d, D) and the season m. Its
differenced series w has a mean if c is 1, and w - mean is an ARMA process whose polynomials are the
products of a short and a seasonal one. Coefficients come from numbers without bounds: the
hyperbolic tangents of a polynomial's numbers are its partial autocorrelations, so every model is
stationary and invertible.

The conditional likelihood starts from zero errors. The exact one runs a state-space filter until
its variance settles, from where on the errors follow the model's own recursion.
"""

from __future__ import annotations

import math

import numpy as np

from tsforge.functions.optimise import least_squares, minimise

#: Five-percent point of the test of a level; least strength of a season that is differenced.
LEVEL_TEST, SEASON_STRENGTH = 0.463, 0.64
Model = tuple[int, int, int, int, int]


def level_test(y: np.ndarray) -> float:
    """Statistic of the test that y moves about a level: sums of deviations against their long-run variance."""
    n = len(y)
    e = y - y.mean()
    lags = int(4 * (n / 100) ** 0.25)
    variance = (e @ e) / n + sum(2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n for k in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / (n * n * variance)) if variance > 0 else 0.0


def season_strength(y: np.ndarray, m: int) -> float:
    """One less the share of the remainder's variance in that of season and remainder."""
    if m < 2 or len(y) < 2 * m + 1:
        return 0.0
    kernel = np.full(m, 1 / m) if m % 2 else np.r_[0.5, np.ones(m - 1), 0.5] / m
    trend = np.convolve(y, kernel, "valid")
    first = (len(kernel) - 1) // 2
    flat, place = y[first : first + len(trend)] - trend, (np.arange(len(trend)) + first) % m
    shape = np.array([flat[place == k].mean() if (place == k).any() else 0.0 for k in range(m)])
    season = (shape - shape.mean())[place]
    total = flat.var()
    return max(0.0, 1 - (flat - season).var() / total) if total > 0 else 0.0


def differences(y: np.ndarray, m: int, *, max_d: int = 2, max_season: int = 1) -> tuple[int, int]:
    """(d, D): the season is differenced if it is strong, the level until it stays."""
    season = int(max_season > 0 and season_strength(y, m) > SEASON_STRENGTH and len(y) > 3 * m)
    w, d = differenced(y, 0, season, m), 0
    while d < max_d and len(w) > 10 and np.ptp(w) > 0 and level_test(w) > LEVEL_TEST:
        w, d = np.diff(w), d + 1
    return d, season


def differenced(y: np.ndarray, d: int, season: int, m: int) -> np.ndarray:
    for _ in range(season):
        y = y[m:] - y[:-m]
    return np.diff(y, n=d)


def coefficients(free: np.ndarray) -> np.ndarray:
    """Of a stationary autoregression, from its numbers without bounds."""
    out = np.empty(0)
    for partial in np.tanh(free):
        out = np.r_[out - partial * out[::-1], partial]
    return out


def product(short: np.ndarray, seasonal: np.ndarray, m: int) -> np.ndarray:
    """Coefficients c_1, c_2, ... of 1 - c_1 B - ..., the product of both polynomials."""
    wide = np.zeros(m * len(seasonal) + 1)
    wide[0], wide[m::m] = 1.0, -seasonal
    return -np.convolve(np.r_[1.0, -short], wide)[1:]


def polynomials(x: np.ndarray, model: Model, m: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(ar, ma, mean): w_t = sum ar_i w_(t-i) + e_t + sum ma_j e_(t-j), about the mean."""
    p, q, sp, sq, c = model
    parts = np.split(x, np.cumsum([p, q, sp, sq]))
    ar = product(coefficients(parts[0]), coefficients(parts[2]), m)
    ma = -product(coefficients(parts[1]), coefficients(parts[3]), m)
    return ar, ma, float(parts[4][0]) if c else 0.0


def errors(w: np.ndarray, ar: np.ndarray, ma: np.ndarray, known: list[float] | None = None) -> np.ndarray:
    """Errors by the model's recursion, from the first one whose past is there on; ``known`` are
    those before (else they count as zero)."""
    start = len(known) if known is not None else len(ar)
    u = np.convolve(w, np.r_[1.0, -ar])[: len(w)]
    out = list(known) if known is not None else [0.0] * start
    taps = [(k + 1, c) for k, c in enumerate(ma.tolist()) if c]
    if not taps:
        return np.r_[out, u[start:]]
    pad = max(0, len(ma) - start)
    out = [0.0] * pad + out
    for x in u[start:].tolist():
        for lag, c in taps:
            x -= c * out[-lag]
        out.append(x)
    return np.array(out[pad:])


def exact_likelihood(w: np.ndarray, ar: np.ndarray, ma: np.ndarray, *, settled: float = 1e-9) -> tuple[float, float, np.ndarray]:
    """(log likelihood with the best variance, that variance, standardised errors)."""
    r, n = max(len(ar), len(ma) + 1), len(w)
    move = np.zeros((r, r))
    move[: len(ar), 0] = ar
    move[np.arange(r - 1), np.arange(1, r)] = 1.0
    load = np.zeros(r)
    load[0], load[1 : len(ma) + 1] = 1.0, ma
    noise = np.outer(load, load)
    cover, power = noise.copy(), move.copy()
    for _ in range(40):  # the stationary covariance, by doubling
        more = power @ cover @ power.T
        cover, power = cover + more, power @ power
        if np.abs(more).max() <= 1e-13 * np.abs(cover).max():
            break
    state, found, logs = np.zeros(r), [], 0.0
    for t in range(n):
        if cover[0, 0] - 1 < settled and t >= r:
            found += errors(w, ar, ma, found)[t:].tolist()
            break
        spread = cover[0, 0]
        e = w[t] - state[0]
        gain = move @ cover[:, 0] / spread
        state = move @ state + gain * e
        cover = move @ cover @ move.T + noise - spread * np.outer(gain, gain)
        logs += math.log(spread)
        found.append(e / math.sqrt(spread))
    e = np.array(found)
    variance = float(e @ e) / n
    return -0.5 * (n * (math.log(2 * math.pi * max(variance, 1e-300)) + 1) + logs), variance, e


def corrected(loglik: float, k: int, n: int) -> float:
    """The criterion: twice the parameters less twice the likelihood, corrected for few rows."""
    return 2 * k - 2 * loglik + (2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf)


def first_guess(w: np.ndarray, model: Model) -> np.ndarray:
    return np.r_[np.full(sum(model[:4]), 0.1), [w.mean()] * model[4]]


def fit_conditional(y: np.ndarray, model: Model, d: int, season: int, m: int) -> tuple[float, np.ndarray]:
    """(criterion, free numbers) by the conditional sum of squares; infinite where there are too few rows."""
    w = differenced(y, d, season, m)
    k, lost = sum(model) + 1, model[0] + m * model[2]
    if len(w) - lost < k + 2 or (model[4] and d + season > 1):
        return math.inf, np.empty(0)
    scale = w.std() or 1.0

    def residuals(x: np.ndarray) -> np.ndarray:
        ar, ma, mean = polynomials(x, model, m)
        return errors((w - mean) / scale, ar, ma)[lost:]

    x, loss = least_squares(residuals, first_guess(w, model))
    n = len(w)
    variance = max(loss / (n - lost) * scale**2, 1e-300)
    return corrected(-0.5 * n * (math.log(2 * math.pi * variance) + 1), k, n), x


def fit_exact(y: np.ndarray, model: Model, d: int, season: int, m: int, x: np.ndarray) -> tuple[float, np.ndarray]:
    """(criterion, free numbers) of the largest exact likelihood, from ``x`` on."""
    w = differenced(y, d, season, m)
    scale = w.std() or 1.0
    unit = np.r_[np.ones(sum(model[:4])), [scale] * model[4]]

    def loss(z: np.ndarray) -> float:
        if np.abs(z[: sum(model[:4])]).max(initial=0) > 6:  # the polynomial's root is next to the circle
            return math.inf
        ar, ma, mean = polynomials(z * unit, model, m)
        return -exact_likelihood((w - mean) / scale, ar, ma, settled=1e-6)[0] / len(w)

    z, value = minimise(loss, np.clip(x / unit, -3, 3) if sum(model[:4]) else x / unit, rounds=25, tolerance=1e-7)
    return corrected(-(value + math.log(scale)) * len(w), sum(model) + 1, len(w)), z * unit


def end_state(y: np.ndarray, model: Model, d: int, season: int, m: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
    """All that a forecast needs: (ar with the differences, ma, constant, last values, last errors)."""
    ar, ma, mean = polynomials(x, model, m)
    w = differenced(y, d, season, m) - mean
    whole = np.r_[1.0, -ar]
    for _ in range(season):
        whole = np.convolve(whole, np.r_[1.0, np.zeros(m - 1), -1.0])
    for _ in range(d):
        whole = np.convolve(whole, [1.0, -1.0])
    e = exact_likelihood(w, ar, ma)[2] if len(ma) else np.zeros(0)
    return -whole[1:], ma, mean * (1 - ar.sum()), y[len(y) - len(whole) + 1 :], e[len(e) - len(ma) :]


def forecast(state: tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray], h: int) -> np.ndarray:
    ar, ma, constant, values, last = state
    values, known = list(values), list(last) + [0.0] * h
    for k in range(h):
        recent = np.array(values[::-1][: len(ar)])
        values.append(float(constant + ar[: len(recent)] @ recent + sum(c * known[len(ma) + k - 1 - j] for j, c in enumerate(ma))))
    return np.array(values[len(values) - h :])
