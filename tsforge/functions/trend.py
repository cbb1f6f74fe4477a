"""A piecewise linear trend with sparse changes of slope, seasons as waves, and regressors.

y = m + k t + sum d_j (t - s_j)+ + waves and regressors + noise, with t and y scaled to the slice.
Changes of slope have a penalty on their size (most are zero), the other coefficients but level and
slope one on their square. The fit is the posterior's peak: what has no absolute penalty is solved
out, the changes are found by coordinate descent on what is left, and the noise is estimated in turn.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

DAY = 86400.0


@dataclass(frozen=True)
class Shape:
    """``seasons``: (period in days, number of waves). ``change_scale`` and ``season_scale`` are the
    scales of the penalties: the larger, the freer; ``change_range`` is the part of the slice that
    may change its slope."""

    seasons: tuple[tuple[float, int], ...] = ((1.0, 4), (7.0, 3), (365.25, 10))
    changes: int = 25
    change_range: float = 0.8
    change_scale: float = 0.05
    season_scale: float = 10.0

    def waves(self, seconds: np.ndarray) -> np.ndarray:
        turns = [2 * np.pi * k * seconds / DAY / period for period, n in self.seasons for k in range(1, n + 1)]
        return np.column_stack([f(x) for x in turns for f in (np.sin, np.cos)]) if turns else np.empty((len(seconds), 0))


def soft(x: float, least: float) -> float:
    return np.sign(x) * max(abs(x) - least, 0.0)


def sparse_changes(gram: np.ndarray, toward: np.ndarray, penalty: float, start: np.ndarray, *, sweeps: int = 2000, tolerance: float = 1e-9) -> np.ndarray:
    """The least of d'Gd / 2 - toward'd + penalty * |d|, one coordinate after the other."""
    d = start.copy()
    left = toward - gram @ d
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(d)):
            if gram[j, j] <= 0:
                continue
            new = soft(left[j] + gram[j, j] * d[j], penalty) / gram[j, j]
            if new != d[j]:
                left -= gram[:, j] * (new - d[j])
                most, d[j] = max(most, abs(new - d[j]) * np.sqrt(gram[j, j])), new
        if most <= tolerance:
            break
    return d


@dataclass(frozen=True)
class Fit:
    """The fitted state; ``numbers`` and ``of`` turn it into one row of numbers and back."""

    start: float
    span: float
    scale: float
    noise: float
    base: np.ndarray  # level, slope, then waves and regressors
    changes: np.ndarray
    places: np.ndarray
    centres: np.ndarray  # mean and spread of each regressor

    def numbers(self) -> list[float]:
        head = [self.start, self.span, self.scale, self.noise, len(self.base), len(self.changes), len(self.centres)]
        return [*map(float, head), *self.base.tolist(), *self.changes.tolist(), *self.places.tolist(), *self.centres.reshape(-1).tolist()]

    @staticmethod
    def of(numbers: Sequence[float]) -> Fit:
        x = np.asarray(numbers, float)
        n, c, r = (int(v) for v in x[4:7])
        base, changes, places, centres = np.split(x[7:], np.cumsum([n, c, c]))
        return Fit(*map(float, x[:4]), base, changes, places, centres.reshape(r, 2))

    def trend(self, t: np.ndarray) -> np.ndarray:
        return self.base[0] + self.base[1] * t + np.maximum(0, t[:, None] - self.places) @ self.changes

    def rest(self, shape: Shape, seconds: np.ndarray, regressors: np.ndarray) -> np.ndarray:
        scaled = (regressors - self.centres[:, 0]) / self.centres[:, 1] if len(self.centres) else regressors
        return np.column_stack([shape.waves(seconds), scaled]) @ self.base[2:]

    def predict(self, shape: Shape, seconds: np.ndarray, regressors: np.ndarray) -> np.ndarray:
        t = (seconds - self.start) / self.span
        return self.scale * (self.trend(t) + self.rest(shape, seconds, regressors))

    def samples(self, shape: Shape, seconds: np.ndarray, regressors: np.ndarray, *, n: int, rng: np.random.Generator) -> np.ndarray:
        """Paths (a row each): behind the slice slopes go on changing as often as the candidates lie
        there, by sizes drawn like the fitted ones', and every step has noise."""
        t = (seconds - self.start) / self.span
        trend, ahead = self.trend(t), max(0.0, float(t.max()) - 1.0)
        size = float(np.abs(self.changes).mean()) if len(self.changes) else 0.0
        out = np.empty((n, len(t)))
        for k in range(n):
            count = rng.poisson(len(self.changes) * ahead) if size > 0 and ahead > 0 else 0
            at = 1.0 + ahead * rng.random(count)
            out[k] = trend + np.maximum(0, t[:, None] - at) @ rng.laplace(0.0, size, count)
        noise = rng.normal(0.0, self.noise, out.shape)
        return self.scale * (out + self.rest(shape, seconds, regressors) + noise)


def fit(seconds: np.ndarray, y: np.ndarray, regressors: np.ndarray, shape: Shape, *, rounds: int = 5) -> Fit:
    """Of the rows with a value; ``regressors`` has a column each."""
    known = np.isfinite(y) & np.isfinite(regressors).all(axis=1)
    seconds, y, regressors = seconds[known], y[known], regressors[known]
    start, span, scale = float(seconds[0]), float(max(seconds[-1] - seconds[0], 1.0)), float(np.abs(y).max()) or 1.0
    t, target = (seconds - start) / span, y / scale
    # A column of two values (a flag) stays as it is, as one that doesn't move does.
    flags = np.array([len(np.unique(c)) <= 2 for c in regressors.T], bool)
    spread = np.array([1.0 if f else c.std() or 1.0 for f, c in zip(flags, regressors.T, strict=True)])
    centres = np.column_stack([np.where(flags, 0.0, regressors.mean(axis=0) if len(y) else 0.0), spread]).reshape(-1, 2)
    scaled = (regressors - centres[:, 0]) / centres[:, 1] if len(centres) else regressors
    base = np.column_stack([np.ones(len(t)), t, shape.waves(seconds), scaled])
    n_changes = min(shape.changes, max(0, int(len(t) * shape.change_range) - 1))
    places = t[np.linspace(0, int(len(t) * shape.change_range) - 1, n_changes + 1).round().astype(int)][1:] if n_changes else np.empty(0)
    hinges = np.maximum(0, t[:, None] - places)
    penalty = np.diag([1e-6, 1e-6] + [1.0 / shape.season_scale**2] * (base.shape[1] - 2))
    noise, d, w = max(float(target.std()), 1e-6), np.zeros(n_changes), np.zeros(base.shape[1])
    for _ in range(rounds):
        inner = np.linalg.inv(base.T @ base + penalty * noise**2)
        cross = base.T @ hinges
        gram = hinges.T @ hinges - cross.T @ inner @ cross
        toward = hinges.T @ target - cross.T @ (inner @ (base.T @ target))
        d = sparse_changes(gram, toward, noise**2 / shape.change_scale, d)
        w = inner @ (base.T @ (target - hinges @ d))
        before, noise = noise, max(float(np.sqrt(np.mean((target - base @ w - hinges @ d) ** 2))), 1e-6)
        if abs(noise - before) < 1e-4 * before:
            break
    return Fit(start, span, scale, noise, w, d, places, centres)
