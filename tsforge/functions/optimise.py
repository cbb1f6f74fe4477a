"""Two small minimisers for fits inside tasks: sums of squares, and any smooth function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def slopes(f: Callable[[np.ndarray], np.ndarray | float], x: np.ndarray, at: np.ndarray | float, size: float = 1e-5) -> np.ndarray:
    """Derivatives of ``f`` at ``x`` (where it is ``at``) by forward differences, one row each."""
    out = []
    for k in range(len(x)):
        step = size * max(1.0, abs(x[k]))
        moved = x.copy()
        moved[k] += step
        out.append((f(moved) - at) / step)
    return np.array(out)


def least_squares(residuals: Callable[[np.ndarray], np.ndarray], x: np.ndarray, *, rounds: int = 30, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Damped Gauss-Newton steps; the place and its sum of squares."""
    e, damping = residuals(x), 1e-3
    loss = float(e @ e)
    for _ in range(rounds if len(x) else 0):
        j = slopes(residuals, x, e)
        gradient, curve = j @ e, j @ j.T
        if not np.isfinite(curve).all():
            break
        before = loss
        for _ in range(8):
            step = np.linalg.lstsq(curve + damping * np.diag(np.maximum(np.diag(curve), 1e-12)), -gradient, rcond=None)[0]
            tried = residuals(x + step)
            now = float(tried @ tried)
            if now < loss:
                x, e, loss, damping = x + step, tried, now, max(damping / 5, 1e-12)
                break
            damping *= 6
        if before - loss <= tolerance * before:
            break
    return x, loss


def minimise(f: Callable[[np.ndarray], float], x: np.ndarray, *, rounds: int = 60, tolerance: float = 1e-8) -> tuple[np.ndarray, float]:
    """Quasi-Newton steps (BFGS) that halve until the function falls; the place and its value."""
    value = f(x)
    if not len(x):
        return x, value
    gradient, inverse = slopes(f, x, value), np.eye(len(x))
    for _ in range(rounds):
        if not np.isfinite(gradient).all():
            break
        way = -inverse @ gradient
        if way @ gradient >= 0:
            inverse, way = np.eye(len(x)), -gradient
        way = way * min(1.0, 2.0 / max(1e-12, np.abs(way).max()))
        size, now = 1.0, f(x + way)
        while not now <= value + 1e-4 * size * (way @ gradient) and size > 1e-6:
            size /= 2
            now = f(x + size * way)
        if not now < value:
            break
        step, before, value = size * way, value, now
        x = x + step
        turned = slopes(f, x, value)
        change, gradient = turned - gradient, turned
        if (along := step @ change) > 1e-12:
            left = np.eye(len(x)) - np.outer(step, change) / along
            inverse = left @ inverse @ left.T + np.outer(step, step) / along
        if before - value <= tolerance * (abs(before) + tolerance):
            break
    return x, value
