"""Two small recurrent networks with their gradients: a forecaster of quantiles and an autoencoder.

A network's parameters are one flat vector, so that gradients of parts of a batch can be added up
wherever they were made. ``gradient`` gives sums over samples, not means.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    """Hidden states (samples, steps, units) of inputs (samples, steps, inputs), and what the way
    back needs. ``w`` has rows for input, forget and output gates and the candidate."""
    n, units = len(x), w.shape[0] // 4
    h, c, out, kept = np.zeros((n, units)), np.zeros((n, units)), [], []
    for t in range(x.shape[1]):
        z = np.hstack([x[:, t], h])
        a = z @ w.T + b
        i, f, o = (squash(a[:, k * units : (k + 1) * units]) for k in range(3))
        g = np.tanh(a[:, 3 * units :])
        before, c = c, f * c + i * g
        h = o * np.tanh(c)
        kept.append((z, i, f, o, g, before, c))
        out.append(h)
    return np.stack(out, axis=1), kept


def lstm_back(dh: np.ndarray, kept: list[tuple], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slopes of inputs, of w, of b) from the slopes of all hidden states."""
    units = w.shape[0] // 4
    inputs = w.shape[1] - units
    dw, db, dx = np.zeros_like(w), np.zeros(len(w)), np.zeros((*dh.shape[:2], inputs))
    later_h, later_c = np.zeros_like(dh[:, 0]), np.zeros_like(dh[:, 0])
    for t in range(len(kept) - 1, -1, -1):
        z, i, f, o, g, before, c = kept[t]
        now, tc = dh[:, t] + later_h, np.tanh(c)
        dc = later_c + now * o * (1 - tc**2)
        da = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), now * tc * o * (1 - o), dc * i * (1 - g**2)])
        dw += da.T @ z
        db += da.sum(axis=0)
        dz = da @ w
        dx[:, t], later_h, later_c = dz[:, :inputs], dz[:, inputs:], dc * f
    return dx, dw, db


class Network:
    """Shapes of the parameters, in order, and how they start."""

    def shapes(self) -> list[tuple[int, ...]]:
        raise NotImplementedError

    def size(self) -> int:
        return sum(math.prod(s) for s in self.shapes())

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([rng.uniform(-1, 1, s).reshape(-1) / math.sqrt(s[-1]) if len(s) > 1 else np.zeros(s) for s in self.shapes()])

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        shapes = self.shapes()
        return [p.reshape(s) for p, s in zip(np.split(flat, np.cumsum([math.prod(s) for s in shapes])[:-1]), shapes, strict=True)]


@dataclass(frozen=True)
class Autoencoder(Network):
    """An encoder's last state through a narrow layer, repeated at every step of a decoder."""

    hidden: int = 16
    latent: int = 4

    def shapes(self) -> list[tuple[int, ...]]:
        h, z = self.hidden, self.latent
        return [(4 * h, 1 + h), (4 * h,), (z, h), (z,), (h, z), (h,), (4 * h, 2 * h), (4 * h,), (1, h), (1,)]

    def _forward(self, flat: np.ndarray, x: np.ndarray):
        ew, eb, nw, nb, ww, wb, dw, db, ow, ob = self.parts(flat)
        coded, kept = lstm(x[:, :, None], ew, eb)
        latent = coded[:, -1] @ nw.T + nb
        wide = latent @ ww.T + wb
        decoded, again = lstm(np.repeat(wide[:, None], x.shape[1], axis=1), dw, db)
        return (decoded @ ow.T + ob)[:, :, 0], coded, kept, latent, decoded, again

    def apply(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self._forward(flat, x)[0]

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """Mean squared error of each window's steps, summed over windows."""
        made, coded, kept, latent, decoded, again = self._forward(flat, x)
        _, _, nw, _, ww, _, dw, _, ow, _ = self.parts(flat)
        ew = self.parts(flat)[0]
        off = made - x
        slope = (2 / x.shape[1]) * off[:, :, None]
        g_ow, g_ob = np.einsum("nto,nth->oh", slope, decoded), slope.sum(axis=(0, 1))
        d_in, g_dw, g_db = lstm_back(slope @ ow, again, dw)
        d_wide = d_in.sum(axis=1)
        d_latent = d_wide @ ww
        d_coded = np.zeros_like(coded)
        d_coded[:, -1] = d_latent @ nw
        _, g_ew, g_eb = lstm_back(d_coded, kept, ew)
        parts = [g_ew, g_eb, d_latent.T @ coded[:, -1], d_latent.sum(axis=0), d_wide.T @ latent, d_wide.sum(axis=0), g_dw, g_db, g_ow, g_ob]
        return float((off**2).mean(axis=1).sum()), np.concatenate([p.reshape(-1) for p in parts])


@dataclass(frozen=True)
class QuantileForecaster(Network):
    """An encoder's last state through one layer gives ``horizon`` steps of each quantile."""

    horizon: int
    quantiles: tuple[float, ...]
    inputs: int = 1
    hidden: int = 16

    def shapes(self) -> list[tuple[int, ...]]:
        h, out = self.hidden, self.horizon * len(self.quantiles)
        return [(4 * h, self.inputs + h), (4 * h,), (out, h), (out,)]

    def apply(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(samples, steps, quantiles) of inputs (samples, steps) or (samples, steps, inputs)."""
        w, b, ow, ob = self.parts(flat)
        coded, _ = lstm(x.reshape(len(x), -1, self.inputs), w, b)
        return (coded[:, -1] @ ow.T + ob).reshape(len(x), self.horizon, -1)

    def gradient(self, flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """The pinball loss, averaged over steps and quantiles, summed over samples."""
        w, b, ow, ob = self.parts(flat)
        coded, kept = lstm(x.reshape(len(x), -1, self.inputs), w, b)
        made = (coded[:, -1] @ ow.T + ob).reshape(len(x), self.horizon, -1)
        q, off = np.array(self.quantiles), y[:, :, None] - made
        share = 1 / (self.horizon * len(q))
        slope = (share * np.where(off >= 0, -q, 1 - q)).reshape(len(x), -1)
        d_coded = np.zeros_like(coded)
        d_coded[:, -1] = slope @ ow
        _, g_w, g_b = lstm_back(d_coded, kept, w)
        parts = [g_w, g_b, slope.T @ coded[:, -1], slope.sum(axis=0)]
        return float(share * np.maximum(q * off, (q - 1) * off).sum()), np.concatenate([p.reshape(-1) for p in parts])


class Adam:
    """Steps by running means of slopes and of their squares."""

    def __init__(self, size: int, rate: float, decay: Sequence[float] = (0.9, 0.999)):
        self.rate, self.decay, self.t = rate, decay, 0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def step(self, flat: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.t += 1
        one, two = self.decay
        self.mean = one * self.mean + (1 - one) * slope
        self.square = two * self.square + (1 - two) * slope**2
        return flat - self.rate * (self.mean / (1 - one**self.t)) / (np.sqrt(self.square / (1 - two**self.t)) + 1e-8)
