"""Logistic regression on hashed sparse features, fitted with numpy on a bounded
sample, and Platt calibration.  Models are a few hundred kilobytes: a weight
per hash bucket, whatever the size of the corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Sparse:
    """Rows of (feature, value), flat: row ``i`` is ``offsets[i]:offsets[i + 1]``."""

    features: np.ndarray
    values: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        lens = [len(f) for f, _ in rows]
        offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
        features, values = np.zeros(offsets[-1], np.int32), np.zeros(offsets[-1], np.float32)
        for (f, v), a, b in zip(rows, offsets[:-1], offsets[1:], strict=True):
            features[a:b], values[a:b] = f, v
        return cls(features, values, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def _parts(self, rows: int = 256):
        """Runs of rows, so that a step's temporary arrays stay small."""
        for a in range(0, len(self), rows):
            b = min(a + rows, len(self))
            lo, hi = self.offsets[a], self.offsets[b]
            yield slice(a, b), self.features[lo:hi], self.values[lo:hi], self.offsets[a:b + 1] - lo

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self))
        for rows, f, v, at in self._parts():
            running = np.concatenate([[0.0], np.cumsum(w[f] * v, dtype=np.float64)])
            out[rows] = running[at[1:]] - running[at[:-1]]
        return out

    def transposed_dot(self, errors: np.ndarray, dim: int) -> np.ndarray:
        out = np.zeros(dim)
        for rows, f, v, at in self._parts():
            out += np.bincount(f, weights=np.repeat(errors[rows], np.diff(at)) * v, minlength=dim)
        return out


def fit_logistic(x: Sparse, y: np.ndarray, dim: int, l2: float, steps: int = 120,
                 rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and intercept for targets ``y`` in 0..1 (posterior labels may be
    fractions): full-batch Adam, a fixed number of steps."""
    w, b = np.zeros(dim), float(np.log((y.mean() + 1e-3) / (1.001 - y.mean()))) if len(y) else 0.0
    if not len(y):
        return w, b
    m, v, mb, vb = np.zeros(dim), np.zeros(dim), 0.0, 0.0
    for t in range(1, steps + 1):
        err = (sigmoid(x.dot(w) + b) - y) / len(y)
        g, gb = x.transposed_dot(err, dim) + l2 * w, float(err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** t, 1 - 0.999 ** t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, b


def fit_platt(z: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) such that ``sigmoid(a * z + b)`` is a calibrated probability:
    Newton's method on targets shrunk by one count of each class, a >= 0."""
    pos = float(y.sum())
    neg = len(y) - pos
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        ga, gb = float(((p - t) * z).sum()) + 1e-4 * (a - 1), float((p - t).sum())
        s = np.maximum(p * (1 - p), 1e-9)
        haa, hab, hbb = float((s * z * z).sum()) + 1e-4, float((s * z).sum()), float(s.sum()) + 1e-4
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
        if abs(da) + abs(db) < 1e-8:
            break
    return max(a, 0.0), b


def fit_smooth(x: Sparse, y: np.ndarray, dim: int, l2: float, steps: int = 100) -> tuple[np.ndarray, float]:
    """Like ``fit_logistic``, by accelerated gradient steps of one length for
    all weights: a feature of few rows moves little, so it can't be learned by
    heart from fractional targets."""
    if not len(y):
        return np.zeros(dim), 0.0
    # a quarter of the mean squared length of a row bounds the curvature
    rate = 4 / (1 + float(np.dot(x.values, x.values)) / len(y))
    w, b = np.zeros(dim), float(np.log((y.mean() + 1e-3) / (1.001 - y.mean())))
    aw, ab = w.copy(), b
    for t in range(1, steps + 1):
        err = (sigmoid(x.dot(aw) + ab) - y) / len(y)
        nw = aw - rate * (x.transposed_dot(err, dim) + l2 * aw)
        nb = ab - rate * float(err.sum())
        k = (t - 1) / (t + 2)
        aw, ab = nw + k * (nw - w), nb + k * (nb - b)
        w, b = nw, nb
    return w, b
