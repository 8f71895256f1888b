"""Logistic regression over sparse hashed features, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def fit_logistic(rows: list[np.ndarray], y: np.ndarray, dims: int, *, steps: int = 120, rate: float = 0.1, l2: float = 1e-4, scale: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss against ``y`` (0..1, may be a probability).

    ``rows`` holds the feature ids of each example, ``scale`` the value all its features have
    (default 1). Adam over the whole sample; the bias is not penalised.
    """
    n = len(rows)
    if n == 0:
        return np.zeros(dims, np.float32), 0.0
    value = np.ones(n, np.float32) if scale is None else scale.astype(np.float32)
    ids = np.concatenate(rows) if n else np.zeros(0, np.int64)
    used, cols = np.unique(ids, return_inverse=True)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    w, b = np.zeros(len(used)), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m1, m2, g1, g2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(owner, weights=w[cols], minlength=n) * value + b
        err = (sigmoid(z) - y) / n
        grad = np.bincount(cols, weights=(err * value)[owner], minlength=len(used)) + l2 * w
        gb = float(err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        g1, g2 = 0.9 * g1 + 0.1 * gb, 0.999 * g2 + 0.001 * gb * gb
        w -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        b -= rate * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(dims, np.float32)
    full[used] = w
    return full, b


def telling(rows: list[np.ndarray], y: np.ndarray, dims: int, *, least_rows: int, least_z: float) -> np.ndarray:
    """Mask of features whose rows differ in ``y`` from the rest by ``least_z`` standard errors."""
    ids, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    n, share = np.bincount(ids, minlength=dims), float(np.mean(y))
    z = (np.bincount(ids, weights=y[owner], minlength=dims) - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    return (n >= least_rows) & (np.abs(z) >= least_z)
