"""Small linear models on a bounded sample, fitted on the driver, and how the sample is drawn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, label: str, key: str, per_label: int, seed: int = 7) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of ``key``: the same ones in every run.

    Only the number of rows of each label comes to the driver.
    """
    sizes = {r[0]: r[1] for r in rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not sizes:
        return rows.limit(0)
    share: Column = F.lit(0)
    for value, n in sizes.items():
        share = F.when(F.col(label) == F.lit(value), min(1.0, per_label / n) * (1 << 30)).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1 << 30)) < share)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine; ``y`` holds 1 and -1.  Dual coordinate ascent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    square = np.einsum("ij,ij->i", x, x)
    dual, w, order = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            new = min(max(dual[i] - (y[i] * (w @ x[i]) - 1) / square[i], 0.0), c)
            if new != dual[i]:
                w += (new - dual[i]) * y[i] * x[i]
                dual[i] = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 300, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights (bias last) of a logistic regression; ``y`` holds 1 and 0.  Accelerated full-batch descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.ones(len(x)) if weight is None else weight
    weight = (weight / weight.sum()).astype(x.dtype)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(12):  # the largest curvature, for the step
        v = x.T @ (weight * (x @ v))
        top = np.linalg.norm(v)
        v /= max(top, 1e-12)
    step = 1.0 / (0.25 * top + l2)
    w = before = np.zeros(x.shape[1], x.dtype)
    ridge = np.full(x.shape[1], l2, x.dtype)
    ridge[-1] = 0
    for k in range(rounds):
        at = w + x.dtype.type(k / (k + 3)) * (w - before)
        before, w = w, at - x.dtype.type(step) * (x.T @ (weight * (sigmoid(x @ at) - y)) + ridge * at)
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities; the targets are smoothed, so neither runs away."""
    if not len(margin):
        return 1.0, 0.0
    good, bad = float((y == 1).sum()), float((y != 1).sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = max(float(np.abs(margin).max()), 1e-9)
    x = np.stack([margin / scale, np.ones(len(margin))], axis=1)
    w = np.zeros(2)
    for _ in range(50):  # Newton's method
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (p - target))
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])
