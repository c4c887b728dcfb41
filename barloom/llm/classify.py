"""A logistic classifier on a bounded sample, for the operators that learn from labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Logistic:
    """Weights over standardised features; `weights[0]` is the intercept."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.weights[0] + ((x - self.mean) / self.scale) @ self.weights[1:]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50, weight: np.ndarray | None = None) -> Logistic:
    """Penalised Newton steps; y may be posterior probabilities, rows may have a weight. No rows, or none with a
    weight, give a model that says 1/2."""
    width = x.shape[1]
    weight = np.ones(len(x)) if weight is None else weight
    if not weight.sum():
        return Logistic(np.zeros(width), np.ones(width), np.zeros(width + 1))
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))
    scale[scale == 0] = 1.0
    design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    ridge = np.full(width + 1, penalty)
    ridge[0] = 1e-3
    weights = np.zeros(width + 1)
    for _ in range(steps):
        p = sigmoid(design @ weights)
        slope = design.T @ (weight * (p - y)) + ridge * weights
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        move = np.linalg.solve(curve, slope)
        weights -= move * min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-7:
            break
    return Logistic(mean, scale, weights)
