"""Logistic regression on a bounded sample, as fitted on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def minimise(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 200, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking."""
    w, (value, slope) = start, objective(start)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(slope).max(initial=0) < 1e-6:
            break
        direction, kept = slope.copy(), []
        for s, y in reversed(steps):
            share = s @ direction / (s @ y)
            kept.append(share)
            direction -= share * y
        if steps:
            s, y = steps[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), share in zip(steps, reversed(kept)):
            direction += s * (share - y @ direction / (s @ y))
        length, fall = 1.0, slope @ direction
        while length > 1e-10:
            moved = w - length * direction
            new_value, new_slope = objective(moved)
            if new_value <= value - 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        if (moved - w) @ (new_slope - slope) > 1e-12:
            steps = [*steps[-memory + 1 :], (moved - w, new_slope - slope)]
        w, value, slope = moved, new_value, new_slope
    return w


def fit_sparse(row: np.ndarray, column: np.ndarray, value: np.ndarray, columns: int, target: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept for soft targets; *penalty* is the L2 weight of a mean loss."""
    total = max(weight.sum(), 1e-9)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, value * w[column], len(target)) + w[-1]
        loss = (weight * (np.logaddexp(0, z) - target * z)).sum() / total + penalty / 2 * (w[:-1] ** 2).sum()
        rest = weight * (sigmoid(z) - target) / total
        return loss, np.append(np.bincount(column, value * rest[row], columns) + penalty * w[:-1], rest.sum())

    rate = np.clip((weight * target).sum() / total, 1e-3, 1 - 1e-3)
    fitted = minimise(objective, np.append(np.zeros(columns), np.log(rate / (1 - rate))))
    return fitted[:-1], float(fitted[-1])


def fit_dense(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    total = max(weight.sum(), 1e-9)

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w[:-1] + w[-1]
        loss = (weight * (np.logaddexp(0, z) - target * z)).sum() / total + penalty / 2 * (w[:-1] ** 2).sum()
        rest = weight * (sigmoid(z) - target) / total
        return loss, np.append(x.T @ rest + penalty * w[:-1], rest.sum())

    fitted = minimise(objective, np.zeros(x.shape[1] + 1))
    return fitted[:-1], float(fitted[-1])
