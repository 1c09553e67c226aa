"""Calibration of a single number, logistic (Platt) or monotone, weighted so that classes count as they occur."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of P(label 1) over ``x``, by Newton's steps with a small ridge on the slope."""
    x, label, weight = (np.asarray(v, np.float64) for v in (x, label, weight))
    if not len(x):
        return 0.0, 0.0
    scale = float(x.std()) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], 1)
    at, ridge = np.zeros(2), np.array([1e-2, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        slope = design.T @ (weight * (p - label)) + ridge * at
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        at -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(at[0] / scale), float(at[1])


def prior_weights(label: np.ndarray, share: float) -> np.ndarray:
    """Weights with which class 1 makes up ``share`` of a sample."""
    label = np.asarray(label)
    n1, n0 = max(1, int((label == 1).sum())), max(1, int((label == 0).sum()))
    return np.where(label == 1, share / n1, (1 - share) / n0) * len(label)


def chance(x: np.ndarray, slope: float, intercept: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * np.asarray(x, np.float64) + intercept, -30, 30)))


def fit_monotone(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of P(label 1) over ``x``, never falling: pool adjacent violators, a knot at the middle of each pool.

    Each class has one more row at either end, so that no chance is 0 or 1.
    """
    x, label, weight = (np.asarray(v, np.float64) for v in (x, label, weight))
    order = np.argsort(x, kind="stable")
    low, high = (x.min(), x.max()) if len(x) else (0.0, 0.0)
    rows = [(low, 0.5, 1.0), *zip(x[order], label[order], weight[order], strict=True), (high, 0.5, 1.0)]
    pools: list[list[float]] = []
    for at, y, w in rows:
        pools.append([at * w, y * w, w])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [a / w for a, _, w in pools], [y / w for _, y, w in pools]


def monotone_chance(x: np.ndarray, knots: tuple[list[float], list[float]], slope: float, intercept: float) -> np.ndarray:
    """The monotone fit with a fiftieth of a logistic one, so that scores rise with ``x`` everywhere."""
    return 0.98 * np.interp(x, *knots) + 0.02 * chance(x, slope, intercept)
