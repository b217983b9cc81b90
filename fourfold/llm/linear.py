"""Small linear models, fitted on the driver over bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, weights: np.ndarray | None = None, steps: int = 30) -> np.ndarray:
    """Coefficients and, last, the intercept of an L2-penalised logistic regression (Newton steps).

    Without rows, or with one class only, the intercept is the smoothed log odds.
    """
    k = x.shape[1] if x.ndim == 2 else 0
    w = np.ones(len(y)) if weights is None else weights
    positive, total = float((w * y).sum()), float(w.sum())
    coef = np.zeros(k + 1)
    coef[-1] = np.log((positive + 0.5) / (total - positive + 0.5))
    if not len(y) or positive in (0.0, total):
        return coef
    a = np.hstack([x, np.ones((len(y), 1))])
    ridge = np.full(k + 1, l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ coef)
        gradient = a.T @ (w * (p - y)) + ridge * coef
        curve = w * np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((a * curve[:, None]).T @ a + np.diag(ridge), gradient)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        coef -= step
        if np.abs(step).max() < 1e-6:
            break
    return coef


def logits(x: np.ndarray, coef: np.ndarray) -> np.ndarray:
    return x @ coef[:-1] + coef[-1]


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, l2: float, weights: np.ndarray | None = None) -> np.ndarray:
    """Logits of each row from a model that saw no row of its fold."""
    out = np.zeros(len(y))
    for k in np.unique(fold):
        train, test = fold != k, fold == k
        out[test] = logits(x[test], fit_logistic(x[train], y[train], l2, None if weights is None else weights[train]))
    return out


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, l2: float = 1e-3, steps: int = 400, rate: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, classes) and intercepts of a multinomial logistic regression (accelerated gradient steps)."""
    n = max(1, len(y))
    target = np.eye(classes)[y] if len(y) else np.zeros((0, classes))
    w = v = np.zeros((x.shape[1] + 1, classes))
    a = np.hstack([x, np.ones((len(y), 1))])
    size = rate / max(1e-9, 0.5 * float((a * a).sum(axis=1).mean() if len(y) else 1.0) + l2)
    for k in range(steps):
        z = a @ v
        p = np.exp(z - z.max(axis=1, keepdims=True)) if len(y) else z
        p = p / p.sum(axis=1, keepdims=True) if len(y) else p
        gradient = a.T @ (p - target) / n
        gradient[:-1] += l2 * v[:-1]
        new = v - size * gradient
        v = new + k / (k + 3.0) * (new - w)
        w = new
    return w[:-1], w[-1]
