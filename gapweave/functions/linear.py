"""Linear fits from sums of products; no pass over the rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gapweave.functions.gram import Moments


@dataclass
class LinearFit:
    coef: np.ndarray
    intercept: float
    sse: float
    n: int


def _parts(m: Moments, features: list[str], target: str):
    at, t = m.at(features), m.columns.index(target)
    return m.cross[np.ix_(at, at)], m.cross[at, t], m.cross[t, t], m.mean[at], m.mean[t]


def ridge(m: Moments, features: list[str], target: str, alpha: float = 0.0) -> LinearFit:
    """Least squares with an unpenalised intercept; minimum norm where the inputs are dependent."""
    xx, xy, yy, mx, my = _parts(m, features, target)
    coef = np.linalg.pinv(xx + alpha * np.eye(len(features)), hermitian=True, rcond=1e-12) @ xy
    sse = max(0.0, float(yy - 2 * coef @ xy + coef @ xx @ coef))
    return LinearFit(coef, float(my - coef @ mx), sse, m.n)


def bayesian_ridge(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, rounds: int = 300, tol: float = 1e-3,
                   prior: float = 1e-6) -> np.ndarray:
    """Coefficients under evidence maximisation (MacKay updates) from centred products."""
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    rotated = vectors.T @ xy
    noise = 1.0 / (yy / max(n, 1) + np.finfo(float).eps)
    weight = 1.0
    old = None

    def solve():
        c = vectors @ (rotated / (values + weight / noise))
        return c, max(0.0, float(yy - 2 * c @ xy + c @ xx @ c))

    for i in range(rounds):
        coef, sse = solve()
        gamma = float(np.sum(noise * values / (weight + noise * values)))
        weight = (gamma + 2 * prior) / (float(coef @ coef) + 2 * prior)
        noise = (n - gamma + 2 * prior) / (sse + 2 * prior)
        if i and np.abs(old - coef).sum() < tol:
            break
        old = coef
    return solve()[0]
