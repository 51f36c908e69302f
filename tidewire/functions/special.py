"""Special functions that neither Spark nor numpy has, and numeric helpers of the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_erf = np.frompyfunc(math.erf, 1, 1)
_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def erf(x) -> np.ndarray:
    return _erf(np.asarray(x, float)).astype(float)


def lgamma(x) -> np.ndarray:
    return _lgamma(np.asarray(x, float)).astype(float)


def normal_quantile(p):
    return NormalDist().inv_cdf(p) if np.isscalar(p) else np.array([NormalDist().inv_cdf(float(x)) for x in p])


def erfinv(y: float) -> float:
    return NormalDist().inv_cdf((y + 1) / 2) / math.sqrt(2)


def beta_cdf(x, a: float, b: float) -> np.ndarray:
    """Regularised incomplete beta function, by quadrature on a fine grid with log densities."""
    x = np.clip(np.asarray(x, float), 0, 1)
    grid = (1 - np.cos(np.linspace(0, np.pi, 20_001))) / 2
    mid = (grid[1:] + grid[:-1]) / 2
    density = np.exp((a - 1) * np.log(mid) + (b - 1) * np.log1p(-mid) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    total = np.r_[0, np.cumsum(density * np.diff(grid))]
    return np.interp(x, grid, total / total[-1])


def relative_distance(new, old) -> float:
    """Distance of two vectors over the norm of the old one, or over 1 if that is less."""
    new, old = np.ravel(new).astype(float), np.ravel(old).astype(float)
    return float(np.linalg.norm(new - old) / max(np.linalg.norm(old), 1.0))


def finite_difference_gradient(f, x, eps: float = 1e-6) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([(f(x + e) - f(x - e)) / (2 * eps) for e in np.eye(len(x)) * eps])


def finite_difference_hessian(f, x, eps: float = 1e-4) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([(finite_difference_gradient(f, x + e, eps) - finite_difference_gradient(f, x - e, eps)) / (2 * eps) for e in np.eye(len(x)) * eps])


def symmetric_root(a: np.ndarray) -> np.ndarray:
    """Square root of a symmetric matrix without negative eigenvalues."""
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    return vectors @ np.diag(np.sqrt(np.maximum(values, 0))) @ vectors.T


def minimise(f, x0, lower: float | None = None, max_iter: int = 500, tol: float = 1e-10, memory: int = 10, report: dict | None = None) -> np.ndarray:
    """Minimise f (value and gradient) by projected limited-memory BFGS with a line search.

    lower bounds all coefficients from below. Values that aren't finite are stepped back from.
    report gets converged, false if max_iter ended it, and slope, the largest free slope left.
    """
    clip = (lambda x: np.maximum(x, lower)) if lower is not None else (lambda x: x)
    x = clip(np.asarray(x0, float))
    value, grad = f(x)
    s_list, y_list, ended = [], [], False
    for _ in range(max_iter):
        free = np.ones(len(x), bool) if lower is None else ~((x <= lower) & (grad > 0))
        if np.abs(grad[free]).max(initial=0.0) < tol:
            ended = True
            break
        q = np.where(free, grad, 0.0)
        alphas = []
        for s, y in zip(reversed(s_list), reversed(y_list), strict=True):
            a = (s[free] @ q[free]) / (s[free] @ y[free]) if s[free] @ y[free] > 1e-300 else 0.0
            alphas.append(a)
            q[free] -= a * y[free]
        if s_list and s_list[-1][free] @ y_list[-1][free] > 1e-300:
            q *= (s_list[-1][free] @ y_list[-1][free]) / (y_list[-1][free] @ y_list[-1][free])
        elif not s_list:
            q *= min(1.0, 1.0 / max(np.linalg.norm(q), 1e-300))
        for (s, y), a in zip(zip(s_list, y_list, strict=True), reversed(alphas), strict=True):
            b = (y[free] @ q[free]) / (s[free] @ y[free]) if s[free] @ y[free] > 1e-300 else 0.0
            q[free] += (a - b) * s[free]
        step, moved = -q, False
        if grad @ step >= 0:
            step, s_list, y_list = -np.where(free, grad, 0.0), [], []
        size = 1.0
        for _ in range(60):
            new = clip(x + size * step)
            new_value, new_grad = f(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * grad @ (new - x):
                moved = True
                break
            size /= 2
        if not moved:
            if not s_list:
                ended = True
                break
            s_list, y_list = [], []
            continue
        s, y = new - x, new_grad - grad
        if s @ y > 1e-14 * np.linalg.norm(s) * np.linalg.norm(y):
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        done = abs(value - new_value) <= 1e-15 * max(abs(value), abs(new_value), 1.0) and np.linalg.norm(s) < 1e-12
        x, value, grad = new, new_value, new_grad
        if done:
            ended = True
            break
    if report is not None:
        free = np.ones(len(x), bool) if lower is None else ~((x <= lower) & (grad > 0))
        slope = float(np.abs(grad[free]).max(initial=0.0))
        report.update(converged=ended or slope < tol, slope=slope)
    return x


def minimise_sum(f, penalty, prox, x0, max_iter: int = 500, tol: float = 1e-10, report: dict | None = None) -> np.ndarray:
    """Minimise f (value and gradient) plus a penalty with kinks, given by its value and its
    proximal point prox(x, step), by steps of the length of the last curvature.

    A step may raise the objective up to the largest of the last ten. It ends once a proximal
    step moves no entry by more than tol times its length. report gets converged, false if
    max_iter ended it, and slope, that move over the length: at a kink the slope left.
    """
    x = np.asarray(x0, float)
    value, grad = f(x)
    seen, step, slope = [value + penalty(x)], 1.0 / max(np.linalg.norm(grad), 1.0), math.inf
    for i in range(max_iter + 1):
        slope = float(np.abs(prox(x - step * grad, step) - x).max(initial=0.0)) / step
        if slope < tol or i == max_iter:
            break
        for _ in range(60):
            new = prox(x - step * grad, step)
            new_value, new_grad = f(new)
            whole, d = new_value + penalty(new), new - x
            if np.isfinite(whole) and whole <= max(seen) - 1e-4 / (2 * step) * d @ d + 1e-14 * max(abs(max(seen)), 1.0):
                break
            step /= 2
        else:
            break
        seen = [*seen, whole][-10:]
        bend = d @ (new_grad - grad)
        step = float(np.clip(d @ d / bend, 1e-10, 1e10)) if bend > 0 else step
        x, grad = new, new_grad
    if report is not None:
        report.update(converged=slope < tol, slope=slope)
    return x
