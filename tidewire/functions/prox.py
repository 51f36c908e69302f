"""Proximal operators of coefficient vectors, in numpy on the driver.

A prox is called with a vector and a step; it acts on the coefficients of its range only and,
where positive is set, clips what it returns. value is the penalty, infinite where a positive
prox meets a negative coefficient.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.special import normal_quantile


def soft(x, s):
    return np.sign(x) * np.maximum(np.abs(x) - s, 0)


def soft_column(x: Column, s: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - F.lit(float(s)), F.lit(0.0))


class Prox:
    def __init__(self, strength: float = 0.0, range: tuple[int, int] | None = None, positive: bool = False):
        self.strength, self.range, self.positive = strength, range, positive

    def __call__(self, x, step: float = 1.0) -> np.ndarray:
        out = np.array(x, float)
        a, b = self.range or (0, len(out))
        new = self._prox(out[a:b], step)
        out[a:b] = np.maximum(new, 0) if self.positive else new
        return out

    def value(self, x) -> float:
        x = np.asarray(x, float)
        a, b = self.range or (0, len(x))
        if self.positive and (x[a:b] < 0).any():
            return math.inf
        return float(self._value(x[a:b]))

    def _prox(self, x, step):
        return x

    def _value(self, x):
        return 0.0


class ProxZero(Prox):
    pass


class ProxPositive(Prox):
    def __init__(self, range=None):
        super().__init__(range=range, positive=True)


class ProxL1(Prox):
    def _prox(self, x, step):
        return soft(x, self.strength * step)

    def _value(self, x):
        return self.strength * np.abs(x).sum()


class ProxL1Weighted(Prox):
    def __init__(self, strength, weights, range=None, positive=False):
        super().__init__(strength, range, positive)
        self.weights = np.asarray(weights, float)

    def _prox(self, x, step):
        return soft(x, self.strength * step * self.weights)

    def _value(self, x):
        return self.strength * (self.weights * np.abs(x)).sum()


class ProxL2Squared(Prox):
    def _prox(self, x, step):
        return x / (1 + self.strength * step)

    def _value(self, x):
        return self.strength * (x @ x) / 2


class ProxL2(Prox):
    def _prox(self, x, step):
        t, norm = self.strength * step * math.sqrt(len(x)), np.linalg.norm(x)
        return x * max(1 - t / norm, 0) if norm > 0 else x

    def _value(self, x):
        return self.strength * math.sqrt(len(x)) * np.linalg.norm(x)


class ProxElasticNet(Prox):
    def __init__(self, strength, ratio=0.95, range=None, positive=False):
        super().__init__(strength, range, positive)
        self.ratio = ratio

    def _prox(self, x, step):
        s = self.strength * step
        return soft(x, s * self.ratio) / (1 + s * (1 - self.ratio))

    def _value(self, x):
        return self.strength * (self.ratio * np.abs(x).sum() + (1 - self.ratio) * (x @ x) / 2)


class ProxNuclear(Prox):
    """Shrinks the singular values of the coefficients as a matrix of n_rows rows (square by default)."""

    def __init__(self, strength, n_rows=None, range=None, positive=False):
        super().__init__(strength, range, positive)
        self.n_rows = n_rows

    def _matrix(self, x):
        n = self.n_rows or math.isqrt(len(x))
        if n * (len(x) // n) != len(x):
            raise ValueError("the coefficients don't fill a matrix of n_rows rows")
        return x.reshape(n, -1)

    def _prox(self, x, step):
        u, s, v = np.linalg.svd(self._matrix(x), full_matrices=False)
        return (u * np.maximum(s - self.strength * step, 0) @ v).ravel()

    def _value(self, x):
        return self.strength * np.linalg.svd(self._matrix(x), compute_uv=False).sum()


class ProxEquality(Prox):
    """All coefficients of the range become their mean."""

    def _prox(self, x, step):
        return np.full_like(x, max(x.mean(), 0) if self.positive else x.mean())

    def _value(self, x):
        return 0.0 if np.ptp(x) == 0 else math.inf


def total_variation_prox(y: np.ndarray, strength: float) -> np.ndarray:
    """Exact solution of min 1/2 |x - y|^2 + strength * sum |x[i+1] - x[i]|.

    Dynamic programming from left to right: the derivative of the best cost up to a place is
    piecewise linear; its knots are kept in a deque and cut to +-strength at every place.
    """
    n = len(y)
    if n < 2 or strength <= 0:
        return y.copy()
    dq: deque = deque()
    low, high = np.zeros(n - 1), np.zeros(n - 1)
    left, right = (1.0, -y[0]), (1.0, -y[0])
    for i in range(n - 1):
        a, b = left
        while True:
            x = (-strength - b) / a
            if dq and dq[0][0] < x:
                _, da, db = dq.popleft()
                a, b = a + da, b + db
            else:
                break
        low[i] = x
        dq.appendleft((x, a, b + strength))
        a, b = right
        while True:
            x = (strength - b) / a
            if len(dq) > 1 and dq[-1][0] > x:
                _, da, db = dq.pop()
                a, b = a - da, b - db
            else:
                break
        high[i] = x
        dq.append((x, -a, strength - b))
        left = (1.0, -y[i + 1] - strength)
        right = (1.0, -y[i + 1] + strength)
    a, b = left
    while True:
        x = -b / a
        if dq and dq[0][0] < x:
            _, da, db = dq.popleft()
            a, b = a + da, b + db
        else:
            break
    out = np.empty(n)
    out[-1] = x
    for i in range(n - 2, -1, -1):
        out[i] = min(max(out[i + 1], low[i]), high[i])
    return out


class ProxTV(Prox):
    def _prox(self, x, step):
        return total_variation_prox(x, self.strength * step)

    def _value(self, x):
        return self.strength * np.abs(np.diff(x)).sum()


def falling(z) -> np.ndarray:
    """The nearest falling sequence without negative values: pooled means of neighbours."""
    blocks: list[list[float]] = []  # sum and length
    for v in z:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] <= blocks[-1][0] / blocks[-1][1]:
            s, n = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
    return np.concatenate([np.full(int(n), max(s / n, 0.0)) for s, n in blocks]) if blocks else np.asarray(z, float)


class ProxSlope(Prox):
    """Sorted l1: weights fall with the rank by the quantiles of a false discovery rate."""

    def __init__(self, strength, fdr=0.6, range=None, positive=False):
        super().__init__(strength, range, positive)
        self.fdr = fdr

    def weights(self, n):
        return normal_quantile(1 - self.fdr * np.arange(1, n + 1) / (2 * n))

    def _prox(self, x, step):
        sign = np.where(x >= 0, 1.0, 0.0 if self.positive else -1.0)
        size = np.maximum(x, 0) if self.positive else np.abs(x)
        order = np.argsort(-size, kind="stable")
        z = size[order] - self.strength * step * self.weights(len(x))
        flat = falling(z)
        out = np.empty_like(x)
        out[order] = flat
        return out * sign

    def _value(self, x):
        return self.strength * (np.sort(np.abs(x))[::-1] * self.weights(len(x))).sum()


class _Blocks(Prox):
    def __init__(self, strength, starts, lengths, range=None, positive=False):
        super().__init__(strength, range, positive)
        self.blocks = list(zip(starts, lengths, strict=True))


class ProxGroupL1(_Blocks):
    """Group lasso over blocks, each weighted by the root of its length."""

    def _prox(self, x, step):
        out = x.copy()
        for a, n in self.blocks:
            norm, t = np.linalg.norm(x[a : a + n]), self.strength * step * math.sqrt(n)
            out[a : a + n] = x[a : a + n] * max(1 - t / norm, 0) if norm > 0 else 0.0
        return out

    def _value(self, x):
        return self.strength * sum(math.sqrt(n) * np.linalg.norm(x[a : a + n]) for a, n in self.blocks)


class ProxBinarsity(_Blocks):
    """Total variation within blocks, then each block centred."""

    def _prox(self, x, step):
        out = x.copy()
        for a, n in self.blocks:
            z = total_variation_prox(x[a : a + n], self.strength * step)
            out[a : a + n] = z - z.mean()
        return out

    def _value(self, x):
        return self.strength * sum(np.abs(np.diff(x[a : a + n])).sum() for a, n in self.blocks)


class ProxMulti(Prox):
    """Several prox one after the other."""

    def __init__(self, proxs):
        super().__init__()
        self.proxs = list(proxs)

    def __call__(self, x, step=1.0):
        for p in self.proxs:
            x = p(x, step)
        return x

    def value(self, x):
        return sum(p.value(x) for p in self.proxs)
