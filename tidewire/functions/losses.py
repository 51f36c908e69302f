"""Losses of linear predictions and their derivatives, as Columns and in numpy.

Each loss has value(z, y) and slope(z, y), the derivative in the prediction z, as Column
builders, and both() in numpy. curve bounds the second derivative, None where there is no bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.special import lgamma


class Loss:
    curve: float | None = None
    #: Labels the loss expects: 'real', 'unit' (0 and 1), 'sign' (-1 and 1) or 'count'.
    labels = "real"

    def value(self, z: Column, y: Column) -> Column:
        raise NotImplementedError

    def slope(self, z: Column, y: Column) -> Column:
        raise NotImplementedError

    def both(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError


class Squared(Loss):
    curve = 1.0

    def value(self, z, y):
        return F.pow(z - y, F.lit(2.0)) / 2

    def slope(self, z, y):
        return z - y

    def both(self, z, y):
        r = z - y
        return r * r / 2, r


class Logistic(Loss):
    curve, labels = 0.25, "unit"

    def value(self, z, y):
        return F.when(z >= 0, z + F.log1p(F.exp(-z))).otherwise(F.log1p(F.exp(z))) - y * z

    def slope(self, z, y):
        return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z))) - y

    def both(self, z, y):
        e = np.exp(-np.abs(z))
        return np.maximum(z, 0) + np.log1p(e) - y * z, np.where(z >= 0, 1 / (1 + e), e / (1 + e)) - y


class Hinge(Loss):
    labels = "sign"

    def value(self, z, y):
        return F.greatest(F.lit(0.0), 1 - y * z)

    def slope(self, z, y):
        return F.when(y * z < 1, -y).otherwise(0.0)

    def both(self, z, y):
        m = 1 - y * z
        return np.maximum(m, 0), np.where(m > 0, -y, 0.0)


class SquaredHinge(Loss):
    curve, labels = 1.0, "sign"

    def value(self, z, y):
        return F.pow(F.greatest(F.lit(0.0), 1 - y * z), F.lit(2.0)) / 2

    def slope(self, z, y):
        return -y * F.greatest(F.lit(0.0), 1 - y * z)

    def both(self, z, y):
        m = np.maximum(1 - y * z, 0)
        return m * m / 2, -y * m


@dataclass
class SmoothedHinge(Loss):
    smoothness: float = 1.0
    labels = "sign"

    def __post_init__(self) -> None:
        if not 0.01 <= self.smoothness <= 1:
            raise ValueError("smoothness must be between 0.01 and 1")
        self.curve = 1 / self.smoothness

    def value(self, z, y):
        m, s = 1 - y * z, F.lit(float(self.smoothness))
        return F.when(m <= 0, 0.0).when(m >= s, m - s / 2).otherwise(m * m / (2 * s))

    def slope(self, z, y):
        m, s = 1 - y * z, F.lit(float(self.smoothness))
        return F.when(m <= 0, 0.0).when(m >= s, -y).otherwise(-y * m / s)

    def both(self, z, y):
        m, s = 1 - y * z, self.smoothness
        return np.where(m <= 0, 0, np.where(m >= s, m - s / 2, m * m / (2 * s))), np.where(m <= 0, 0, np.where(m >= s, -y, -y * m / s))


@dataclass
class Poisson(Loss):
    """Negative log-likelihood of counts. The exponential link clips predictions to +-20, the
    identity link keeps intensities at 1e-12 at least."""

    link: str = "exponential"
    labels = "count"

    @staticmethod
    def _log_factorial(y: Column) -> Column:
        k = F.greatest(y, F.lit(1.0)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))

    def value(self, z, y):
        if self.link == "exponential":
            c = F.greatest(F.least(z, F.lit(20.0)), F.lit(-20.0))
            return F.exp(c) - y * c + self._log_factorial(y)
        m = F.greatest(z, F.lit(1e-12))
        return m - y * F.log(m) + self._log_factorial(y)

    def slope(self, z, y):
        if self.link == "exponential":
            return F.exp(F.greatest(F.least(z, F.lit(20.0)), F.lit(-20.0))) - y
        return 1 - y / F.greatest(z, F.lit(1e-12))

    def both(self, z, y):
        if self.link == "exponential":
            c = np.clip(z, -20, 20)
            return np.exp(c) - y * c + lgamma(y + 1), np.exp(c) - y
        m = np.maximum(z, 1e-12)
        return m - y * np.log(m) + lgamma(y + 1), 1 - y / m


@dataclass
class Huber(Loss):
    threshold: float = 1.0
    curve = 1.0

    def value(self, z, y):
        r, t = F.abs(z - y), F.lit(float(self.threshold))
        return F.when(r <= t, r * r / 2).otherwise(t * (r - t / 2))

    def slope(self, z, y):
        r, t = z - y, float(self.threshold)
        return F.greatest(F.least(r, F.lit(t)), F.lit(-t))

    def both(self, z, y):
        r, t = z - y, self.threshold
        return np.where(np.abs(r) <= t, r * r / 2, t * (np.abs(r) - t / 2)), np.clip(r, -t, t)


class Absolute(Loss):
    def value(self, z, y):
        return F.abs(z - y)

    def slope(self, z, y):
        return F.signum(z - y)

    def both(self, z, y):
        return np.abs(z - y), np.sign(z - y)


@dataclass
class EpsilonInsensitive(Loss):
    threshold: float = 1.0

    def value(self, z, y):
        return F.greatest(F.abs(z - y) - F.lit(float(self.threshold)), F.lit(0.0))

    def slope(self, z, y):
        return F.when(F.abs(z - y) > F.lit(float(self.threshold)), F.signum(z - y)).otherwise(0.0)

    def both(self, z, y):
        r = z - y
        return np.maximum(np.abs(r) - self.threshold, 0), np.where(np.abs(r) > self.threshold, np.sign(r), 0.0)


class ModifiedHuber(Loss):
    """0 for margins from 1 on, (1 - margin)^2 down to -1, then the line -4 * margin."""

    curve, labels = 2.0, "sign"

    def value(self, z, y):
        m = y * z
        return F.when(m >= 1, 0.0).when(m >= -1, F.pow(1 - m, F.lit(2.0))).otherwise(-4 * m)

    def slope(self, z, y):
        m = y * z
        return F.when(m >= 1, 0.0).when(m >= -1, -2 * y * (1 - m)).otherwise(-4 * y)

    def both(self, z, y):
        m = y * z
        return np.where(m >= 1, 0, np.where(m >= -1, (1 - m) ** 2, -4 * m)), np.where(m >= 1, 0, np.where(m >= -1, -2 * y * (1 - m), -4 * y))
