"""Kernels, piecewise time functions and baselines, as Column builders and in numpy."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Points of the numeric norm and primitive of a kernel without closed form.
NORM_POINTS, PRIMITIVE_POINTS = 10_000, 2048


def _dbl(x: float) -> Column:
    return F.lit(float(x))


class Kernel:
    """A kernel is 0 before 0 and, with a finite support, from its support on.

    A kernel of one's own gives shape(t) in numpy, and column(t) where Spark is to evaluate it.
    """

    support: float = math.inf

    def shape(self, t: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def column(self, t: Column) -> Column:
        raise NotImplementedError(f"{type(self).__name__} has no column form")

    def value(self, t: Column) -> Column:
        inside = t >= 0 if math.isinf(self.support) else (t >= 0) & (t < _dbl(self.support))
        return F.when(inside, self.column(t)).otherwise(0.0)

    def values(self, t) -> np.ndarray:
        t = np.asarray(t, float)
        return np.where((t >= 0) & (t < self.support), self.shape(np.where(t >= 0, t, 0.0)), 0.0)

    def primitive(self, t: float) -> float:
        """Integral from 0 to t."""
        if t <= 0:
            return 0.0
        x = np.linspace(0, min(t, self.support), PRIMITIVE_POINTS)
        return float(np.trapezoid(self.values(x), x))

    def primitive_between(self, s: float, t: float) -> float:
        """The primitive at t - max(s, 0): the kernel's integral over the lags up to t - s."""
        return self.primitive(t - max(s, 0.0))

    def norm(self) -> float:
        if math.isinf(self.support):
            raise ValueError("a kernel of infinite support needs its own norm")
        x = np.linspace(0, self.support, NORM_POINTS)
        return float(np.trapezoid(np.abs(self.values(x)), x))

    def future_bound(self, lag: float) -> float:
        """An upper bound of the values from lag on."""
        return float(max(self.values([max(lag, 0.0)])[0], 0.0))

    def plot_support(self) -> float:
        return self.support


class Zero(Kernel):
    support = 0.0

    def shape(self, t):
        return np.zeros_like(t)

    def column(self, t):
        return F.lit(0.0)

    def value(self, t):
        return F.lit(0.0)

    def primitive(self, t):
        return 0.0

    def norm(self):
        return 0.0

    def __str__(self):
        return "0"


@dataclass
class Exponential(Kernel):
    """intensity * decay * exp(-decay * t), whose norm is intensity."""

    intensity: float
    decay: float

    def shape(self, t):
        return self.intensity * self.decay * np.exp(-self.decay * t)

    def column(self, t):
        return _dbl(self.intensity * self.decay) * F.exp(_dbl(-self.decay) * t)

    def primitive(self, t):
        return -self.intensity * math.expm1(-self.decay * t) if t > 0 else 0.0

    def primitive_column(self, t: Column) -> Column:
        return F.when(t > 0, _dbl(self.intensity) * (1 - F.exp(_dbl(-self.decay) * t))).otherwise(0.0)

    def norm(self):
        return self.intensity

    def plot_support(self):
        return self.intensity / self.decay

    def __str__(self):
        return f"{self.intensity:g} * {self.decay:g} * exp(- {self.decay:g} * t)"


@dataclass
class ExponentialSum(Kernel):
    intensities: tuple[float, ...]
    decays: tuple[float, ...]

    def shape(self, t):
        return sum(a * b * np.exp(-b * t) for a, b in zip(self.intensities, self.decays, strict=True))

    def column(self, t):
        total = F.lit(0.0)
        for a, b in zip(self.intensities, self.decays, strict=True):
            total = total + _dbl(a * b) * F.exp(_dbl(-b) * t)
        return total

    def primitive(self, t):
        return sum(-a * math.expm1(-b * t) for a, b in zip(self.intensities, self.decays, strict=True)) if t > 0 else 0.0

    def norm(self):
        return float(sum(self.intensities))

    def plot_support(self):
        return 3 / min(b for b in self.decays if b > 0)

    def __str__(self):
        return " + ".join(str(Exponential(a, b)) for a, b in zip(self.intensities, self.decays, strict=True))


class PowerLaw(Kernel):
    """multiplier * (cutoff + t) ** -exponent up to a finite support."""

    def __init__(self, multiplier: float, cutoff: float, exponent: float, support: float = -1.0, error: float = 1e-5):
        self.multiplier, self.cutoff, self.exponent = multiplier, cutoff, exponent
        if support <= 0:
            support = (multiplier and error ** (-1 / exponent) / multiplier) - cutoff if multiplier else 0.0
        self.support = support

    def shape(self, t):
        return self.multiplier * (self.cutoff + t) ** -self.exponent

    def column(self, t):
        return _dbl(self.multiplier) * F.pow(_dbl(self.cutoff) + t, _dbl(-self.exponent))

    def primitive(self, t):
        t = min(t, self.support)
        if t <= 0:
            return 0.0
        c, e = self.cutoff, self.exponent
        return self.multiplier * (math.log((c + t) / c) if e == 1 else ((c + t) ** (1 - e) - c ** (1 - e)) / (1 - e))

    def norm(self):
        return self.primitive(self.support)

    def __str__(self):
        return f"{self.multiplier:g} * ({self.cutoff:g} + t)^(-{self.exponent:g})"


#: How a time function runs between its points, and beyond its last one.
LINEAR, CONST_LEFT, CONST_RIGHT = "linear", "const_left", "const_right"
ZERO, CONSTANT, CONTINUE, CYCLIC = "zero", "constant", "continue", "cyclic"


class TimeFunction:
    """A function of time given at points: linear, or constant from the right (CONST_RIGHT:
    the value of the point to the left) or from the left (CONST_LEFT: of the point to the
    right). Before 0 it is 0. Beyond the last point it is 0, border_value, its last value, or
    starts again. A single number is a constant."""

    def __init__(self, values, border: str = ZERO, inter: str = LINEAR, dt: float = 0.0, border_value: float = 0.0):
        self.constant = float(values) if np.isscalar(values) else None
        if self.constant is None:
            self.t, self.y = (np.asarray(v, float) for v in values)
            if len(self.t) < 2 or (np.diff(self.t) <= 0).any() or len(self.t) != len(self.y):
                raise ValueError("points must be at least two, at increasing times")
            self.dt = dt or float(np.diff(self.t).min() / 5)
        self.border, self.inter, self.border_value = border, inter, border_value

    def values(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        if self.constant is not None:
            return np.where(x >= 0, self.constant, 0.0)
        t, y = self.t, self.y
        out_x = x
        if self.border == CYCLIC:
            out_x = np.where(x > t[-1], (x - t[0]) % (t[-1] - t[0]) + t[0], x)
        i = np.clip(np.searchsorted(t, out_x, side="right") - 1, 0, len(t) - 2)
        if self.inter == LINEAR:
            v = y[i] + (y[i + 1] - y[i]) * (out_x - t[i]) / (t[i + 1] - t[i])
        else:
            v = y[i + 1] if self.inter == CONST_LEFT else y[i]
        v = np.where(out_x == t[-1], y[-1], v)
        beyond = {ZERO: 0.0, CONSTANT: self.border_value, CONTINUE: y[-1], CYCLIC: 0.0}[self.border]
        if self.border != CYCLIC:
            v = np.where(x > t[-1], beyond, v)
        first = {ZERO: 0.0, CONSTANT: self.border_value, CONTINUE: y[0], CYCLIC: 0.0}[self.border]
        v = np.where(out_x < t[0], first, v)
        return np.where(x < 0, 0.0, v)

    def column(self, x: Column) -> Column:
        """The same value as a Column, over an array literal of the points."""
        if self.constant is not None:
            return F.when(x >= 0, _dbl(self.constant)).otherwise(0.0)
        t, y = self.t, self.y
        at = x
        if self.border == CYCLIC:
            at = F.when(x > _dbl(t[-1]), F.pmod(x - _dbl(t[0]), _dbl(t[-1] - t[0])) + _dbl(t[0])).otherwise(x)
        pieces = F.when(at == _dbl(t[-1]), _dbl(y[-1]))
        for i in range(len(t) - 1, 0, -1):
            a, b, p, q = t[i - 1], t[i], y[i - 1], y[i]
            v = _dbl(p) + _dbl(q - p) * (at - _dbl(a)) / _dbl(b - a) if self.inter == LINEAR else _dbl(q if self.inter == CONST_LEFT else p)
            pieces = pieces.when((at >= _dbl(a)) & (at < _dbl(b)), v)
        first = {ZERO: 0.0, CONSTANT: self.border_value, CONTINUE: y[0], CYCLIC: 0.0}[self.border]
        beyond = {ZERO: 0.0, CONSTANT: self.border_value, CONTINUE: y[-1], CYCLIC: 0.0}[self.border]
        out = F.when(x < 0, 0.0).when(at < _dbl(t[0]), _dbl(first))
        if self.border != CYCLIC:
            out = out.when(x > _dbl(t[-1]), _dbl(beyond))
        return out.otherwise(pieces)

    def primitive(self, x: float, n: int | None = None) -> float:
        """Trapezoid rule from 0 to x in steps of about dt."""
        if x <= 0:
            return 0.0
        if self.constant is not None:
            return self.constant * x
        n = n or max(2, math.ceil(x / self.dt) + 1)
        grid = np.linspace(0, x, n)
        return float(np.trapezoid(self.values(grid), grid))

    def norm(self) -> float:
        if self.constant is not None:
            raise ValueError("a constant has no norm")
        return self.primitive(float(self.t[-1]))

    def future_bound(self, x: float) -> float:
        if self.constant is not None:
            return self.constant
        if self.border == CYCLIC:
            return float(self.y.max())
        rest = self.y[self.t >= x]
        tail = {ZERO: 0.0, CONSTANT: self.border_value, CONTINUE: self.y[-1]}[self.border]
        return float(max([tail, self.values(max(x, 0.0)), *rest, *(self.y[np.searchsorted(self.t, x, side="right") - 1 :][:1])]))


class TimeFunctionKernel(Kernel):
    """A kernel given by a time function; points given alone are constant from the right."""

    def __init__(self, function: TimeFunction | None = None, t=None, y=None):
        self.function = function or TimeFunction((t, y), ZERO, CONST_RIGHT)
        self.support = float(self.function.t[-1])

    def shape(self, t):
        return self.function.values(t)

    def column(self, t):
        return self.function.column(t)

    def primitive(self, t):
        return self.function.primitive(min(t, self.support)) if t > 0 else 0.0

    def norm(self):
        return self.function.norm()

    def future_bound(self, lag):
        return self.function.future_bound(lag)


def piecewise_baseline(t: Column, values: list[float], period: float) -> Column:
    """A periodic step function of equal steps."""
    k = len(values)
    at = F.least(F.floor(F.pmod(t, _dbl(period)) / _dbl(period) * k), F.lit(k - 1)).cast("int")
    return F.element_at(F.array(*(_dbl(v) for v in values)), at + 1)


def piecewise_baseline_primitive(t: float, values: list[float], period: float) -> float:
    """Its integral from 0 to t: whole periods and the rest."""
    k, step = len(values), period / len(values)
    whole = math.floor(t / period)
    rest = t - whole * period
    return whole * step * sum(values) + sum(v * min(max(rest - i * step, 0.0), step) for i, v in enumerate(values))


def baseline_starts(k: int, period: float) -> list[float]:
    return [i * period / k for i in range(k)]


def kernel_table(spark, kernels: list[list[Kernel]], points: int = 50):
    """The values of a kernel matrix on a grid over each plot support: i, j, t, value."""
    rows = []
    for i, row in enumerate(kernels):
        for j, k in enumerate(row):
            if 0 < k.plot_support() < math.inf:
                x = np.linspace(0, k.plot_support(), points)
                rows += [(i, j, float(t), float(v)) for t, v in zip(x, k.values(x), strict=True)]
    return spark.createDataFrame(rows, "i int, j int, t double, value double")


def norms(kernels: list[list[Kernel]]) -> np.ndarray:
    return np.array([[k.norm() for k in row] for row in kernels])


def spectral_radius(norm: np.ndarray) -> float:
    """The largest eigenvalue if all are real, else the largest modulus."""
    values = np.linalg.eigvals(np.asarray(norm, float))
    return float(values.real.max() if np.abs(values.imag).max() < 1e-14 else np.abs(values).max())


def stationary_intensity(norm: np.ndarray, baseline) -> np.ndarray:
    return np.linalg.solve(np.eye(len(norm)) - norm, np.asarray(baseline, float))
