"""Kernel of a one-node process from its autocorrelation, in a reproducing kernel space."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.data import EventData
from tidewire.operators import bands


def lag_histogram(data: EventData, edges) -> DataFrame:
    """k, n: numbers of pairs of events by bin of their lag, each bin closed at the left and
    the last one on both sides. Pairs at one time have lag 0. Bins without pairs are missing."""
    edges = [float(e) for e in edges]
    p = bands.band_pairs(data.events, data.events, edges[-1]).where("lag > 0 or (lag = 0 and eid > s_eid)")
    below = sum((F.col("lag") >= F.lit(e)).cast("int") for e in edges[1:-1]) + F.lit(0)
    return p.groupBy(below.alias("k")).agg(F.count("*").alias("n"))


def lag_exposure(data: EventData, edges) -> DataFrame:
    """k, exposure: for how long lags of bin k could be seen after the events."""
    rest = F.greatest(F.col("end_time") - F.col("t"), F.lit(0.0))
    parts = F.array(*(F.greatest(F.lit(0.0), F.least(rest - F.lit(float(a)), F.lit(float(b) - float(a)))) for a, b in zip(edges[:-1], edges[1:], strict=True)))
    each = data.events.join(data.ends, "r").select(F.posexplode(parts).alias("k", "x"))
    return each.groupBy("k").agg(F.sum("x").alias("exposure"))


def sobolev(x, y) -> np.ndarray:
    """Reproducing kernel on [-1, 1] of value and slope at -1 and the squared curvature."""
    a, b = np.minimum(x, y) + 1, np.maximum(x, y) + 1
    return 1 + a * b + a * a * b / 2 - a**3 / 6


class KernelSpace:
    """Estimate of the kernel of a self-exciting process with one node.

    The autocorrelation is counted in Spark; the integral equation, mapped from lags to
    [-1, 1] by lag = scale * (1 - z) / (1 + z), is solved in the span of the representers of
    chosen points. Inner products of representers are exact, so the system needs no grid.
    """

    def __init__(self, support: float, bandwidth: float, size: int = 21, grid: int = 401, quadrature: int = 200, scale: float | None = None, ridge: float = 1e-8, clip: bool = True):
        self.support, self.bandwidth, self.size, self.grid, self.quadrature = support, bandwidth, size, grid, quadrature
        self.scale, self.ridge, self.clip = scale or 0.7 * support, ridge, clip

    def edges(self) -> np.ndarray:
        e = np.arange(0.0, self.support + self.bandwidth, self.bandwidth)
        e[-1] = min(e[-1], self.support)
        if len(e) < 3:
            raise ValueError("support and bandwidth must give two bins at least")
        return e

    def fit(self, data: EventData) -> KernelSpace:
        if data.n_nodes != 1:
            raise ValueError("one node only")
        edges = self.edges()
        counts, seen = np.zeros(len(edges) - 1), np.zeros(len(edges) - 1)
        for r in lag_histogram(data, edges).collect():
            counts[r["k"]] = r["n"]
        for r in lag_exposure(data, edges).collect():
            seen[r["k"]] = r["exposure"]
        self.mean = data.n_jumps / data.total_time
        self.lags = (edges[:-1] + edges[1:]) / 2
        self.autocorrelation = np.where(seen > 0, counts / np.where(seen > 0, seen, 1), 0.0) - self.mean
        return self._solve()

    def _phi(self, lag) -> np.ndarray:
        a = np.abs(lag)
        v = np.interp(a, np.r_[0, self.lags], np.r_[self.autocorrelation[0], self.autocorrelation])
        return np.where(a > self.lags[-1], 0.0, v)

    def _lag(self, z):
        with np.errstate(divide="ignore"):
            return np.where(z > -1, self.scale * (1 - z) / (1 + z), np.inf)

    def _solve(self) -> KernelSpace:
        points = np.cos(np.pi * np.arange(self.size) / self.size)
        nodes, weights = np.polynomial.legendre.leggauss(self.quadrature)
        lag = self._lag(points)
        # Row i: the weights of the representers whose sum is the functional at point i.
        mix = np.zeros((self.size, self.size + self.quadrature))
        mix[:, : self.size] = np.diag((points + 1) ** 2)
        mix[:, self.size :] = 2 * self.scale * weights * self._phi(lag[:, None] - self._lag(nodes)[None, :])
        at = np.r_[points, nodes]
        gram = mix @ sobolev(at[:, None], at[None, :]) @ mix.T
        self.coefficients = np.linalg.solve((gram + gram.T) / 2 + self.ridge * np.eye(self.size), self._phi(lag))
        z = np.linspace(-1, 1, self.grid)
        self.basis = mix @ sobolev(at[:, None], z[None, :])
        y = (z + 1) ** 2 * (self.coefficients @ self.basis)
        t = self._lag(z)
        keep = np.flatnonzero((t >= 0) & (t <= self.support))[::-1]
        t, y = t[keep], np.maximum(y[keep], 0) if self.clip else y[keep]
        if t[0] > 0:
            t, y = np.r_[0, t], np.r_[y[0], y]
        if self.support - t[-1] > 1e-12:
            t, y = np.r_[t, self.support], np.r_[y, 0.0]
        y[-1] = 0.0
        self.t, self.values = t, y
        self.branching = float(np.trapezoid(np.abs(y), t))
        self.baseline = self.mean * max(1 - self.branching, 0.0)
        return self

    def kernel_values(self, x) -> np.ndarray:
        return np.interp(x, self.t, self.values, left=0.0, right=0.0)

    def primitive_values(self, x) -> np.ndarray:
        total = np.r_[0, np.cumsum(np.diff(self.t) * (self.values[1:] + self.values[:-1]) / 2)]
        return np.interp(np.clip(x, 0, self.support), self.t, total)
