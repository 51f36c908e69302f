"""Integrated cumulants of point processes and the matching of a kernel matrix to them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.data import EventData
from tidewire.functions.special import minimise, symmetric_root
from tidewire.operators import bands
from tidewire.session import written


def rates(data: EventData) -> DataFrame:
    """r, node, n, end_time, rate for every realization and node, empty nodes too, with the
    time of the last event."""
    grid = data.ends.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(data.n_nodes - 1))))
    counts = data.events.groupBy("r", "node").agg(F.count("*").alias("n"), F.max("t").alias("last"))
    return grid.join(counts, ["r", "node"], "left").fillna(0, ["n"]).withColumn("rate", F.coalesce(F.try_divide("n", "end_time"), F.lit(0.0)))


def mean_intensity(data: EventData) -> np.ndarray:
    """Per node the mean over realizations of events per time."""
    out = np.zeros(data.n_nodes)
    for r in rates(data).groupBy("node").agg(F.avg("rate").alias("m")).collect():
        out[r["node"]] = r["m"]
    return out


def covariance_terms(data: EventData, h: float) -> DataFrame:
    """r, i, j, c, k: per realization the covariance term and the integral term of every pair.

    For an event at t of i, from time h on, other events of j count within h, and with weight
    2h - distance within 2h; the mean is taken off. An event has a term for j only if j goes
    on to t + 2h at least.
    """
    base = rates(data)
    targets = data.events.where(F.col("t") >= h)
    ends = base.select("r", F.col("node").alias("j"), "rate", "last", "end_time")
    # Numbers of terms per realization and pair; events of i against the D rows of their realization.
    terms = targets.select("r", F.col("node").alias("i"), "t").join(ends, "r").where(F.col("last") >= F.col("t") + 2 * h)
    terms = terms.groupBy("r", "i", "j").agg(F.count("*").alias("n"), F.first("rate").alias("rate"), F.first("end_time").alias("end_time"))
    p = bands.band_pairs(targets, data.events, 2 * h, 2 * h).where(F.abs("lag") < 2 * h)
    p = p.join(base.select("r", F.col("node").alias("s_node"), "last"), ["r", "s_node"]).where(F.col("last") >= F.col("t") + 2 * h)
    sums = p.groupBy("r", F.col("node").alias("i"), F.col("s_node").alias("j")).agg(F.count_if(F.abs("lag") < h).alias("near"), F.sum(2 * h - F.abs("lag")).alias("weight"))
    both = terms.join(sums, ["r", "i", "j"], "left").fillna(0, ["near", "weight"])
    c = F.try_divide(F.col("near") - F.col("n") * F.col("rate") * (2 * h), F.col("end_time"))
    k = F.try_divide(F.col("weight") - F.col("n") * F.col("rate") * (4 * h * h), F.col("end_time"))
    return both.select("r", "i", "j", c.alias("c"), k.alias("k"))


def _symmetric(terms: DataFrame) -> DataFrame:
    """Each pair's terms and those of the reversed pair, halved and added."""
    half = terms.select("r", "i", "j", (F.col("c") / 2).alias("c"), (F.col("k") / 2).alias("k"))
    turned = half.select("r", F.col("j").alias("i"), F.col("i").alias("j"), "c", "k")
    return half.unionByName(turned).groupBy("r", "i", "j").agg(F.sum("c").alias("c"), F.sum("k").alias("k"))


def skewness_terms(data: EventData, h: float, symmetric: DataFrame) -> DataFrame:
    """r, i, j, k, e: sums over events of k, from time h on, of the product of the counts of i
    and of j within h less their means, less the pair's integral term; only events at which
    both i and j go on to t + h. Triples (i, j, j) and (j, j, i) are made, as they are used."""
    n = data.n_nodes
    base = rates(data)
    targets = data.events.where(F.col("t") >= h)
    p = bands.band_pairs(targets, data.events, h, h).where(F.abs("lag") < h)
    near = bands.dense_features(data, p, [F.lit(1.0)]).where(F.col("t") >= h)
    per = base.groupBy("r").agg(F.first("end_time").alias("end_time"), F.array_sort(F.collect_list(F.struct("node", "rate", "last"))).alias("b"))  # one entry per node
    rows = near.join(per, "r").select("r", "node", "t", "phi", F.col("b.rate").alias("rate"), F.col("b.last").alias("last"), "end_time")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = np.arange(n)
        for b in batches:
            if not b.num_rows:
                continue
            r, k, t, end = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 6))
            phi, rate, last = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(r), n) for c in (3, 4, 5))
            off = phi - rate * (2 * h)
            on = last >= t[:, None] + h  # false where a node has no event
            own, mine = off[np.arange(len(r)), k], on[np.arange(len(r)), k]
            # Kind 0: (i, k, k); kind 1: (i, i, k).
            both = [np.where(on & mine[:, None], off * own[:, None], 0.0), np.where(on, off * off, 0.0)], [on & mine[:, None], on]
            key, group = np.unique(np.stack([r, k]), axis=1, return_inverse=True)
            group = group.ravel()
            sums, counts = (np.zeros((key.shape[1], 2, n)) for _ in range(2))
            for kind in (0, 1):
                np.add.at(sums[:, kind], group, both[0][kind])
                np.add.at(counts[:, kind], group, both[1][kind])
            ends = np.zeros(key.shape[1])
            ends[group] = end
            g, kind, node = (x.ravel() for x in np.indices(sums.shape))
            yield pa.RecordBatch.from_arrays([pa.array(key[0][g]), pa.array(i[node].astype(np.int32)), pa.array(np.where(kind == 0, key[1][g], node).astype(np.int32)), pa.array(key[1][g].astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(sums.ravel()), pa.array(counts.ravel()), pa.array(ends[g])], ["r", "i", "j", "k", "kind", "s", "n", "end_time"])

    # A batch adds up its events per realization and node before anything is shuffled.
    parts = rows.mapInArrow(added, "r bigint, i int, j int, k int, kind int, s double, n double, end_time double").where("n > 0")
    sums = parts.groupBy("r", "i", "j", "k", "kind").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.first("end_time").alias("end_time"))
    out = sums.join(symmetric.select("r", "i", "j", F.col("k").alias("jk")), ["r", "i", "j"], "left").fillna(0.0, ["jk"])
    return out.select("r", "i", "j", "k", "kind", F.try_divide(F.col("s") - F.col("n") * F.col("jk"), F.col("end_time")).alias("e"))


class Cumulants:
    """Mean intensities, covariance and skewness, averaged over realizations."""

    def __init__(self, data: EventData, h: float):
        n, count = data.n_nodes, data.n_realizations
        self.mean = mean_intensity(data)
        symmetric = written(_symmetric(covariance_terms(data, h)), "cumulant-terms")
        self.covariance, self.skewness = np.zeros((n, n)), np.zeros((n, n))
        for r in symmetric.groupBy("i", "j").agg(F.sum("c").alias("c")).collect():
            self.covariance[r["i"], r["j"]] = r["c"] / count
        for r in skewness_terms(data, h, symmetric).groupBy("i", "k", "kind", "j").agg(F.sum("e").alias("e")).collect():
            if r["kind"] == 0:
                self.skewness[r["i"], r["k"]] += 2 * r["e"] / (3 * count)
            else:
                self.skewness[r["k"], r["j"]] += r["e"] / (3 * count)


def theoretical(adjacency, baseline) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance and skewness of a stationary process with given kernel norms."""
    r = np.linalg.inv(np.eye(len(baseline)) - np.asarray(adjacency, float))
    mean = r @ np.asarray(baseline, float)
    cov = (r * mean) @ r.T
    return mean, cov, _skewness(r, mean, cov)


def _skewness(r, mean, cov):
    square = r * r
    return square @ cov.T + 2 * (r * cov) @ r.T - 2 * (square * mean) @ r.T


class CumulantMatching:
    """Kernel norms whose theoretical covariance and skewness match the estimated ones.

    kappa weighs the two parts; by default each is scaled by the other's size. penalty 'l1',
    'l2' or 'elasticnet' acts on the kernel norms with weight 1 / C. The gradient is analytic.
    """

    def __init__(self, h: float, penalty: str = "none", C: float = 1e3, ratio: float = 0.95, kappa: float | None = None, max_iter: int = 1000, tol: float = 1e-10):
        self.h, self.kappa, self.max_iter, self.tol = h, kappa, max_iter, tol
        self.l1 = {"l1": 1 / C, "elasticnet": ratio / C}.get(penalty, 0.0)
        self.l2 = {"l2": 1 / C, "elasticnet": (1 - ratio) / C}.get(penalty, 0.0)

    def prepare(self, cumulants) -> None:
        self.c = cumulants
        if self.kappa is None:
            k, c = (cumulants.skewness**2).sum(), (cumulants.covariance**2).sum()
            self.kappa_used = k / (k + c)
        else:
            self.kappa_used = self.kappa

    def loss_and_grad(self, flat) -> tuple[float, np.ndarray]:
        d = len(self.c.mean)
        r, mean, cov = np.reshape(flat, (d, d)), self.c.mean, self.c.covariance
        square = r * r
        dk = square @ cov.T + 2 * (r * cov) @ r.T - 2 * (square * mean) @ r.T - self.c.skewness
        dc = (r * mean) @ r.T - cov
        a, b = (1 - self.kappa_used), self.kappa_used
        value = a * (dk**2).mean() + b * (dc**2).mean()
        # Derivatives of the three terms of the skewness and of the covariance.
        g = 2 * a / d**2 * dk
        grad = 2 * r * (g @ cov) + 2 * cov * (g @ r) + 2 * (g.T @ (r * cov)) - 4 * r * mean * (g @ r) - 2 * (g.T @ (square * mean))
        f = 2 * b / d**2 * dc
        grad = grad + (f + f.T) @ (r * mean)
        if self.l1 or self.l2:
            try:
                inv = np.linalg.inv(r)
            except np.linalg.LinAlgError:
                return np.inf, grad.ravel()
            phi = np.eye(d) - inv
            value += self.l1 * np.abs(phi).sum() + self.l2 * (phi**2).sum()
            grad = grad + inv.T @ (self.l1 * np.sign(phi) + 2 * self.l2 * phi) @ inv.T
        return float(value), grad.ravel()

    def start(self) -> np.ndarray:
        return symmetric_root(self.c.covariance) @ np.diag(1 / np.sqrt(self.c.mean))

    def fit(self, data: EventData | None = None, cumulants=None, start=None, solver: str = "bfgs", step: float = 0.01) -> CumulantMatching:
        """Match the cumulants of data, or those given. start is a matrix of 1 / (I - norms)."""
        self.prepare(cumulants if cumulants is not None else Cumulants(data, self.h))
        x = (self.start() if start is None else np.asarray(start, float)).ravel()
        if solver == "bfgs":
            x = minimise(self.loss_and_grad, x, max_iter=self.max_iter, tol=self.tol)
        else:
            x = descend(self.loss_and_grad, x, solver, step, self.max_iter)
        self.solution = x.reshape(len(self.c.mean), -1)
        self.objective = self.loss_and_grad(x)[0]
        return self

    @property
    def adjacency(self) -> np.ndarray:
        return np.eye(len(self.solution)) - np.linalg.inv(self.solution)

    @property
    def baseline(self) -> np.ndarray:
        return np.linalg.inv(self.solution) @ self.c.mean


def descend(f, x, method: str = "adam", step: float = 0.01, max_iter: int = 1000) -> np.ndarray:
    """Plain and adaptive gradient descents; returns the best point met."""
    if method not in ("adam", "adagrad", "rmsprop", "adadelta", "sgd", "momentum"):
        raise ValueError(f"unknown method {method}")
    x = np.asarray(x, float).copy()
    m, v, w = np.zeros_like(x), np.zeros_like(x), np.zeros_like(x)
    best, best_value = x.copy(), np.inf
    for i in range(1, max_iter + 1):
        value, g = f(x)
        if np.isfinite(value) and value < best_value:
            best, best_value = x.copy(), value
        if method == "adam":
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            x = x - step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        elif method == "adagrad":
            v = v + g * g
            x = x - step * g / (np.sqrt(v) + 1e-10)
        elif method == "rmsprop":
            v = 0.99 * v + 0.01 * g * g
            x = x - step * g / (np.sqrt(v) + 1e-8)
        elif method == "adadelta":
            v = 0.9 * v + 0.1 * g * g
            d = np.sqrt(w + 1e-6) / np.sqrt(v + 1e-6) * g
            w = 0.9 * w + 0.1 * d * d
            x = x - step * d
        else:
            m = (0.9 if method == "momentum" else 0.0) * m + g
            x = x - step * m
    return best
