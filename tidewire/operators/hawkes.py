"""Intensities, compensators, losses and gradients of exponential Hawkes models."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.data import EventData
from tidewire.operators.scan import decayed_sums, previous, ranks
from tidewire.operators.weighted import Sums, dense, iterated, task_sums, weighted_sums


def _rows(a: np.ndarray) -> Column:
    return F.array(*(F.array(*(F.lit(float(x)) for x in row)) for row in np.asarray(a)))


def dot(phi: Column | str, weights: np.ndarray, node: Column | str = "node") -> Column:
    """weights[node] . phi, the weights as literals of the plan; for weights of at most
    MOST_LITERALS, see weighed."""
    own = F.element_at(_rows(weights), F.col(node) + 1 if isinstance(node, str) else node + 1)
    return F.aggregate(F.zip_with(phi, own, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)


#: Weights that may stand in a plan; more are sent to the tasks as an array.
MOST_LITERALS = 4096


def weighed(rows: DataFrame, name: str, weights: np.ndarray, base: Column, phi: str = "phi", node: str = "node") -> DataFrame:
    """rows with name = base + weights[node] . phi. Many weights don't become literals but go
    to the tasks once, where batches are multiplied in numpy."""
    if np.size(weights) <= MOST_LITERALS:
        return rows.withColumn(name, base + dot(phi, weights, node))
    sent, width = rows.sparkSession.sparkContext.broadcast(np.asarray(weights, float)), np.shape(weights)[1]
    based = rows.withColumn(name, base)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = b.schema.get_field_index(name), b.column(b.schema.get_field_index(node)).to_numpy(zero_copy_only=False).astype(np.int64)
            x = b.column(at).to_numpy(zero_copy_only=False) + np.einsum("kf,kf->k", dense(b, phi, width), sent.value[v])
            yield b.set_column(at, name, pa.array(x))

    return based.mapInArrow(added, based.schema)


def by_node(values, node: Column | str = "node") -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col(node) + 1 if isinstance(node, str) else node + 1)


@dataclass
class ExpParameters:
    """Baselines mu[i], and alpha[i, j, u] with the decay of each; decays may differ by pair.

    alpha[i, j] of two axes is one exponential with decays a number or a matrix; of three axes
    a sum with a vector of decays.
    """

    mu: np.ndarray
    alpha: np.ndarray
    decays: np.ndarray

    def __post_init__(self) -> None:
        self.mu, self.alpha = np.asarray(self.mu, float), np.asarray(self.alpha, float)
        d = np.asarray(self.decays, float)
        if self.alpha.ndim == 2:
            self.alpha = self.alpha[:, :, None]
            d = np.broadcast_to(d.reshape(d.shape + (1,)) if d.ndim == 2 else d.reshape(1, 1, -1), self.alpha.shape)
        self.pair_decays = np.broadcast_to(d, self.alpha.shape)
        if (self.pair_decays <= 0).any():
            raise ValueError("decays must be positive")
        self.rates = sorted(set(self.pair_decays.ravel().tolist()))

    @property
    def n_nodes(self) -> int:
        return len(self.mu)

    def weights(self) -> np.ndarray:
        """Per target the weight of every feature of decayed_sums over the rates."""
        n, u = self.n_nodes, len(self.rates)
        out = np.zeros((n, n, u))
        at = np.searchsorted(self.rates, self.pair_decays)
        i, j, _ = np.indices(self.alpha.shape)
        np.add.at(out, (i, j, at), self.alpha)
        return out.reshape(n, -1)

    def compensator_weights(self) -> np.ndarray:
        """Weights over the rates and a last rate 0: alpha * (count - feature / rate)."""
        n, u = self.n_nodes, len(self.rates)
        w = self.weights().reshape(n, n, u)
        return np.concatenate([-w / np.array(self.rates), w.sum(axis=2, keepdims=True)], axis=2).reshape(n, -1)


def exp_features(data: EventData, decays: list[float]) -> DataFrame:
    """events with phi: the feature of every node and decay just before each event."""
    return decayed_sums(data.events, data.n_nodes, decays)


def intensities(data: EventData, p: ExpParameters) -> DataFrame:
    """events with intensity, of the event's own node just before it."""
    f = exp_features(data, p.rates)
    return weighed(f, "intensity", p.weights(), by_node(p.mu)).drop("phi")


def intensity_grid(data: EventData, p: ExpParameters, step: float) -> DataFrame:
    """Intensities of all nodes at the multiples of step before each end time and at all
    events, there just before the event: r, t, node, intensity; equal times once."""
    grid = data.ends.select("r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("end_time") / F.lit(step)) - 1, F.lit(0)))).alias("k")).select("r", (F.col("k") * F.lit(step)).alias("t"))
    points = grid.unionByName(data.events.select("r", "t")).distinct().withColumn("node", F.lit(None).cast("int"))
    rows = data.events.select("r", "node", "t").unionByName(points.select("r", "node", "t"))
    f = decayed_sums(rows, data.n_nodes, p.rates).where("node is null").drop("node")
    at = f.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(data.n_nodes - 1))))
    return weighed(at, "intensity", p.weights(), by_node(p.mu)).select("r", "t", "node", "intensity")


def compensators(data: EventData, p: ExpParameters) -> DataFrame:
    """events with compensator: the integral of the own node's intensity up to the event."""
    f = decayed_sums(data.events, data.n_nodes, [*p.rates, 0.0])
    return weighed(f, "compensator", p.compensator_weights(), by_node(p.mu) * F.col("t")).drop("phi")


def residuals(compensated: DataFrame) -> DataFrame:
    """Time-changed gaps: differences of the compensator between successive events of a node.

    The first event of a realization and node gives none.
    """
    gaps = previous(compensated, ["r", "node"], ["t", "eid"], "compensator").where("before is not null")
    return gaps.withColumn("residual", F.col("compensator") - F.col("before")).drop("before")


def qq_points(gaps: DataFrame) -> DataFrame:
    """Sorted residuals of every node against exponential quantiles: node, k, residual, expected."""
    k = F.col("rank") - 1
    return ranks(gaps.select("node", "residual"), "node", ["residual"]).select("node", k.cast("int").alias("k"), "residual", (-F.log1p(-(k + 0.5) / F.col("total"))).alias("expected"))


def residual_summary(gaps: DataFrame) -> DataFrame:
    """Per node: n, mean, variance, distance of the empirical distribution from the unit
    exponential, and correlation of successive residuals."""
    cdf = 1 - F.exp(-F.col("residual"))
    far = F.greatest(F.abs(F.col("rank") / F.col("total") - cdf), F.abs(cdf - (F.col("rank") - 1) / F.col("total")))
    near = previous(gaps, ["r", "node"], ["t", "eid"], "residual")
    placed = ranks(near.select("node", "residual", "before"), "node", ["residual"]).withColumn("far", far)
    return placed.groupBy("node").agg(F.count("*").alias("n"), F.avg("residual").alias("mean"), F.var_samp("residual").alias("variance"), F.max("far").alias("ks"), F.corr("residual", "before").alias("lag1"))


def source_integrals(data: EventData, decays: list[float]) -> np.ndarray:
    """[v, u]: sum over events of v of 1 - exp(-decay * (end_time - t))."""
    parts = [F.sum(1 - F.exp(F.lit(-float(d)) * (F.col("end_time") - F.col("t")))).alias(f"u{i}") for i, d in enumerate(decays)]
    out = np.zeros((data.n_nodes, len(decays)))
    for r in data.events.join(data.ends, "r").groupBy("node").agg(*parts).collect():
        out[r["node"]] = [r[f"u{i}"] for i in range(len(decays))]
    return out


class LogLikelihood:
    """Negative log-likelihood per event, and its gradient, for fixed decays.

    Features are built once and kept as a table; each evaluation is one aggregate over it.
    """

    def __init__(self, data: EventData, decays):
        self.data, self.decays = data, decays

    @cached_property
    def features(self):
        rates = ExpParameters(np.zeros(self.data.n_nodes), self._alpha(None), self.decays).rates
        return iterated(exp_features(self.data, rates).select("node", "phi"), self.data.n_jumps, self.data.n_nodes * len(rates))  # read from the scan's table

    def _alpha(self, flat) -> np.ndarray:
        n = self.data.n_nodes
        d = np.asarray(self.decays, float)
        shape = (n, n) if d.ndim != 1 else (n, n, len(d))
        return np.zeros(shape) if flat is None else np.reshape(flat, shape)

    def parameters(self, coeffs) -> ExpParameters:
        """coeffs: the baselines, then alpha row by row."""
        n = self.data.n_nodes
        coeffs = np.asarray(coeffs, float)
        return ExpParameters(coeffs[:n], self._alpha(coeffs[n:]), self.decays)

    @cached_property
    def _integrals(self) -> np.ndarray:
        p = ExpParameters(np.zeros(self.data.n_nodes), self._alpha(None), self.decays)
        return source_integrals(self.data, p.rates)

    def sums(self, p: ExpParameters) -> Sums:
        return weighted_sums(self.features, p.mu, p.weights())

    def loss(self, coeffs) -> float:
        return self.loss_and_grad(coeffs)[0]

    def grad(self, coeffs) -> np.ndarray:
        return self.loss_and_grad(coeffs)[1]

    def loss_and_grad(self, coeffs) -> tuple[float, np.ndarray]:
        p, d = self.parameters(coeffs), self.data
        n, u = d.n_nodes, len(p.rates)
        s = self.sums(p)
        w = p.weights().reshape(n, n, u)
        whole = (p.mu.sum() - n) * d.total_time + (w * self._integrals).sum() - s.logs
        loss = math.inf if s.bad or (np.asarray(coeffs) < 0).any() else whole / d.n_jumps
        wide = (self._integrals[None] - s.over.reshape(n, n, u)) / d.n_jumps
        at = np.searchsorted(p.rates, p.pair_decays)
        i, j, _ = np.indices(p.alpha.shape)
        return loss, np.r_[(d.total_time - s.inverse) / d.n_jumps, wide[i, j, at].ravel()]

    def hessian(self, coeffs, eps: float = 1e-6) -> np.ndarray:
        """Finite differences of the gradient; two evaluations per coefficient."""
        c = np.asarray(coeffs, float)
        cols = []
        for i in range(len(c)):
            e = np.zeros_like(c)
            e[i] = eps
            cols.append((self.grad(c + e) - self.grad(c - e)) / (2 * eps))
        h = np.stack(cols)
        return (h + h.T) / 2

    def hessian_norm(self, coeffs, v) -> float:
        return float(np.asarray(v) @ self.hessian(coeffs) @ np.asarray(v))


@dataclass
class LeastSquaresStatistics:
    """Over features f = (node, decay): event_sums[i, f] over the events of i, integrals[f],
    products[f, g]; counts per node."""

    rates: list[float]
    event_sums: np.ndarray
    integrals: np.ndarray
    products: np.ndarray
    counts: np.ndarray
    total_time: float

    def __add__(self, other: LeastSquaresStatistics) -> LeastSquaresStatistics:
        """The statistics of both sets of realizations: all of them are sums."""
        if self.rates != other.rates:
            raise ValueError("the decays differ")
        return LeastSquaresStatistics(self.rates, *(getattr(self, f) + getattr(other, f) for f in ("event_sums", "integrals", "products", "counts", "total_time")))


def least_squares_statistics(data: EventData, rates: list[float]) -> LeastSquaresStatistics:
    """All that the least-squares loss needs, from one scan of the events.

    The integral of a product needs no second look at pairs of events: between jumps a product
    of states decays by the sum of the rates, so the integral telescopes into event sums, the
    products of simultaneous jumps and the states at the end times.
    """
    n, u = data.n_nodes, len(rates)
    width = n * u
    f = exp_features(data, rates).select("r", "node", "t", "phi")

    def partial(b):
        node = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        phi = dense(b, "phi", width)
        out = np.zeros((n, width))
        for i in range(n):
            out[i] = phi[node == i].sum(axis=0)
        return out.ravel()

    sums = task_sums(f.select("node", "phi"), n * width, partial).reshape(n, width)
    # Simultaneous jumps: products of the numbers of events of two nodes at one instant.
    at_once = f.groupBy("r", "t", "node").agg(F.count("*").cast("double").alias("c"))
    together = at_once.groupBy("r", "t").agg(F.collect_list(F.struct("node", "c")).alias("x"))  # at most one entry per node
    pairs = together.select(F.explode("x").alias("a"), "x").select("a", F.explode("x").alias("b"))
    ties = np.zeros((n, n))
    for r in pairs.groupBy(F.col("a.node").alias("i"), F.col("b.node").alias("j")).agg(F.sum(F.col("a.c") * F.col("b.c")).alias("s")).collect():
        ties[r["i"], r["j"]] = r["s"]
    # The states at the end times, per realization.
    joined = data.events.join(data.ends, "r")
    state = joined.groupBy("r", "node").agg(*(F.sum(F.lit(float(b)) * F.exp(F.lit(-float(b)) * (F.col("end_time") - F.col("t")))).alias(f"s{i}") for i, b in enumerate(rates)))
    ends = state.groupBy("r").agg(F.collect_list(F.struct("node", F.array(*(f"s{i}" for i in range(u))).alias("s"))).alias("x"))

    def outer(b):
        e = np.zeros((width, width))
        for lists in b.column(0).to_pylist():
            v = np.zeros((n, u))
            for x in lists:
                v[x["node"]] = x["s"]
            e += np.outer(v.ravel(), v.ravel())
        return e.ravel()

    left = task_sums(ends.select("x"), width * width, outer).reshape(width, width)
    rate = np.tile(np.array(rates), n)
    node = np.repeat(np.arange(n), u)
    cross = rate[:, None] * sums[node][:, :]  # [f, g]: rate_f * sum over events of f's node of g
    products = (cross + cross.T + np.outer(rate, rate) * ties[node][:, node] - left) / (rate[:, None] + rate[None, :])
    integrals = source_integrals(data, rates).ravel()
    return LeastSquaresStatistics(rates, sums, integrals, products, np.array(data.node_counts, float), data.total_time)


class LeastSquares:
    """Least-squares loss per event: sum over nodes of the integral of the squared intensity
    less twice its sum over events. After one pass over the data all is linear algebra."""

    def __init__(self, data: EventData, decays):
        self.data, self.decays = data, decays

    def _alpha(self, flat):
        n = self.data.n_nodes
        d = np.asarray(self.decays, float)
        shape = (n, n) if d.ndim != 1 else (n, n, len(d))
        return np.zeros(shape) if flat is None else np.reshape(flat, shape)

    @cached_property
    def statistics(self) -> LeastSquaresStatistics:
        p = ExpParameters(np.zeros(self.data.n_nodes), self._alpha(None), self.decays)
        return least_squares_statistics(self.data, p.rates)

    def extended(self, data: EventData) -> LeastSquares:
        """The model over further realizations too; only these are read."""
        out = LeastSquares(self.data.with_realizations(data), self.decays)
        out.__dict__["statistics"] = self.statistics + LeastSquares(data, self.decays).statistics
        return out

    def loss_and_grad(self, coeffs) -> tuple[float, np.ndarray]:
        s, n = self.statistics, self.data.n_nodes
        c = np.asarray(coeffs, float)
        p = ExpParameters(c[:n], self._alpha(c[n:]), self.decays)
        w = p.weights()
        quad = (s.products + s.products.T) / 2
        loss = (p.mu**2).sum() * s.total_time + 2 * (p.mu * (w @ s.integrals)).sum() + np.einsum("if,fg,ig->", w, s.products, w) - 2 * (p.mu @ s.counts + (w * s.event_sums).sum())
        g_mu = 2 * (p.mu * s.total_time + w @ s.integrals - s.counts)
        g_w = 2 * (p.mu[:, None] * s.integrals + w @ quad - s.event_sums)
        at = np.searchsorted(p.rates, p.pair_decays)
        i, j, _ = np.indices(p.alpha.shape)
        g_a = g_w.reshape(n, n, -1)[i, j, at]
        jumps = s.counts.sum()
        return loss / jumps, np.r_[g_mu, g_a.ravel()] / jumps

    def loss(self, coeffs) -> float:
        return self.loss_and_grad(coeffs)[0]

    def grad(self, coeffs) -> np.ndarray:
        return self.loss_and_grad(coeffs)[1]

    def hessian(self, coeffs=None) -> np.ndarray:
        """Constant: the loss is a quadratic form."""
        size = self.data.n_nodes + self._alpha(None).size
        zero = self.grad(np.zeros(size))
        return np.stack([self.grad(e) - zero for e in np.eye(size)])

    def hessian_norm(self, coeffs, v) -> float:
        return float(np.asarray(v) @ self.hessian() @ np.asarray(v))


class PeriodicLeastSquares:
    """Least squares of sums of exponentials with a baseline of equal steps in each period.

    Coefficients: the baseline steps node by node, then alpha[i, j, u].
    """

    def __init__(self, data: EventData, decays, n_baselines: int, period: float):
        if n_baselines < 1 or period <= 0:
            raise ValueError("n_baselines and period must be positive")
        self.data, self.decays, self.k, self.period = data, [float(x) for x in decays], n_baselines, float(period)

    @cached_property
    def statistics(self):
        """The statistics of the constant case; per step: its length, features' integrals, events."""
        d, step, k = self.data, self.period / self.k, self.k
        base = least_squares_statistics(d, self.decays)
        # Pieces of time between step edges, from each event to its end time.
        joined = d.events.join(d.ends, "r")
        piece = joined.select("node", "t", "end_time", F.explode(F.sequence(F.floor(F.col("t") / step), F.greatest(F.ceil(F.col("end_time") / step) - 1, F.floor(F.col("t") / step)))).alias("p"))
        a, b = F.greatest(F.col("p") * F.lit(step), F.col("t")) - F.col("t"), F.least((F.col("p") + 1) * F.lit(step), F.col("end_time")) - F.col("t")
        sums = piece.groupBy("node", F.pmod("p", F.lit(k)).alias("s")).agg(*(F.sum(F.when(b > a, F.exp(F.lit(-x) * a) - F.exp(F.lit(-x) * b)).otherwise(0.0)).alias(f"u{i}") for i, x in enumerate(self.decays)))
        inside = np.zeros((k, d.n_nodes, len(self.decays)))
        for r in sums.collect():
            inside[r["s"], r["node"]] = [r[f"u{i}"] for i in range(len(self.decays))]
        lengths = np.zeros(k)
        for i in range(k):
            whole = F.floor(F.col("end_time") / self.period)
            rest = F.col("end_time") - whole * self.period
            lengths[i] = d.ends.agg(F.sum(whole * step + F.least(F.greatest(rest - i * step, F.lit(0.0)), F.lit(step)))).first()[0] or 0.0
        counts = np.zeros((d.n_nodes, k))
        s = F.least(F.floor(F.pmod("t", F.lit(self.period)) / self.period * k), F.lit(k - 1))
        for r in d.events.groupBy("node", s.alias("s")).count().collect():
            counts[r["node"], r["s"]] = r["count"]
        return base, lengths, inside.reshape(k, -1), counts

    def loss_and_grad(self, coeffs) -> tuple[float, np.ndarray]:
        base, lengths, inside, counts = self.statistics
        n, k = self.data.n_nodes, self.k
        c = np.asarray(coeffs, float)
        b, w = c[: n * k].reshape(n, k), c[n * k :].reshape(n, -1)
        quad = (base.products + base.products.T) / 2
        loss = (b**2 @ lengths).sum() + 2 * (b * (w @ inside.T)).sum() + np.einsum("if,fg,ig->", w, quad, w) - 2 * ((b * counts).sum() + (w * base.event_sums).sum())
        g_b = 2 * (b * lengths + w @ inside.T - counts)
        g_w = 2 * (b @ inside + w @ quad - base.event_sums)
        return loss / base.counts.sum(), np.r_[g_b.ravel(), g_w.ravel()] / base.counts.sum()

    def loss(self, coeffs) -> float:
        return self.loss_and_grad(coeffs)[0]

    def grad(self, coeffs) -> np.ndarray:
        return self.loss_and_grad(coeffs)[1]
