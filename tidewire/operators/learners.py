"""Fits of Hawkes processes. Each builds its features in Spark once; what iterates is one
aggregate per step (weighted_sums) and algebra of the size of the parameters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.data import EventData
from tidewire.functions.prox import ProxNuclear, soft
from tidewire.functions.special import erf, minimise, relative_distance
from tidewire.operators import bands, hawkes
from tidewire.operators.scan import decayed_sums
from tidewire.operators.weighted import Sums, iterated, task_sums, weighted_sums
from tidewire.session import written


class _Fit:
    """Coefficients with the history of their iterations, and whether the stop rule was met."""

    def __init__(self) -> None:
        self.history: list[dict] = []
        self.converged = False

    def history_table(self, spark) -> DataFrame:
        return spark.createDataFrame([{k: float(v) for k, v in h.items()} for h in self.history])


class Expectation(_Fit):
    """Nonparametric expectation-maximisation with piecewise constant kernels.

    edges bound the bins. kernel[u, v, m] is the value of the kernel of v on u in bin m. An
    update divides by the number of events of v and the bin's width, without a correction at
    the end of a realization.
    """

    def __init__(self, edges, max_iter: int = 100, tol: float = 1e-5):
        super().__init__()
        self.edges, self.max_iter, self.tol = np.asarray(edges, float), max_iter, tol

    @classmethod
    def uniform(cls, support: float, size: int, **options):
        return cls(np.linspace(0, support, size + 1), **options)

    def prepare(self, data: EventData) -> None:
        self.data = data
        counts = written(bands.bin_counts(data, self.edges).select("node", "phi"), "em-counts")
        self.counts = iterated(counts, data.n_jumps, data.n_nodes * (len(self.edges) - 1))

    def step(self, mu: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One update of baseline and kernel."""
        n, m = self.data.n_nodes, len(self.edges) - 1
        s = weighted_sums(self.counts, mu, kernel.reshape(n, n * m))
        events = np.maximum(np.array(self.data.node_counts, float), 1)
        new = kernel * s.over.reshape(n, n, m) / (events[None, :, None] * np.diff(self.edges))
        return mu * s.inverse / self.data.total_time, new

    def fit(self, data: EventData, mu, kernel) -> Expectation:
        """Iterate from a start, which must be given."""
        self.prepare(data)
        self.mu, self.kernel = np.asarray(mu, float), np.asarray(kernel, float)
        for i in range(self.max_iter):
            new = self.step(self.mu, self.kernel)
            far = max(relative_distance(new[0], self.mu), relative_distance(new[1], self.kernel))
            self.mu, self.kernel = new
            self.history.append({"n_iter": i + 1, "rel": far})
            self.converged = far <= self.tol
            if self.converged:
                break
        return self

    def norms(self) -> np.ndarray:
        return (self.kernel * np.diff(self.edges)).sum(axis=2)

    def primitives(self) -> np.ndarray:
        return np.cumsum(self.kernel * np.diff(self.edges), axis=2)

    def kernel_values(self, i: int, j: int, x) -> np.ndarray:
        """The kernel on bins that are closed on the right, 0 outside the open support."""
        x = np.asarray(x, float)
        at = np.clip(np.searchsorted(self.edges, x) - 1, 0, len(self.edges) - 2)
        return np.where((x > 0) & (x < self.edges[-1]), self.kernel[i, j, at], 0.0)

    def score(self, data: EventData | None = None) -> float:
        return piecewise_score(data or self.data, self.edges, self.mu, self.kernel)

    def compensators(self, data: EventData | None = None) -> DataFrame:
        return piecewise_compensators(data or self.data, self.edges, self.mu, self.kernel)


def piecewise_score(data: EventData, edges, mu, kernel) -> float:
    """Log-likelihood per event of piecewise constant kernels over the strict past; minus
    infinity if an intensity isn't positive."""
    n, edges = data.n_nodes, np.asarray(edges, float)
    f = bands.bin_counts(data, edges, strict=True)
    s = weighted_sums(f, np.asarray(mu, float), np.asarray(kernel, float).reshape(n, -1))
    exposure = bin_exposure(data, edges)
    whole = np.sum(mu) * data.total_time + np.einsum("uvm,vm->", kernel, exposure)
    return -math.inf if s.bad else (n * data.total_time - whole + s.logs) / data.n_jumps


def bin_exposure(data: EventData, edges) -> np.ndarray:
    """[v, m]: how long bin m lies between an event of v and its end time, summed."""
    rest = F.col("end_time") - F.col("t")
    parts = [F.sum(F.greatest(F.least(rest, F.lit(float(b))) - F.lit(float(a)), F.lit(0.0))).alias(f"m{i}") for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    out = np.zeros((data.n_nodes, len(edges) - 1))
    for r in data.events.join(data.ends, "r").groupBy("node").agg(*parts).collect():
        out[r["node"]] = [r[f"m{i}"] for i in range(len(edges) - 1)]
    return out


def piecewise_compensators(data: EventData, edges, mu, kernel) -> DataFrame:
    """events with compensator, the integral of the own node's piecewise intensity.

    The kernel's integral up to a lag splits at the edges: within the support it is counted by
    pairs in the band, beyond it every earlier event of v adds the whole norm.
    """
    edges, kernel, n = np.asarray(edges, float), np.asarray(kernel, float), data.n_nodes
    p = bands.band_pairs(data.events, data.events, float(edges[-1])).where(f"lag > 0 and lag < {float(edges[-1])!r}")
    parts = [F.greatest(F.least(F.col("lag"), F.lit(float(b))) - F.lit(float(a)), F.lit(0.0)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    inside = bands.dense_features(data, p, [*parts, F.lit(1.0)])
    past = decayed_sums(data.events, n, [0.0]).select("eid", F.col("phi").alias("past"))
    m = len(edges) - 1
    norms = (kernel * np.diff(edges)).sum(axis=2)
    w = np.concatenate([kernel, -norms[:, :, None]], axis=2).reshape(n, n * (m + 1))
    joined = inside.join(past, "eid")
    return joined.withColumn("compensator", hawkes.by_node(mu) * F.col("t") + hawkes.dot("phi", w) + hawkes.dot("past", norms)).drop("phi", "past")


class SparseLowRank(_Fit):
    """Exponential kernels of one decay with an l1 and a nuclear penalty: EM steps inside
    the alternating direction method of multipliers.

    C weighs the penalties down; ratio is the part of the l1 one.
    """

    def __init__(self, decay: float, C: float = 1e3, ratio: float = 0.5, max_iter: int = 50, tol: float = 1e-5, rho: float = 0.1, em_max_iter: int = 30, em_tol: float | None = None, record_every: int = 1):
        super().__init__()
        self.decay, self.rho, self.max_iter, self.tol = decay, rho, max_iter, tol
        self.l1, self.nuclear = ratio / C, (1 - ratio) / C
        self.em_max_iter, self.em_tol, self.record_every = em_max_iter, em_tol, record_every

    def prepare(self, data: EventData) -> None:
        self.data = data
        self.features = iterated(hawkes.exp_features(data, [self.decay]).select("node", "phi"), data.n_jumps, data.n_nodes)  # read from the scan's table
        self.integrals = hawkes.source_integrals(data, [self.decay])[:, 0]

    def sums(self, mu, a) -> Sums:
        return weighted_sums(self.features, mu, a)

    def update(self, mu, a, pull) -> tuple[np.ndarray, np.ndarray]:
        """One EM step; pull is u1 - z1 + u2 - z2."""
        s = self.sums(mu, a)
        b = self.integrals[None, :] + self.rho * pull
        c = a * s.over
        return mu * s.inverse / self.data.total_time, (-b + np.sqrt(b * b + 8 * self.rho * c)) / (4 * self.rho)

    def fit(self, data: EventData, mu, adjacency) -> SparseLowRank:
        self.prepare(data)
        mu, a = np.maximum(np.asarray(mu, float), 1e-12), np.maximum(np.asarray(adjacency, float), 0)
        n = data.n_nodes
        z1, z2, u1, u2 = (np.zeros((n, n)) for _ in range(4))
        shrink, last = ProxNuclear(self.nuclear, n_rows=n), 0.1
        for i in range(self.max_iter):
            old = mu, a
            for _ in range(self.em_max_iter):
                new = self.update(mu, a, u1 - z1 + u2 - z2)
                near = max(relative_distance(new[0], mu), relative_distance(new[1], a))
                mu, a = new
                if near < (last * 1e-2 if self.em_tol is None else self.em_tol):
                    break
            z1 = shrink((a + u1).ravel(), 1 / self.rho).reshape(n, n)
            z2 = soft(a + u2, self.l1 / self.rho)
            u1, u2 = u1 + a - z1, u2 + a - z2
            if (i + 1) % self.record_every == 0 or i + 1 == self.max_iter:
                last = max(relative_distance(mu, old[0]), relative_distance(a, old[1]))
                self.history.append({"n_iter": i + 1, "rel": last})
                self.converged = last <= self.tol and i > 5
                if self.converged:
                    break
        self.mu, self.adjacency = mu, a
        return self

    def score(self, data: EventData | None = None) -> float:
        model = hawkes.LogLikelihood(data or self.data, self.decay)
        return -model.loss(np.r_[self.mu, self.adjacency.ravel()])

    def objective(self) -> float:
        return -self.score() + self.l1 * np.abs(self.adjacency).sum() + self.nuclear * np.linalg.svd(self.adjacency, compute_uv=False).sum()


class GaussianMixture(_Fit):
    """Kernels as sums of normal densities with means m * top / M, by EM with a group penalty
    and a proximal step. Amplitudes may end below 0."""

    def __init__(self, max_mean: float, n_gaussians: int = 5, step_size: float = 1e-7, C: float = 1e3, ratio: float = 0.5, max_iter: int = 50, tol: float = 1e-5, em_max_iter: int = 30, em_tol: float | None = None, record_every: int = 1):
        super().__init__()
        self.means = np.arange(n_gaussians) * max_mean / n_gaussians
        self.std = max_mean / (n_gaussians * math.pi)
        self.lasso, self.group, self.step_size = ratio / C, (1 - ratio) / C, step_size
        self.max_iter, self.tol, self.em_max_iter, self.em_tol, self.record_every = max_iter, tol, em_max_iter, em_tol, record_every

    def prepare(self, data: EventData) -> None:
        self.data = data
        features = written(bands.gaussian_features(data, self.means, self.std).select("node", "phi"), "gaussian-features")
        self.features = iterated(features, data.n_jumps, data.n_nodes * len(self.means))
        n, m, means, std = data.n_nodes, len(self.means), self.means, self.std

        def partial(b):
            node, rest = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).to_numpy(zero_copy_only=False)
            part = (erf((rest[:, None] - means) / (std * math.sqrt(2))) + erf(means / (std * math.sqrt(2)))) / 2
            out = np.zeros((n, m))
            np.add.at(out, node, part)
            return out.ravel()

        rest = data.events.join(data.ends, "r").select("node", (F.col("end_time") - F.col("t")).alias("rest"))
        self.integrals = task_sums(rest, n * m, partial).reshape(n, m)

    def iterate(self, mu, a) -> tuple[np.ndarray, np.ndarray]:
        """EM steps, then the proximal step, on mu[u] and a[u, v, m]."""
        n, m = self.data.n_nodes, len(self.means)
        old = a
        for _ in range(self.em_max_iter):
            s = weighted_sums(self.features, mu, a.reshape(n, n * m))
            c = -a * s.over.reshape(n, n, m)
            norm = np.linalg.norm(a, axis=2, keepdims=True)
            lead = np.where(norm > 0, self.group / np.where(norm > 0, norm, 1), 0.0)
            b = self.integrals[None] + self.lasso
            safe = np.where(lead > 0, lead, 1.0)
            a = np.where(lead > 0, (-b + np.sqrt(b * b - 4 * lead * c)) / (2 * safe), -c / b)
            mu = mu * s.inverse / self.data.total_time
        gradient = self.integrals[None] + np.where(old != 0, c / np.where(old != 0, old, 1), 0.0)
        a = soft(a - self.step_size * gradient, self.step_size * self.lasso)
        norm = np.linalg.norm(a, axis=2, keepdims=True)
        return mu, np.where(norm > self.step_size * self.group, a * np.maximum(1 - self.step_size * self.group / np.where(norm > 0, norm, 1), 0), 0.0)

    def fit(self, data: EventData, mu, amplitudes) -> GaussianMixture:
        self.prepare(data)
        mu, a, last = np.asarray(mu, float), np.asarray(amplitudes, float), 0.1
        for i in range(self.max_iter):
            new = self.iterate(mu, a)
            far = max(relative_distance(new[0], mu), relative_distance(new[1], a))
            mu, a = new
            if (i + 1) % self.record_every == 0 or i + 1 == self.max_iter:
                self.history.append({"n_iter": i + 1, "rel": far})
                self.converged = far < (last * 1e-2 if self.em_tol is None else self.em_tol) or (far <= self.tol and i > 5)
                if self.converged:
                    break
                last = far
        self.mu, self.amplitudes = mu, a
        return self

    def norms(self) -> np.ndarray:
        return self.amplitudes.sum(axis=2)

    def kernel_values(self, i: int, j: int, x) -> np.ndarray:
        z = (np.asarray(x, float)[..., None] - self.means) / self.std
        return (self.amplitudes[i, j] * np.exp(-z * z / 2)).sum(-1) / (self.std * math.sqrt(2 * math.pi))


#: Rounds of a shared basis before the first jump.
PLAIN_ROUNDS = 10


def _extrapolated(first: tuple, second: tuple, third: tuple, reach: float = math.inf) -> tuple[tuple, float] | None:
    """Where three points in a row lead to, by the squared extrapolation of Varadhan and Roland,
    and its length, at most reach and shortened until what is above 0 stays so; None if that
    leaves nothing of it."""
    flat = [np.concatenate([np.ravel(x) for x in point]) for point in (first, second, third)]
    d, bend = flat[1] - flat[0], flat[2] - 2 * flat[1] + flat[0]
    size = min(float(np.linalg.norm(d) / max(np.linalg.norm(bend), 1e-300)), reach)
    while size > 1.01:
        y = flat[0] + 2 * size * d + size * size * bend
        if np.isfinite(y).all() and (y[flat[2] > 0] > 0).all():
            y = np.where(flat[2] > 0, y, 0.0)
            return tuple(part.reshape(x.shape) for part, x in zip(np.split(y, np.cumsum([x.size for x in third])[:-1]), third, strict=True)), size
        size = (size + 1) / 2
    return None


class SharedBasis(_Fit):
    """Kernels as positive mixtures of a few common basis functions on a grid, which are
    estimated with them under a smoothness penalty 1 / C."""

    def __init__(self, support: float, size: int, C: float = 0.1, max_iter: int = 100, tol: float = 1e-5, ode_max_iter: int = 100, ode_tol: float = 1e-5):
        super().__init__()
        self.support, self.size, self.dt, self.alpha = support, size, support / size, 1 / C
        self.max_iter, self.tol, self.ode_max_iter, self.ode_tol = max_iter, tol, ode_max_iter, ode_tol

    def prepare(self, data: EventData) -> None:
        self.data = data
        counts = written(bands.step_counts(data, self.dt, self.size).select("node", "phi"), "basis-counts")
        self.counts = iterated(counts, data.n_jumps, data.n_nodes * self.size, repeated=True)
        self.exposure = bin_exposure(data, np.arange(self.size + 1) * self.dt)
        late = [F.sum((F.col("t") <= F.col("end_time") - F.lit(m * self.dt)).cast("double")).alias(f"m{m}") for m in range(self.size)]
        self.early = np.zeros((data.n_nodes, self.size))
        for r in data.events.join(data.ends, "r").groupBy("node").agg(*late).collect():
            self.early[r["node"]] = [r[f"m{m}"] for m in range(self.size)]

    def _smoothed(self, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """One basis function from its linear and constant terms, by red-black sweeps from 0.

        Entry m is the root above 0 of (4k + c) x**2 - 2k (sum of both neighbours) x = d. Even
        entries see only odd ones, so each half of a sweep solves all its entries at once. At
        most ode_max_iter sweeps; they end once no entry grows by ode_tol of itself.
        """
        k = self.alpha / self.dt**2
        wide = np.zeros(self.size + 2)  # with a 0 beyond either end
        lead = 4 * k + c
        for _ in range(self.ode_max_iter):
            old = wide.copy()
            for half in (slice(1, self.size + 1, 2), slice(2, self.size + 1, 2)):
                own = slice(half.start - 1, self.size, 2)
                pull = k * (wide[half.start - 1 : self.size : 2] + wide[half.start + 1 : self.size + 2 : 2])
                wide[half] = (pull + np.sqrt(pull * pull + lead[own] * d[own])) / lead[own]
            if (wide - old <= self.ode_tol * old).all():
                break
        return wide[1:-1]

    def iterate(self, mu, a, g):
        n = self.data.n_nodes
        kernel = np.einsum("uvd,dm->uvm", a, g)
        s = weighted_sums(self.counts, mu, kernel.reshape(n, -1))
        over = s.over.reshape(n, n, self.size)
        q = a * a * np.einsum("uvm,dm->uvd", over, g)
        d = g * np.einsum("uvm,uvd->dm", over, a) / self.dt
        reach = a.sum(axis=0)  # [v, d]: over all targets
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.where(g != 0, np.einsum("vd,vm->dm", reach, self.early) / g, 0.0)
        r = self.exposure @ g.T
        new_a = np.sqrt(q / (r[None] + 2 * self.alpha))
        solved = [self._smoothed(c[i], d[i]) for i in range(len(g))]
        return mu * s.inverse / self.data.total_time, new_a, np.stack(solved)

    def fit(self, data: EventData, mu, amplitudes, basis) -> SharedBasis:
        """After the first rounds every third is followed from a point beyond the last two, as
        their steps shrink slowly. The stop rule is that of a plain round, wherever it began."""
        self.prepare(data)
        state = tuple(np.asarray(x, float) for x in (mu, amplitudes, basis))
        trail: list[tuple[tuple, float]] = []
        safe = None  # what a jump left, and the change that its first round must not exceed by much
        size, reach = 1.0, math.inf  # of the last jump, and the most of the next
        for i in range(self.max_iter):
            new = self.iterate(*state)
            far = max(relative_distance(x, y) for x, y in zip(new, state, strict=True))
            self.history.append({"n_iter": i + 1, "rel": far})
            if safe is not None and not far <= 2 * safe[1]:
                state, safe, reach = safe[0], None, max(size / 4, 2.0)
                continue
            if safe is not None and size == reach:
                reach *= 4
            trail = [] if safe is not None else [*trail, (state, far)]
            state, safe = new, None
            self.converged = far <= self.tol
            if self.converged:
                break
            if i >= PLAIN_ROUNDS and len(trail) >= 2:
                beyond = _extrapolated(trail[-2][0], trail[-1][0], state, reach)
                if beyond is not None:
                    safe = state, trail[-2][1]
                    state, size = beyond
                trail = []
        self.mu, self.amplitudes, self.basis = state
        return self

    def kernel_values(self, i: int, j: int, x) -> np.ndarray:
        x = np.asarray(x, float)
        m = np.clip(np.floor(x / self.dt).astype(int), 0, self.size - 1)
        return np.where((x >= 0) & (x < self.support), (self.amplitudes[i, j] @ self.basis)[m], 0.0)


PENALTIES = ("none", "l1", "l2", "elasticnet", "nuclear")


class Parametric(_Fit):
    """Exponential or sum-of-exponentials kernels of fixed decays under a penalty.

    loss is 'least-squares', after one pass over the data free of Spark, or 'likelihood', with
    one aggregate per evaluation. All coefficients, baselines too, are at least 0 and
    penalised with weight 1 / C; the nuclear penalty acts on the adjacency alone.
    """

    def __init__(self, decays, loss: str = "least-squares", penalty: str = "l2", C: float = 1e3, ratio: float = 0.95, n_baselines: int = 1, period: float | None = None, max_iter: int = 200, tol: float = 1e-9):
        super().__init__()
        if penalty not in PENALTIES or loss not in ("least-squares", "likelihood"):
            raise ValueError("unknown penalty or loss")
        if n_baselines > 1 and not period:
            raise ValueError("several baselines need a period")
        self.decays, self.loss, self.penalty, self.C, self.ratio = decays, loss, penalty, C, ratio
        self.n_baselines, self.period, self.max_iter, self.tol = n_baselines, period, max_iter, tol

    def model(self, data: EventData):
        if self.n_baselines > 1:
            return hawkes.PeriodicLeastSquares(data, self.decays, self.n_baselines, self.period)
        return (hawkes.LeastSquares if self.loss == "least-squares" else hawkes.LogLikelihood)(data, self.decays)

    def _size(self, data: EventData) -> tuple[int, tuple]:
        d, n = np.asarray(self.decays, float), data.n_nodes
        shape = (n, n) if d.ndim != 1 else (n, n, len(d))
        return n * self.n_baselines, shape

    def fit(self, data: EventData, start=None) -> Parametric:
        self.data, model = data, self.model(data)
        n_mu, shape = self._size(data)
        size = n_mu + math.prod(shape)
        s = 0.0 if self.penalty == "none" else 1 / self.C

        def penalised(c):
            value, grad = model.loss_and_grad(c)
            if self.penalty == "l2":
                return value + s * c @ c / 2, grad + s * c
            if self.penalty == "l1":
                return value + s * c.sum(), grad + s
            if self.penalty == "elasticnet":
                return value + s * (self.ratio * c.sum() + (1 - self.ratio) * c @ c / 2), grad + s * (self.ratio + (1 - self.ratio) * c)
            if self.penalty == "nuclear":
                u, v, w = np.linalg.svd(c[n_mu:].reshape(data.n_nodes, -1), full_matrices=False)
                return value + s * v.sum(), grad + np.r_[np.zeros(n_mu), s * (u @ w).ravel()]
            return value, grad

        x = np.ones(size) if start is None else np.broadcast_to(np.asarray(start, float), (size,)).copy()
        self.coeffs = minimise(penalised, x, lower=0.0, max_iter=self.max_iter, tol=self.tol)
        self.objective = penalised(self.coeffs)[0]
        self.mu, self.adjacency = self.coeffs[:n_mu], self.coeffs[n_mu:].reshape(shape)
        return self

    def score(self, data: EventData | None = None, coeffs=None) -> float:
        """Minus the loss, at the fitted or the given coefficients."""
        return -self.model(data or self.data).loss(self.coeffs if coeffs is None else coeffs)
