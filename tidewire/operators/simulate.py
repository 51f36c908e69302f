"""Simulators. Each realization or block of rows has a generator of its own, derived from the
seed and its number, so results don't depend on partitions and survive reruns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.data import EventData
from tidewire.functions.kernels import Exponential, ExponentialSum, Kernel, TimeFunction, Zero, norms, spectral_radius
from tidewire.functions.special import beta_cdf
from tidewire.session import ship

_EVENTS = "r bigint, node int, t double, eid bigint"
_BLOCK = 50_000


def _events(r: int, t: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(t), _BLOCK):
        part = slice(i, i + _BLOCK)
        n = len(t[part])
        # Numbers of events are unique as long as a realization has fewer than 2**32.
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r)), pa.array(node[part].astype(np.int32)), pa.array(t[part]), pa.array((r << 32) + i + np.arange(n))], ["r", "node", "t", "eid"])


def _each(spark: SparkSession, n: int, simulate) -> DataFrame:
    """Events of n realizations, as simulate(r) makes times and nodes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.column(0).to_pylist():
                t, node = simulate(r)
                yield from _events(r, t, node)

    ship(spark)
    return spark.range(n).mapInArrow(made, _EVENTS)


def _data(spark: SparkSession, events: DataFrame, n: int, n_nodes: int, end_time: float | None) -> EventData:
    if end_time is None:
        ends = spark.range(n).withColumnRenamed("id", "r").join(events.groupBy("r").agg(F.max("t").alias("end_time")), "r", "left").fillna(0.0, ["end_time"])
    else:
        ends = spark.range(n).select(F.col("id").alias("r"), F.lit(float(end_time)).alias("end_time"))
    return EventData(events, ends, n_nodes)


def poisson(spark: SparkSession, rates: list[float], n: int = 1, end_time: float | None = None, max_jumps: int | None = None, seed: int = 0) -> EventData:
    """Homogeneous processes, until the end time or a number of jumps."""
    total, part = float(sum(rates)), np.cumsum(rates)
    if end_time is None and max_jumps is None:
        raise ValueError("an end time or a number of jumps is needed")

    def simulate(r):
        rng = np.random.default_rng([seed, r])
        if total <= 0:
            return np.zeros(0), np.zeros(0, np.int64)
        if max_jumps is not None:
            t = np.cumsum(rng.exponential(1 / total, max_jumps))
            t = t if end_time is None else t[t < end_time]
        else:
            t = np.sort(rng.uniform(0, end_time, rng.poisson(total * end_time)))
        return t, np.searchsorted(part, rng.uniform(0, total, len(t)), side="right")

    return _data(spark, _each(spark, n, simulate), n, len(rates), end_time)


def inhomogeneous(spark: SparkSession, intensities: list[TimeFunction], end_time: float, n: int = 1, seed: int = 0) -> EventData:
    """Poisson processes of given intensities: candidates at the largest value, thinned."""

    def simulate(r):
        rng = np.random.default_rng([seed, r])
        ts, nodes = [], []
        for i, f in enumerate(intensities):
            top = f.future_bound(0.0)
            t = np.sort(rng.uniform(0, end_time, rng.poisson(max(top, 0) * end_time)))
            t = t[rng.uniform(0, 1, len(t)) * top <= f.values(t)]
            ts.append(t)
            nodes.append(np.full(len(t), i))
        t, node = np.concatenate(ts), np.concatenate(nodes)
        order = np.argsort(t, kind="stable")
        return t[order], node[order]

    return _data(spark, _each(spark, n, simulate), n, len(intensities), end_time)


class _State:
    """What one realization remembers: decayed sums for exponentials, times for other kernels."""

    def __init__(self, kernels: list[list[Kernel]], baseline):
        self.d, self.baseline = len(kernels), baseline
        self.exp = [(i, j, a, b) for i, row in enumerate(kernels) for j, k in enumerate(row) for a, b in _parts(k)]
        self.other = [(i, j, k) for i, row in enumerate(kernels) for j, k in enumerate(row) if not isinstance(k, (Zero, Exponential, ExponentialSum))]
        self.i = np.array([e[0] for e in self.exp], int)
        self.j = np.array([e[1] for e in self.exp], int)
        self.w = np.array([e[2] * e[3] for e in self.exp])
        self.b = np.array([e[3] for e in self.exp])
        self.s = np.zeros(len(self.exp))
        self.t = 0.0
        self.past: list[list[float]] = [[] for _ in range(self.d)]

    def advance(self, t: float) -> None:
        self.s = self.s * np.exp(-self.b * (t - self.t))
        self.t = t

    def jump(self, j: int) -> None:
        self.s[self.j == j] += self.w[self.j == j]
        self.past[j].append(self.t)

    def _past(self, j: int, k: Kernel) -> np.ndarray:
        p = np.array(self.past[j])
        lag = self.t - p
        return lag[lag < k.support] if math.isfinite(k.support) else lag

    def intensity(self) -> np.ndarray:
        out = np.array([f(self.t) for f in self.baseline])
        np.add.at(out, self.i, self.s)
        for i, j, k in self.other:
            out[i] += k.values(self._past(j, k)).sum()
        return out

    def bound(self, ahead: float) -> float:
        """At least the total intensity from now on, until the next jump; baselines for ahead."""
        total = sum(f.top(self.t, ahead) for f in self.baseline) + np.maximum(self.s, 0).sum()
        for _, j, k in self.other:
            total += sum(max(k.future_bound(float(x)), 0.0) for x in self._past(j, k))
        return float(total)


def _parts(k: Kernel) -> list[tuple[float, float]]:
    if isinstance(k, Exponential):
        return [(k.intensity, k.decay)]
    return list(zip(k.intensities, k.decays, strict=True)) if isinstance(k, ExponentialSum) else []


class Baseline:
    """A constant, periodic steps, or a time function."""

    def __init__(self, value, period: float | None = None):
        self.function = value if isinstance(value, TimeFunction) else None
        self.steps = None if self.function else np.atleast_1d(np.asarray(value, float))
        self.period = period

    def __call__(self, t: float) -> float:
        if self.function:
            return float(self.function.values(t))
        k = len(self.steps)
        return float(self.steps[min(int((t % self.period) / self.period * k), k - 1)] if k > 1 else self.steps[0])

    def top(self, t: float, ahead: float) -> float:
        return self.function.future_bound(t) if self.function else float(self.steps.max())


def hawkes(spark: SparkSession, kernels: list[list[Kernel]], baseline: list, n: int = 1, end_time: float | None = None, max_jumps: int | None = None, seed: int = 0, period: float | None = None, force: bool = False, threshold_negative: bool = False, history: EventData | None = None) -> EventData:
    """Self-exciting processes by thinning, each realization in one task.

    Without max_jumps and force the kernel norms must be stable. Baselines are numbers, lists
    of steps of the period, or time functions. history continues realizations 0 .. n-1 of the
    same nodes from its end times. Negative intensities raise an error unless thresholded to 0.
    """
    if end_time is None and max_jumps is None:
        raise ValueError("an end time or a number of jumps is needed")
    if max_jumps is None and not force and spectral_radius(np.abs(norms(kernels))) >= 1:
        raise ValueError("the kernels are unstable; give a number of jumps or force it")
    base = [b if isinstance(b, Baseline) else Baseline(b, period) for b in baseline]

    def run(r: int, past: list[tuple[float, int]], start: float) -> tuple[np.ndarray, np.ndarray]:
        rng, s = np.random.default_rng([seed, r, len(past)]), _State(kernels, base)
        for t, j in past:
            s.advance(t)
            s.jump(j)
        s.advance(start)
        ts, nodes = [], []
        stop = math.inf if end_time is None else end_time
        while max_jumps is None or len(ts) < max_jumps:
            top = s.bound(stop)
            if top <= 0:
                break
            t = s.t + rng.exponential(1 / top)
            if t >= stop:
                break
            s.advance(t)
            lam = s.intensity()
            if (lam < 0).any():
                if not threshold_negative:
                    raise ValueError("the intensity is negative")
                lam = np.maximum(lam, 0)
            u = rng.uniform(0, top)
            if u <= lam.sum():
                j = min(int(np.searchsorted(np.cumsum(lam), u)), len(lam) - 1)
                s.jump(j)
                ts.append(t)
                nodes.append(j)
        return np.array(ts), np.array(nodes, int)

    if history is None:
        return _data(spark, _each(spark, n, lambda r: run(r, [], 0.0)), n, len(kernels), end_time)

    def resumed(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        r, start = rows[0]["r"], rows[0]["end_time"]
        past = sorted((x["t"], x["node"]) for x in rows if x["t"] is not None)
        times, node = run(r, past, start)
        batches = list(_events(r, np.r_[[p[0] for p in past], times], np.r_[[p[1] for p in past], node].astype(int)))
        return pa.Table.from_batches(batches, schema=pa.schema([("r", pa.int64()), ("node", pa.int32()), ("t", pa.float64()), ("eid", pa.int64())]))

    whole = history.ends.join(history.events, "r", "left").select("r", "end_time", "t", "node")
    return _data(spark, whole.groupBy("r").applyInArrow(resumed, _EVENTS), n, len(kernels), end_time)


def exponential_kernels(adjacency, decays, radius: float | None = None) -> list[list[Kernel]]:
    """A matrix of exponential kernels, or of sums if adjacency has a third axis; scaled to a
    spectral radius if one is given."""
    a = np.asarray(adjacency, float)
    if radius is not None:
        a = a * radius / spectral_radius(a if a.ndim == 2 else a.sum(axis=2))
    d = np.asarray(decays, float)
    if a.ndim == 3:
        return [[ExponentialSum(tuple(a[i, j]), tuple(d)) for j in range(len(a))] for i in range(len(a))]
    d = np.broadcast_to(d, a.shape)
    return [[Exponential(float(a[i, j]), float(d[i, j])) if a[i, j] else Zero() for j in range(len(a))] for i in range(len(a))]


def normal_features(spark: SparkSession, n: int, p: int, cov: np.ndarray | None = None, seed: int = 0) -> DataFrame:
    """row_id, features: normal rows of a covariance, the identity by default."""
    root = np.eye(p) if cov is None else np.linalg.cholesky(cov)
    z = spark.range(n).select(F.col("id").alias("row_id"), F.array(*(F.randn(seed * 1000 + i) for i in range(p))).alias("z"))
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in root))
    return z.select("row_id", F.transform(rows, lambda w: F.aggregate(F.zip_with(w, F.col("z"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("features"))


def toeplitz(p: int, correlation: float = 0.5) -> np.ndarray:
    i = np.arange(p)
    return correlation ** np.abs(i[:, None] - i[None, :])


def uniform_covariance(p: int, seed: int = 0) -> np.ndarray:
    a = np.random.default_rng(seed).uniform(size=(p, p))
    return 0.5 * (a + a.T) / 2 + np.eye(p) * p / 2


def glm_rows(spark: SparkSession, weights, intercept: float = 0.0, kind: str = "linear", n: int = 200, features: str = "toeplitz", correlation: float = 0.5, noise: float = 1.0, seed: int = 0) -> DataFrame:
    """row_id, features, label of a linear, logistic (-1 and 1) or Poisson model."""
    p = len(weights)
    if features == "uniform":
        x = spark.range(n).select(F.col("id").alias("row_id"), F.array(*(F.rand(seed * 1000 + i) for i in range(p))).alias("features"))
    else:
        x = normal_features(spark, n, p, toeplitz(p, correlation) if features == "toeplitz" else None, seed)
    w = F.array(*(F.lit(float(v)) for v in weights))
    z = F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(float(intercept)), lambda s, v: s + v)
    if kind == "linear":
        return x.withColumn("label", z + noise * F.randn(seed * 1000 + 999))
    if kind == "logistic":
        return x.withColumn("label", F.when(F.rand(seed * 1000 + 999) < 1 / (1 + F.exp(-z)), 1.0).otherwise(-1.0))
    if kind != "poisson":
        raise ValueError("kind must be linear, logistic or poisson")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, mean = b.column(0).to_numpy(), np.exp(np.clip(b.column(2).to_numpy(), -20, 20))
            y = np.array([np.random.default_rng([seed, int(i)]).poisson(m) for i, m in zip(ids, mean, strict=True)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(y)], ["row_id", "features", "label"])

    return x.withColumn("z", z).mapInArrow(drawn, "row_id bigint, features array<double>, label double")


def cox_rows(spark: SparkSession, coeffs, n: int = 200, shape: float = 1.0, scale: float = 1.0, censoring: float = 2.0, features: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """row_id, features, time, event: Weibull failures whose scale grows with the score, and
    exponential censoring with a mean of censoring times the mean failure time."""
    x = features if features is not None else normal_features(spark, n, len(coeffs), toeplitz(len(coeffs)), seed)
    w = F.array(*(F.lit(float(v)) for v in coeffs))
    s = F.aggregate(F.zip_with("features", w, lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    e = -F.log(1 - F.rand(seed * 1000 + 1))
    failed = x.withColumn("t", F.pow(e * F.exp(-s), F.lit(1 / shape)) / scale)
    mean = failed.agg(F.avg("t")).first()[0] or 1.0
    c = -F.log(1 - F.rand(seed * 1000 + 2)) * (censoring * mean)
    return failed.withColumn("c", c).select("row_id", "features", F.least("t", "c").alias("time"), (F.col("t") <= F.col("c")).cast("tinyint").alias("event"))


def cox_rows_with_cuts(spark: SparkSession, cuts: list[list[float]], effects: list[list[float]], n: int = 200, seed: int = 0, **options) -> DataFrame:
    """Cox rows whose score is a step function of each feature, between its cut points."""
    from tidewire.operators.binarizer import bin_of

    x = normal_features(spark, n, len(cuts), toeplitz(len(cuts)), seed)
    steps = F.array(*(F.element_at(F.array(*(F.lit(float(v)) for v in e)), bin_of(F.col("features")[i], [-math.inf, *c, math.inf]) + 1) for i, (c, e) in enumerate(zip(cuts, effects, strict=True))))
    scored = x.select("row_id", F.col("features").alias("raw"), steps.alias("features"))
    rows = cox_rows(spark, [1.0] * len(cuts), n, features=scored.select("row_id", "features"), seed=seed, **options)
    return rows.drop("features").join(scored.select("row_id", F.col("raw").alias("features")), "row_id")


def case_series(spark: SparkSession, n: int, n_intervals: int, n_lags: list[int], coeffs: list[list[float]], exposure_rate: float = 0.05, single: bool = True, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features, labels and censoring of n cases, each with one event that falls on an interval
    with a chance that grows with the effects of its lagged exposures. Single exposures start
    once per feature; multiple ones come anew in every interval."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for case in b.column(0).to_pylist():
                rng = np.random.default_rng([seed, case])
                x = rng.uniform(size=(n_intervals, len(n_lags))) < exposure_rate
                if single:
                    x &= np.cumsum(x, axis=0) == 1
                c = int(rng.integers(max(1, n_intervals // 2), n_intervals + 1))
                score = np.zeros(c)
                for f, lags in enumerate(n_lags):
                    for k in range(lags + 1):
                        score[k:] += coeffs[f][k] * x[: max(c - k, 0), f]
                p = np.exp(score - score.max())
                y = int(rng.choice(c, p=p / p.sum()))
                rows.append((case, c, y, [(int(i), int(f)) for i, f in zip(*np.nonzero(x[:c]), strict=True)]))
            cols = list(zip(*rows, strict=True))
            kind = pa.list_(pa.struct([("interval", pa.int64()), ("feature", pa.int32())]))
            x = pa.array([[{"interval": i, "feature": f} for i, f in v] for v in cols[3]], kind)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), x], ["case_id", "censoring", "at", "x"])

    ship(spark)
    cases = spark.range(n).mapInArrow(made, "case_id bigint, censoring bigint, at bigint, x array<struct<interval:bigint,feature:int>>")
    features = cases.select("case_id", F.explode("x").alias("e")).select("case_id", "e.interval", "e.feature", F.lit(1.0).alias("value"))
    return features, cases.select("case_id", F.col("at").alias("interval"), F.lit(1).alias("y")), cases.select("case_id", "censoring")


def risk_curve(n: int, kind: str = "constant", size: float = 1.0, cut: int | None = None) -> np.ndarray:
    """Relative risks over n intervals: constant, up to a cut, or with an early or a mid peak."""
    if kind == "constant":
        return np.full(n, size)
    if kind == "cut":
        return np.where(np.arange(n) < (cut or n // 2), size, 1.0)
    a, b = {"early": (2.0, 5.0), "middle": (5.0, 5.0), "late": (5.0, 2.0)}[kind]
    mass = np.diff(beta_cdf(np.linspace(0, 1, n + 1), a, b))
    return 1 + (size - 1) * mass / mass.max()


def sparse_exponential(n: int, nnz: int = 10, scale: float = 10.0) -> np.ndarray:
    """exp(-i / scale) of alternating sign, negative first, for the first nnz places."""
    i = np.arange(n)
    return np.where(i < nnz, np.exp(-i / scale) * np.where(i % 2 == 0, -1.0, 1.0), 0.0)


def sparse_normal(n: int, nnz: int = 10, std: float = 1.0, seed: int = 0) -> np.ndarray:
    rng, out = np.random.default_rng(seed), np.zeros(n)
    out[rng.permutation(n)[:nnz]] = rng.normal(0, std, min(nnz, n))
    return out


def random_numbers(spark: SparkSession, kind: str, n: int, seed: int = 0, low: float = 0.0, high: float = 1.0, mean: float = 0.0, std: float = 1.0, rate: float = 1.0, chances: list[float] | None = None) -> DataFrame:
    """n numbers, as id and value: uniform, gaussian, exponential, integer, discrete or poisson."""
    base = spark.range(n)
    if kind == "uniform":
        return base.withColumn("value", F.rand(seed) * (high - low) + low)
    if kind == "gaussian":
        return base.withColumn("value", F.randn(seed) * std + mean)
    if kind == "exponential":
        return base.withColumn("value", -F.log(1 - F.rand(seed)) / rate)
    if kind == "integer":
        return base.withColumn("value", F.floor(F.rand(seed) * (int(high) - int(low) + 1)) + int(low))
    if kind == "discrete":
        c = np.cumsum(np.asarray(chances, float) / np.sum(chances))
        return base.withColumn("u", F.rand(seed)).select("id", sum((F.col("u") >= F.lit(float(v))).cast("int") for v in c[:-1]).alias("value") if len(c) > 1 else F.lit(0).alias("value"))
    if kind != "poisson":
        raise ValueError("unknown distribution")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [int(np.random.default_rng([seed, i]).poisson(rate)) for i in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.int64())], ["id", "value"])

    return base.mapInArrow(drawn, "id bigint, value bigint")
