"""Conditional laws of point processes and kernels estimated from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.data import EventData
from tidewire.operators import bands
from tidewire.operators.scan import previous
from tidewire.session import written


def increments(data: EventData, cumulative: bool = True) -> EventData:
    """Give every event the mark increment: the difference of successive cumulative marks in
    its realization and node, or 1 where events have no mark."""
    events = data.events
    if "mark" not in events.columns:
        events = events.withColumn("mark", F.lit(1.0))
    elif cumulative:
        events = previous(events, ["r", "node"], ["t", "eid"], "mark").withColumn("mark", F.col("mark") - F.coalesce("before", F.lit(0.0))).drop("before")
    return EventData(events, data.ends, data.n_nodes)


def delayed(data: EventData, nodes: list[int], delay: float) -> EventData:
    """Shift the events of some nodes by a delay."""
    t = F.when(F.col("node").isin(*nodes), F.col("t") + delay).otherwise(F.col("t"))
    return EventData(data.events.withColumn("t", t), data.ends, data.n_nodes)


def mark_statistics(data: EventData, cuts: dict[int, list[float]]) -> DataFrame:
    """Per node and mark interval: number and share of the events whose mark lies in it, closed
    at the left; with the node's least and greatest mark. Columns node, interval, n, share,
    least, most."""
    intervals = _intervals(data.n_nodes, cuts)
    spark = data.events.sparkSession
    rows = [(i, j, float(a), float(b)) for i, v in intervals.items() for j, (a, b) in enumerate(v)]
    table = spark.createDataFrame(rows, "node int, interval int, low double, high double")
    ends = data.events.groupBy("node").agg(F.min("mark").alias("least"), F.max("mark").alias("most"))
    # Bounded by nodes times intervals.
    hit = data.events.join(F.broadcast(table), "node").where("mark >= low and mark < high")
    n = hit.groupBy("node", "interval").agg(F.count("*").alias("n"))
    joined = table.join(n, ["node", "interval"], "left").fillna(0, ["n"]).join(ends, "node", "left")
    return joined.select("node", "interval", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("node"))).alias("share"), "least", "most")


def _intervals(n_nodes: int, cuts: dict[int, list[float]]) -> dict[int, list[tuple[float, float]]]:
    """Mark intervals of every node: below, between and above its cuts; one without cuts."""
    top = float(np.finfo(float).max)
    return {i: list(zip([-top, *cuts.get(i, [])], [*cuts.get(i, []), top], strict=True)) for i in range(n_nodes)}


def law_counts(data: EventData, lags, cuts: dict[int, list[float]] | None = None) -> DataFrame:
    """r, i, j, l, k, n: how many events of i fall into lag bin k, open at the left, after the
    events of j with mark interval l; and the number of such events of j as n_terms.

    The first and the last event of i in a realization never count, and events of j count
    only while the longest lag ends before the end time; past the last event of i just one
    more of them does. These ends are those of a scan that stops where i runs out. A node's
    first event belongs to all its mark intervals; the others are closed on both sides.
    """
    lags = [float(x) for x in lags]
    events, top = data.events, lags[-1]
    if cuts and "mark" not in events.columns:
        raise ValueError("cuts need marks")
    if not cuts:
        events = events.withColumn("mark", F.lit(1.0))
    spark = events.sparkSession
    table = spark.createDataFrame([(i, m, float(a), float(b)) for i, v in _intervals(data.n_nodes, cuts or {}).items() for m, (a, b) in enumerate(v)], "node int, l int, low double, high double")
    spans = data.events.groupBy("r", "node").agg(F.min(F.struct("t", "eid")).alias("a"), F.max(F.struct("t", "eid")).alias("z"))
    first = spans.select("r", "node", F.col("a.eid").alias("_first"))
    spans = spans.select("r", F.col("node").alias("i"), "a", "z")
    sources = events.join(first, ["r", "node"]).join(F.broadcast(table), "node").where("eid = _first or (mark >= low and mark <= high)").join(data.ends, "r").where(F.col("t") + top < F.col("end_time")).select("r", "t", "eid", F.col("node").alias("j"), "l")
    p = bands.band_pairs(data.events.select("r", "t", "eid", F.col("node").alias("i")), sources.select("r", "t", "j", "l"), top).where("lag > 0")
    p = p.join(spans, ["r", "i"]).where((F.col("eid") != F.col("a.eid")) & (F.col("eid") != F.col("z.eid")))
    m = bands.right_closed_bin(F.col("lag"), lags)
    hits = p.groupBy("r", "i", F.col("s_j").alias("j"), F.col("s_l").alias("l"), m.alias("k")).agg(F.count("*").alias("n"))
    each = sources.join(spans, "r").groupBy("r", "i", "j", "l").agg((F.count_if(F.col("t") <= F.col("z.t")) + F.max((F.col("t") > F.col("z.t")).cast("int"))).alias("n_terms"))
    grid = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(lags) - 2))))
    return grid.join(hits, ["r", "i", "j", "l", "k"], "left").fillna(0, ["n"])


def claws(data: EventData, lags, cuts: dict[int, list[float]] | None = None) -> DataFrame:
    """i, j, l, k, lag, value: the rate of i at lag after an event of j with mark interval l,
    above its mean; averaged over realizations."""
    lags = [float(x) for x in lags]
    counts = law_counts(data, lags, cuts)
    node = data.events.groupBy("r", "node").count()
    grid = data.ends.select("r", "end_time", F.explode(F.sequence(F.lit(0), F.lit(data.n_nodes - 1))).alias("i"))
    rate = grid.join(node.select("r", F.col("node").alias("i"), "count"), ["r", "i"], "left").select("r", "i", F.coalesce(F.try_divide(F.coalesce("count", F.lit(0)), F.col("end_time")), F.lit(0.0)).alias("rate"))
    spark = data.events.sparkSession
    keys = spark.createDataFrame([(j, m, k, lags[k + 1] - lags[k], (lags[k] + lags[k + 1]) / 2) for j, v in _intervals(data.n_nodes, cuts or {}).items() for m in range(len(v)) for k in range(len(lags) - 1)], "j int, l int, k int, width double, lag double")
    full = rate.join(F.broadcast(keys)).join(counts, ["r", "i", "j", "l", "k"], "left")
    value = F.coalesce(F.col("n") / F.greatest("n_terms", F.lit(1)), F.lit(0.0)) / F.col("width") - F.col("rate")
    return full.groupBy("i", "j", "l", "k", "lag").agg(F.avg(value).alias("value"))


class ConditionalLaw:
    """Kernels from the integral equations between them and the conditional laws.

    quadrature 'gauss', 'gauss-' (singular parts taken off), 'lin' or 'log'. Marks of a node
    with cuts weigh its kernels; delayed nodes are shifted first. symmetries are pairs of
    claws ((i1, j1), (i2, j2)) that are averaged.
    """

    def __init__(self, delta_lag=0.1, min_lag=1e-4, max_lag=40.0, n_quad=50, max_support=40.0, min_support=1e-4, quadrature="gauss", claw="lin", cuts=None, delayed_nodes=(), delay=1e-5, symmetries=()):
        self.n_quad, self.quadrature, self.max_support, self.min_support = n_quad, quadrature, max_support, min_support
        self.cuts, self.delayed_nodes, self.delay, self.symmetries = cuts or {}, list(delayed_nodes), delay, symmetries
        if claw == "log":
            self.lags = np.r_[np.arange(0.0, min_lag, min_lag * delta_lag), np.exp(np.arange(np.log(min_lag), np.log(max_lag), delta_lag))]
        else:
            self.lags = np.arange(0.0, max_lag, delta_lag)
        if len(self.lags) < 2:
            self.lags = np.array([0.0, max_lag])

    def prepare(self, data: EventData) -> None:
        """The claw table and the rates: all that Spark computes."""
        if self.delayed_nodes:
            data = delayed(data, self.delayed_nodes, self.delay)
        n = data.n_nodes
        self.marks = {i: len(v) for i, v in _intervals(n, self.cuts).items()}
        self.probability = {i: np.ones(1) for i in range(n)}
        if self.cuts:
            data = increments(data)
            for i in range(n):
                self.probability[i] = np.zeros(self.marks[i])
            for r in mark_statistics(data, self.cuts).collect():
                self.probability[r["node"]][r["interval"]] = r["share"] or 0.0
        self.table = written(claws(data, self.lags, self.cuts or None), "claws")
        self.claw = {(i, j, m): np.zeros(len(self.lags) - 1) for i in range(n) for j in range(n) for m in range(self.marks[j])}
        for r in self.table.collect():  # nodes squared, mark intervals, lags
            self.claw[r["i"], r["j"], r["l"]][r["k"]] = r["value"]
        for (i1, j1), (i2, j2) in self.symmetries:
            for m in range(min(self.marks[j1], self.marks[j2])):
                mean = (self.claw[i1, j1, m] + self.claw[i2, j2, m]) / 2
                self.claw[i1, j1, m] = self.claw[i2, j2, m] = mean
        per = data.events.groupBy("r", "node").count().join(data.ends, "r").groupBy("node").agg(F.coalesce(F.try_divide(F.sum("count"), F.sum("end_time")), F.lit(0.0)).alias("rate"))
        self.mean = np.zeros(n)
        for r in per.collect():
            self.mean[r["node"]] = r["rate"]

    def law(self, key, t) -> np.ndarray:
        """A claw between bin centres, on the line of the first two before them, 0 beyond."""
        x, y = (self.lags[1:] + self.lags[:-1]) / 2, self.claw[key]
        t = np.asarray(t, float)
        v = np.interp(t, x, y)
        if len(x) > 1:
            v = np.where(t < x[0], y[0] + (y[1] - y[0]) * (t - x[0]) / (x[1] - x[0]), v)
        return np.where(t >= x[-1], 0.0, v)

    def _nodes(self) -> tuple[np.ndarray, np.ndarray]:
        if self.quadrature in ("gauss", "gauss-"):
            x, w = np.polynomial.legendre.leggauss(self.n_quad)
            return self.max_support * (x + 1) / 2, w * self.max_support / 2
        if self.quadrature == "log":
            step = (np.log(self.max_support) - np.log(self.min_support) + 1) / self.n_quad
            x = np.r_[np.arange(0, self.min_support, self.min_support * step), np.exp(np.arange(np.log(self.min_support), np.log(self.max_support), step))]
        else:
            x = np.arange(0, self.max_support, self.max_support / self.n_quad)
        w = np.diff(x)
        return x, np.r_[w, w[-1]]

    def _gauss_block(self, x, w, a, b):
        """Rows of a = (j, l), columns of b = (j1, l1): kernel b's part in the law after a."""
        (j, l), (j1, l1) = a, b
        far = x[:, None] - x[None, :]
        ratio = self.mean[j1] / self.mean[j]
        after = np.where(far >= 0, self.law((j1, j, l), np.abs(far)), 0.0)
        before = np.where(far <= 0, ratio * self.law((j, j1, l1), np.abs(far)), 0.0)
        block = after + before
        np.fill_diagonal(block, 0.0 if self.quadrature == "gauss-" else np.diagonal(block) / 2)
        block = self.probability[j1][l1] * w[None, :] * block
        if self.quadrature == "gauss-":
            # Each kernel value is taken off the column of its own row's node.
            block = block - np.diag(block.sum(axis=1))
        return block

    def _hat_block(self, x, w, a, b):
        """Kernels linear between nodes: integrals of hat functions against the laws."""
        (j, l), (j1, l1) = a, b
        ratio = self.mean[j1] / self.mean[j]
        n = len(x)
        fine = np.unique(np.r_[0.0, (self.lags[1:] + self.lags[:-1]) / 2, np.abs(x[:, None] - x[None, :]).ravel()])

        def integrals(key):
            y = self.law(key, fine)
            d = np.diff(fine)
            one = np.r_[0, np.cumsum(d * (y[1:] + y[:-1]) / 2)]
            two = np.r_[0, np.cumsum(d * (y[1:] + y[:-1]) / 2 * fine[:-1] + d * d * (np.diff(y) / 3 + y[:-1] / 2))]
            return (lambda s: one[at(s)]), (lambda s: two[at(s)])

        def at(s):
            """The sample from s on that is nearest; samples are all differences of nodes, so
            only rounding moves s off one. The last sample stands for what lies beyond."""
            i = np.minimum(np.searchsorted(fine, s), len(fine) - 1)
            j = np.minimum(i + 1, len(fine) - 1)
            near = np.where(np.abs(fine[i] - s) < np.abs(fine[j] - s), i, j)
            return np.where(s >= fine[-1], len(fine) - 1, near)

        g1, g2 = integrals((j1, j, l))
        b1, b2 = integrals((j, j1, l1))
        block = np.zeros((n, n))
        for q in range(n):
            left, width = x[q], w[q]
            # Over [left, right], with lag s = x[n] - u after, u - x[n] before.
            done = x > left
            hi, lo = np.where(done, x - left, 0.0), np.where(done, x - left - width, 0.0)
            m0, m1 = g1(hi) - g1(lo), g2(hi) - g2(lo)
            up = ((x - left) * m0 - m1) / width  # weight of the right node: (u - left) / width
            hi, lo = np.where(done, 0.0, left - x + width), np.where(done, 0.0, left - x)
            k0, k1 = ratio * (b1(hi) - b1(lo)), ratio * (b2(hi) - b2(lo))
            up = up + ((x - left) * k0 + k1) / width
            total = m0 + k0
            if q == n - 1:  # constant beyond the last node
                block[:, q] += total
            else:
                block[:, q] += total - up
                block[:, q + 1] += up
        return self.probability[j1][l1] * block

    def fit(self, data: EventData) -> ConditionalLaw:
        self.prepare(data)
        return self.solve()

    def solve(self) -> ConditionalLaw:
        n = len(self.mean)
        x, w = self._nodes()
        keys = [(j, m) for j in range(n) for m in range(self.marks[j])]
        make = self._gauss_block if self.quadrature in ("gauss", "gauss-") else self._hat_block
        # What the unknowns are multiplied with doesn't depend on the target.
        system = np.eye(len(keys) * len(x)) + np.block([[make(x, w, a, b) for b in keys] for a in keys])
        self.x, self.kernels, self.norms = x, np.zeros((n, n, len(x))), np.zeros((n, n))
        self.marked_kernels = {}
        for i in range(n):
            v = np.concatenate([self.law((i, *a), x) for a in keys])
            phi = np.linalg.solve(system, v).reshape(len(keys), len(x))
            for (j, m), y in zip(keys, phi, strict=True):
                self.marked_kernels[i, j, m] = y
                norm = (y * w).sum() if self.quadrature in ("gauss", "gauss-") else ((y[:-1] + y[1:]) / 2 * w[:-1]).sum()
                self.kernels[i, j] += y * self.probability[j][m]
                self.norms[i, j] += norm * self.probability[j][m]
        self.baseline = (np.eye(n) - self.norms) @ self.mean
        return self
