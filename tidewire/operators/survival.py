"""Survival curves, Cox partial likelihood and self-controlled case series."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.prox import total_variation_prox
from tidewire.functions.special import minimise_sum, normal_quantile
from tidewire.operators import glm, solvers
from tidewire.operators.scan import running_totals
from tidewire.operators.weighted import LOCAL_BYTES, task_sums
from tidewire.session import ship, written


def risk_table(rows: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """time, d, n for every distinct time with an event: events at it and rows at risk, that is
    of that time or later. Rows of a null time or event are left out."""
    kept = rows.where(F.col(time).isNotNull() & F.col(event).isNotNull())
    per = kept.groupBy(F.col(time).cast("double").alias("time")).agg(F.sum((F.col(event) != 0).cast("double")).alias("d"), F.count("*").cast("double").alias("m"))
    return running_totals(per, "time", ["m"], descending=True).where("d > 0").select("time", "d", F.col("cum_m").alias("n"))


def _with_zero(curve: DataFrame, column: str, start: float) -> DataFrame:
    spark = curve.sparkSession
    zero = spark.createDataFrame([(0.0, start)], f"time double, {column} double")
    return zero.unionByName(curve.where("time > 0")) if curve.where("time = 0").isEmpty() else curve


def kaplan_meier(rows: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """time, survival: the product of 1 - d / n, from 1 at time 0. Where all rows left have the
    event the curve is 0 from there. An empty table gives the row at 0 alone."""
    r = risk_table(rows, time, event)
    logs = r.withColumn("gone", (F.col("d") >= F.col("n")).cast("double")).withColumn("l", F.when(F.col("d") < F.col("n"), F.log1p(-F.col("d") / F.col("n"))).otherwise(0.0))
    sums = running_totals(logs, "time", ["l", "gone"])
    return _with_zero(sums.select("time", F.when(F.col("cum_gone") > 0, 0.0).otherwise(F.exp("cum_l")).alias("survival")), "survival", 1.0)


def nelson_aalen(rows: DataFrame, time: str = "time", event: str = "event") -> DataFrame:
    """time, hazard: the running sum of d / n, from 0 at time 0."""
    r = risk_table(rows, time, event).withColumn("h", F.col("d") / F.col("n"))
    return _with_zero(running_totals(r, "time", ["h"]).select("time", F.col("cum_h").alias("hazard")), "hazard", 0.0)


def _score(coeffs, features: str = "features"):
    w = F.array(*(F.lit(float(c)) for c in coeffs))
    return F.aggregate(F.zip_with(features, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Rows of a chunk of the sorted table of a Cox model.
CHUNK = 20_000


class CoxLikelihood:
    """Negative partial log-likelihood per failure; ties share one risk set (Breslow).

    rows: time, event (1 for a failure), features ARRAY<DOUBLE> of one length. Rows are sorted
    once, latest first, and kept in chunks. An evaluation reads the chunks twice, without a
    shuffle: first for each chunk's sums, of which the driver makes the sums before it, then
    for the losses. A time that fills many chunks is one risk set still.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows.where("time is not null and event is not null and features is not null").select(F.col("time").cast("double").alias("time"), (F.col("event") != 0).cast("int").alias("event"), F.col("features").cast("array<double>").alias("features"))
        first = self.rows.agg(F.max(F.size("features")).alias("p"), F.sum("event").alias("n"), F.min(F.size("features")).alias("q")).first()
        if first["p"] != first["q"]:
            raise ValueError("features differ in length")
        self.p, self.n_failures = first["p"] or 0, int(first["n"] or 0)

    @cached_property
    def chunks(self) -> DataFrame:
        """chunk, times, events, features: the rows latest first, some in a row of the table."""
        p = self.p

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId() << 32
            for b in batches:
                for i in range(0, b.num_rows, CHUNK):
                    own = b.slice(i, CHUNK)
                    flat = own.column(2).flatten().to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array([part]), *(pa.array([x], pa.list_(k)) for x, k in ((own.column(0).to_numpy(), pa.float64()), (own.column(1).to_numpy(), pa.int32()), (flat, pa.float64())))], ["chunk", "times", "events", "features"])
                    part += 1

        ordered = self.rows.repartitionByRange(F.col("time").desc()).sortWithinPartitions(F.col("time").desc())
        ship(self.rows.sparkSession)
        return written(ordered.mapInArrow(packed, "chunk bigint, times array<double>, events array<int>, features array<double>"), f"cox-{p}")

    def risk_sets(self, coeffs) -> DataFrame:
        """time, d, risk, score_sum, and g0 .. of the weighted features, per distinct time."""
        s = self.rows.withColumn("s", _score(coeffs))
        top = s.agg(F.max("s")).first()[0] or 0.0
        e = F.exp(F.col("s") - F.lit(float(top)))
        per = s.groupBy("time").agg(
            F.sum("event").cast("double").alias("d"), F.sum(F.col("event") * F.col("s")).alias("score_sum"), F.sum(e).alias("risk"),
            *(F.sum(e * F.col("features")[i]).alias(f"g{i}") for i in range(self.p)), *(F.sum(F.col("event") * F.col("features")[i]).alias(f"x{i}") for i in range(self.p)),
        )
        cum = running_totals(per, "time", ["risk", *(f"g{i}" for i in range(self.p))], descending=True)
        return cum.select("time", "d", "score_sum", F.lit(float(top)).alias("top"), F.col("cum_risk").alias("risk"), *(F.col(f"cum_g{i}").alias(f"g{i}") for i in range(self.p)), *(f"x{i}" for i in range(self.p)))

    def _weighed(self, c: np.ndarray):
        """Of a chunk: times, events, features, scores, and exp(score - top) times 1 and the features."""
        p = self.p

        def read(b: pa.RecordBatch, i: int, top: float):
            t, e, x = (b.column(k)[i].values.to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            x = x.reshape(-1, p)
            s = x @ c
            w = np.exp(s - top)
            return t, e, x, s, np.c_[w, w[:, None] * x]

        return read

    def _offsets(self, c: np.ndarray) -> tuple[float, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The greatest score; and per chunk the sums of all rows before it, and of the rows
        after it at the time of its last one."""
        read, p = self._weighed(c), self.p

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    # Scaled by the chunk's own greatest score, so that nothing overflows.
                    own = float((b.column(3)[i].values.to_numpy(zero_copy_only=False).reshape(-1, p) @ c).max())
                    t, _, _, _, w = read(b, i, own)
                    row = [own, t[0], t[-1], *w.sum(axis=0), *w[t == t[0]].sum(axis=0)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([[float(v) for v in row]], pa.list_(pa.float64()))], ["chunk", "v"])

        rows = sorted((r["chunk"], np.array(r["v"])) for r in self.chunks.mapInArrow(summed, "chunk bigint, v array<double>").collect())  # one per CHUNK rows
        rows.sort(key=lambda r: (-r[1][1], r[0]))
        top = max((v[0] for _, v in rows), default=0.0)
        k = p + 1
        before, out = np.zeros(k), {}
        sums = [(v[3 : 3 + k] * math.exp(v[0] - top), v[3 + k :] * math.exp(v[0] - top)) for _, v in rows]
        for (chunk, _), (all_, _) in zip(rows, sums, strict=True):
            out[chunk] = [before.copy(), np.zeros(k)]
            before = before + all_
        after, begins = np.zeros(k), None  # of the rows from the next chunk on that share its first time
        for (chunk, v), (all_, head) in zip(reversed(rows), reversed(sums), strict=True):
            if begins is not None and begins == v[2]:
                out[chunk][1] = after
            after = head + (after if begins == v[1] == v[2] else 0)
            begins = v[1]
        return top, {k_: tuple(v) for k_, v in out.items()}

    def loss_and_grad(self, coeffs) -> tuple[float, np.ndarray]:
        c = np.asarray(coeffs, float)
        top, offsets = self._offsets(c)
        sent, read, p = self.rows.sparkSession.sparkContext.broadcast(offsets), self._weighed(c), self.p

        def partial(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(1 + p)
            for i in range(b.num_rows):
                before, after = sent.value[b.column(0)[i].as_py()]
                t, e, x, s, w = read(b, i, top)
                run = np.cumsum(w, axis=0) + before
                last = np.searchsorted(-t, -t, side="right") - 1  # the last row of the same time
                risk = run[last]
                risk[last == len(t) - 1] += after
                hit = np.flatnonzero(e)
                out[0] += (np.log(risk[hit, 0]) + top - s[hit]).sum()
                out[1:] += (risk[hit, 1:] / risk[hit, :1] - x[hit]).sum(axis=0)
            return out

        sums = task_sums(self.chunks, 1 + p, partial) / max(self.n_failures, 1)
        return float(sums[0]), sums[1:]

    def loss(self, coeffs) -> float:
        return self.loss_and_grad(coeffs)[0]

    def grad(self, coeffs) -> np.ndarray:
        return self.loss_and_grad(coeffs)[1]


class CoxRegression:
    """A penalised fit of a Cox model. penalty: none, l1, l2, elasticnet, tv or binarsity, with
    weight 1 / C; solver gd or agd, or bfgs for smooth penalties. warm_start begins a further
    fit where the last one ended."""

    def __init__(self, penalty: str = "l2", C: float = 1e3, solver: str = "agd", step: float | None = None, tol: float = 1e-5, max_iter: int = 100, ratio: float = 0.95, blocks=None, warm_start: bool = False, **options):
        if solver not in ("gd", "agd", "bfgs"):
            raise ValueError("solver must be gd, agd or bfgs")
        self.penalty, self.C, self.ratio, self.blocks, self.warm_start = penalty, C, ratio, blocks, warm_start
        self.solver = solvers.Solver(solver, step=step, tol=tol, max_iter=max_iter, **options)
        self.coeffs: np.ndarray | None = None

    def fit(self, rows: DataFrame, start=None) -> CoxRegression:
        """rows: time, event, features. Without failures there is nothing to fit: an error."""
        self.model = CoxLikelihood(rows)
        if not self.model.n_failures:
            raise ValueError("no failures to fit")
        if start is None:
            start = self.coeffs if self.warm_start and self.coeffs is not None else np.zeros(self.model.p)
        shrink = glm.penalty_prox(self.penalty, self.C, self.model.p, self.ratio, self.blocks)
        self.coeffs = self.solver.solve(self.model, shrink, start)
        self.history, self.converged, self.max_iter = self.solver.history, self.solver.converged, self.solver.max_iter
        return self

    def score(self, rows: DataFrame | None = None) -> float:
        """The negative partial log-likelihood of the rows fitted, or of others."""
        return (self.model if rows is None else CoxLikelihood(rows)).loss(self.coeffs)


class CaseSeries:
    """Softmax likelihood within cases: how a case's events spread over its intervals.

    features: case_id, interval, feature, value as nonzero entries; labels: case_id, interval,
    y; censoring: case_id, censoring, the number of intervals observed. per_case divides by
    all cases, otherwise by the cases with an event.
    """

    def __init__(self, features: DataFrame, labels: DataFrame, censoring: DataFrame, n_features: int, all_cases: bool = True):
        self.p = n_features
        self.cases = censoring.select("case_id", F.explode(F.when(F.col("censoring") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("censoring").cast("bigint") - 1))).alias("interval"))
        f, y = features.where("value <> 0"), labels.groupBy("case_id", "interval").agg(F.sum("y").alias("y"))
        entries = f.groupBy("case_id", "interval").agg(F.collect_list(F.struct("feature", "value")).alias("x"))  # one entry per feature
        self.rows = written(self.cases.join(entries, ["case_id", "interval"], "left").join(y, ["case_id", "interval"], "left").fillna(0, ["y"]), "case-series")
        with_events = self.rows.where("y > 0").select("case_id").distinct().count()
        self.n = max(censoring.select("case_id").distinct().count() if all_cases else with_events, 1)

    @cached_property
    def observed(self) -> np.ndarray:
        """Per column the sum over events of its value, over the cases with an event."""
        totals = self.rows.groupBy("case_id").agg(F.sum("y").alias("total")).where("total > 0")
        seen = self.rows.where("y <> 0").join(totals.select("case_id"), "case_id").select(F.explode("x").alias("v"), "y")
        out = np.zeros(self.p)
        for r in seen.groupBy(F.col("v.feature").alias("f")).agg(F.sum(F.col("v.value") * F.col("y")).alias("o")).collect():  # a row per column
            out[r["f"]] = r["o"]
        return out

    @cached_property
    def profiles(self) -> DataFrame | list[pa.RecordBatch]:
        """What the likelihood needs of the cases with an event, for many evaluations: their
        different rows, how many intervals have each, and their events. Cases alike in their
        rows are one. Packed into a row per chunk of cases; in the driver's memory if all
        chunks together are within LOCAL_BYTES."""
        p = self.p
        x = F.array_join(F.transform(F.array_sort("x"), lambda e: F.concat_ws(":", e["feature"].cast("string"), e["value"].cast("string"))), " ")
        rows = self.rows.where("case_id is not null").groupBy("case_id", F.coalesce(x, F.lit("")).alias("x")).agg(F.count("*").alias("n"), F.sum("y").alias("y"))
        cases = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("x", "n"))).alias("rows"), F.sum("y").cast("double").alias("total"))
        alike = cases.where("total > 0").groupBy("rows").agg(F.sum("total").alias("total"))

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                flat = b.column(0).flatten()
                kinds = flat.field(0).dictionary_encode()
                entries = [(k, *e.split(":")) for k, text in enumerate(kinds.dictionary.to_pylist()) for e in text.split()]
                of, at, value = (np.array([e[i] for e in entries], kind) for i, kind in enumerate(("i4", "i4", "f8")))
                parts = b.column(0).value_lengths().to_numpy().astype("i4"), b.column(1).to_numpy().astype("f8"), kinds.indices.to_numpy().astype("i4"), flat.field(1).to_numpy().astype("f8"), of, at, value
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in parts], names)

        names = ["rows", "total", "kind", "n", "of", "at", "value"]
        ship(self.rows.sparkSession)
        chunks = written(alike.mapInArrow(packed, ", ".join(f"{n} binary" for n in names)), "case-profiles")
        size = chunks.agg(F.sum(sum((F.length(n) for n in names), F.lit(0)))).first()[0] or 0
        return chunks.toArrow().to_batches() if size <= LOCAL_BYTES else chunks

    def loss_and_grad(self, coeffs) -> tuple[float, np.ndarray]:
        """Of every case the logarithm of its norm, times its events, less what is linear."""
        c, p = np.asarray(coeffs, float), self.p

        def partial(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(1 + p)
            for chunk in zip(*(b.column(i) for i in range(b.num_columns)), strict=True):
                rows, total, kind, n, of, at, value = (np.frombuffer(a.as_buffer(), t) for a, t in zip(chunk, ("i4", "f8", "i4", "f8", "i4", "i4", "f8"), strict=True))
                begin = np.cumsum(rows) - rows
                kinds = int(kind.max()) + 1
                s = np.bincount(of, value * c[at], kinds)[kind]
                top = np.maximum.reduceat(s, begin)
                e = n * np.exp(s - np.repeat(top, rows))
                z = np.add.reduceat(e, begin)
                out[0] += total @ (np.log(z) + top)
                share = np.bincount(kind, e * np.repeat(total / z, rows), kinds)
                out[1:] += np.bincount(at, share[of] * value, p)
            return out

        if isinstance(self.profiles, list):
            sums = sum((partial(b) for b in self.profiles), np.zeros(1 + p))
        else:
            sums = task_sums(self.profiles, 1 + p, partial)
        return float(sums[0] - c @ self.observed) / self.n, (sums[1:] - self.observed) / self.n

    def loss(self, coeffs) -> float:
        return self.loss_and_grad(coeffs)[0]

    def grad(self, coeffs) -> np.ndarray:
        return self.loss_and_grad(coeffs)[1]

    def lipschitz_max(self) -> float:
        """Over cases, the largest squared distance of two rows, times the case's events, over
        four times the number of cases."""
        p = self.p
        # A case's rows are its intervals, at most its censoring.
        cases = self.rows.groupBy("case_id").agg(F.collect_list(F.coalesce("x", F.array().cast(dict(self.rows.dtypes)["x"]))).alias("xs"), F.sum("y").cast("double").alias("n")).where("n > 0")

        def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                best = 0.0
                for rows, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    m = np.zeros((len(rows), p))
                    for i, row in enumerate(rows):
                        for v in row:
                            m[i, v["feature"]] = v["value"]
                    sq = (m * m).sum(1)
                    best = max(best, n * float((sq[:, None] + sq[None] - 2 * m @ m.T).max(initial=0.0)))
                yield pa.RecordBatch.from_arrays([pa.array([best])], ["m"])

        return float(cases.select("xs", "n").mapInArrow(most, "m double").agg(F.max("m")).first()[0] or 0.0) / (4 * self.n)


class LaggedCaseSeries:
    """Case series with lagged exposures, a total-variation and a group penalty per feature.

    n_lags gives the lags of every feature; its coefficients are n_lags + 1 in a row.
    """

    def __init__(self, n_lags: list[int], c_tv: float | None = None, c_group: float | None = None, penalized: list[bool] | None = None, max_iter: int = 200):
        self.n_lags, self.c_tv, self.c_group, self.max_iter = list(n_lags), c_tv, c_group, max_iter
        self.penalized = penalized or [True] * len(self.n_lags)
        self.starts = np.r_[0, np.cumsum(np.array(self.n_lags) + 1)].astype(int)

    def _blocks(self):
        return list(zip(self.starts[:-1], np.array(self.n_lags) + 1, strict=True))

    def _penalty(self, c: np.ndarray) -> float:
        value = 0.0
        for (a, n), on in zip(self._blocks(), self.penalized, strict=True):
            if on and self.c_tv:
                value += np.abs(np.diff(c[a : a + n])).sum() / self.c_tv
            if on and self.c_group:
                value += math.sqrt(n) * np.linalg.norm(c[a : a + n]) / self.c_group
        return float(value)

    def _shrunk(self, c: np.ndarray, step: float) -> np.ndarray:
        """The penalty's proximal point: that of the group norm at that of the total variation,
        as scaling a block leaves the slopes of its variation as they are."""
        out = c.copy()
        for (a, n), on in zip(self._blocks(), self.penalized, strict=True):
            if on and self.c_tv and n > 1:
                out[a : a + n] = total_variation_prox(out[a : a + n], step / self.c_tv)
            if on and self.c_group:
                norm = np.linalg.norm(out[a : a + n])
                out[a : a + n] *= max(1 - step * math.sqrt(n) / self.c_group / norm, 0.0) if norm > 0 else 0.0
        return out

    def start(self, series: CaseSeries, low: float = -4.0, high: float = 4.0) -> np.ndarray:
        """Logarithms of events over expected events per lagged column, one half added to
        both, within bounds."""
        out = np.zeros(series.p)
        for r in score_ratios(series).collect():  # a row per column
            out[r["feature"]] = min(max(math.log((r["observed"] + 0.5) / (r["expected"] + 0.5)), low), high)
        return out

    def fit(self, features: DataFrame, labels: DataFrame, censoring: DataFrame) -> LaggedCaseSeries:
        from tidewire.operators.longitudinal import lagged

        self.series = CaseSeries(lagged(features, censoring, self.n_lags), labels, censoring, int(self.starts[-1]), all_cases=False)

        def smooth(c):
            value, g = self.series.loss_and_grad(c)
            return value + 5e-9 * c @ c, g + 1e-8 * c

        report: dict = {}
        self.coeffs = minimise_sum(smooth, self._penalty, self._shrunk, self.start(self.series), max_iter=self.max_iter, tol=1e-7, report=report)
        self.converged, self.history = report["converged"], [report]
        return self

    def score(self) -> float:
        return self.series.loss(self.coeffs)

    def intervals(self, level: float = 0.95) -> list[tuple[float, float]]:
        """Normal intervals of the coefficients from observed and expected events."""
        z = float(normal_quantile(1 - (1 - level) / 2))
        width = np.full(len(self.coeffs), np.inf)
        for r in score_ratios(self.series).collect():
            width[r["feature"]] = z * math.sqrt(1 / (r["observed"] + 0.5) + 1 / (r["expected"] + 0.5))
        return [(float(c - w), float(c + w)) for c, w in zip(self.coeffs, width, strict=True)]


def score_ratios(series: CaseSeries) -> DataFrame:
    """feature, observed, expected: events in the intervals of a column, and the events that
    cases would have there if theirs spread evenly over their intervals."""
    total = series.rows.groupBy("case_id").agg(F.sum("y").alias("total"), F.count("*").alias("m"))
    rows = series.rows.join(total, "case_id").select(F.explode("x").alias("v"), "y", (F.col("total") / F.col("m")).alias("even"))
    return rows.groupBy(F.col("v.feature").alias("feature")).agg(F.sum(F.col("v.value") * F.col("y")).alias("observed"), F.sum(F.col("v.value") * F.col("even")).alias("expected"))
