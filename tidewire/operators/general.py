"""Intensities and compensators under any matrix of kernels."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.data import EventData
from tidewire.functions.kernels import Exponential, ExponentialSum, Kernel, Zero
from tidewire.functions.prox import Prox
from tidewire.operators import bands, hawkes
from tidewire.operators.scan import decayed_sums
from tidewire.session import ship


def _exponential(kernels: list[list[Kernel]]) -> tuple[np.ndarray, list[float]]:
    """alpha[i, j, u] of the exponential parts of a kernel matrix, and the decays."""
    n = len(kernels)
    parts = [(i, j, a, b) for i, row in enumerate(kernels) for j, k in enumerate(row) for a, b in ([(k.intensity, k.decay)] if isinstance(k, Exponential) else zip(k.intensities, k.decays, strict=True) if isinstance(k, ExponentialSum) else [])]
    decays = sorted({p[3] for p in parts})
    alpha = np.zeros((n, n, len(decays)))
    for i, j, a, b in parts:
        alpha[i, j, decays.index(b)] += a
    return alpha, decays


def _others(kernels: list[list[Kernel]]) -> list[tuple[int, int, Kernel]]:
    out = [(i, j, k) for i, row in enumerate(kernels) for j, k in enumerate(row) if not isinstance(k, (Zero, Exponential, ExponentialSum))]
    if any(math.isinf(k.support) for _, _, k in out):
        raise ValueError("kernels other than exponentials need a finite support")
    return out


def _pair_sums(data: EventData, others, column: Callable[[Kernel, Column], Column] | None, number: Callable[[Kernel, np.ndarray], np.ndarray]) -> DataFrame:
    """eid, extra: sums over the pairs within the supports, as Columns or, where a kernel of
    one's own has none, in numpy on Arrow batches."""
    p = bands.band_pairs(data.events, data.events, max(k.support for _, _, k in others)).where("lag > 0").select("eid", "node", "s_node", "lag")
    try:
        if column is None:
            raise NotImplementedError
        value = F.lit(0.0)
        for i, j, k in others:
            value = F.when((F.col("node") == i) & (F.col("s_node") == j), column(k, F.col("lag"))).otherwise(value)
        p = p.select("eid", value.alias("x"))
    except NotImplementedError:

        def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                node, source, lag = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                x = np.zeros(len(lag))
                for i, j, k in others:
                    own = (node == i) & (source == j)
                    x[own] = number(k, lag[own])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x)], ["eid", "x"])

        p = p.mapInArrow(valued, "eid bigint, x double")
    return p.groupBy("eid").agg(F.sum("x").alias("extra"))


def kernel_intensities(data: EventData, kernels: list[list[Kernel]], baseline: Callable[[Column], Column] | list[float]) -> DataFrame:
    """events with intensity, of the own node just before the event.

    baseline is a number per node, or makes a Column of the time (any function of it and of
    the column node). Exponential parts come from the scan; other kernels, of finite support,
    from the band join. Events at one time don't see each other.
    """
    alpha, decays = _exponential(kernels)
    base = hawkes.by_node(baseline) if isinstance(baseline, list) else baseline(F.col("t"))
    out = data.events.withColumn("intensity", base)
    if decays:
        p = hawkes.ExpParameters(np.zeros(len(kernels)), alpha, decays)
        out = hawkes.exp_features(data, p.rates).withColumn("intensity", base + hawkes.dot("phi", p.weights())).drop("phi")
    others = _others(kernels)
    if others:
        extra = _pair_sums(data, others, lambda k, lag: k.value(lag), lambda k, lag: k.values(lag))
        out = out.join(extra, "eid", "left").withColumn("intensity", F.col("intensity") + F.coalesce("extra", F.lit(0.0))).drop("extra")
    return out


def kernel_compensators(data: EventData, kernels: list[list[Kernel]], baseline: list[float]) -> DataFrame:
    """events with compensator of the own node, for constant baselines.

    Beyond a kernel's support every earlier event adds its whole integral; within it the pairs
    of the band take off what is still to come.
    """
    alpha, decays = _exponential(kernels)
    others = _others(kernels)
    n = len(kernels)
    whole = np.zeros((n, n))
    for i, j, k in others:
        whole[i, j] = k.primitive(k.support)
    rates = [*decays, 0.0]
    f = decayed_sums(data.events, data.n_nodes, rates)
    w = np.zeros((n, n, len(rates)))
    if decays:
        w[:, :, :-1] = -alpha / np.array(decays)
        w[:, :, -1] = alpha.sum(axis=2)
    w[:, :, -1] += whole
    out = f.withColumn("compensator", hawkes.by_node(baseline) * F.col("t") + hawkes.dot("phi", w.reshape(n, -1))).drop("phi")
    if others:
        rest = lambda k, lag: np.array([k.primitive(k.support) - k.primitive(float(x)) if x < k.support else 0.0 for x in lag])
        out = out.join(_pair_sums(data, others, None, rest), "eid", "left").withColumn("compensator", F.col("compensator") - F.coalesce("extra", F.lit(0.0))).drop("extra")
    return out


def proxed(rows: DataFrame, p: Prox, column: str = "x", step: float = 1.0) -> DataFrame:
    """rows with a prox applied to the coefficient vector in every row. Null vectors stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            new = [None if x.as_py() is None else p(x.values.to_numpy(zero_copy_only=False), step) for x in b.column(at)]
            yield b.set_column(at, column, pa.array(new, pa.list_(pa.float64())))

    ship(rows.sparkSession)
    return rows.mapInArrow(run, T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == column else f for f in rows.schema]))


def matched_bases(found: np.ndarray, truth: np.ndarray) -> list[tuple[int, int, float]]:
    """Greedy pairs (found, true, distance) of basis functions scaled to one integral each."""
    a, b = (np.asarray(x, float) / np.maximum(np.abs(np.asarray(x, float)).sum(axis=1, keepdims=True), 1e-300) for x in (found, truth))
    d = np.abs(a[:, None, :] - b[None, :, :]).sum(axis=2)
    out = []
    for _ in range(min(d.shape)):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        out.append((int(i), int(j), float(d[i, j])))
        d[i, :] = d[:, j] = np.inf
    return out
