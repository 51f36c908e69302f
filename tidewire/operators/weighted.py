"""Sums over events of features over intensity, the one aggregate that all fits share."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import _remove, shared_dir, ship, written


def task_sums(df: DataFrame, size: int, partial) -> np.ndarray:
    """Add up vectors of the given size, one per task, as partial makes them of its batches.

    The vectors are added in Spark, so the driver gets size numbers however many tasks run.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += partial(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    ship(df.sparkSession)
    rows = df.mapInArrow(summed, "v array<double>").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["pos"]] = r["s"]
    return out


def dense(b: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    """A batch's list column as a matrix; lists of structs (at, n) are spread out."""
    a = b.column(b.schema.get_field_index(column))
    if pa.types.is_struct(a.type.value_type):
        out = np.zeros((len(a), width))
        lengths = a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = a.flatten()
        np.add.at(out, (np.repeat(np.arange(len(a)), lengths), flat.field(0).to_numpy(zero_copy_only=False)), flat.field(1).to_numpy(zero_copy_only=False).astype(float))
        return out
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), width)


@dataclass
class Sums:
    """n events; bad of them with an intensity that isn't positive, left out of the others;
    logs: sum of log intensity; inverse[u]: of 1/intensity over events of u; over[u, f]: of
    feature f over intensity."""

    n: int
    bad: int
    logs: float
    inverse: np.ndarray
    over: np.ndarray


#: Bytes of a feature table that the driver may keep for an iteration.
LOCAL_BYTES = 32 << 20

#: Numbers of all tasks together that the driver adds up itself.
DRIVER_SUMS = 1_000_000


@dataclass
class Packed:
    """A feature table for an iteration of hundreds of steps: rows sorted by node and packed
    into a few arrays per chunk. Chunks of at most LOCAL_BYTES together are in the driver's
    memory, so that no step takes a job; else a step reads them without unpacking rows. The
    sums are the same either way."""

    df: DataFrame
    chunks: DataFrame | RDD | list[pa.RecordBatch]
    parts: int = 0


def _chunk(b: pa.RecordBatch, width: int) -> pa.RecordBatch:
    """A batch of node, phi and perhaps n, how many rows a row stands for, as one row."""
    node = b.column(0).to_numpy(zero_copy_only=False).astype("i4")
    order = np.argsort(node, kind="stable")
    n = b.column(2).to_numpy(zero_copy_only=False).astype("f8") if b.num_columns > 2 else np.ones(0)
    arrays = node[order], dense(b, "phi", width)[order], n[order] if len(n) else n
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays], ["node", "phi", "n"])


def iterated(features: DataFrame, rows: int, width: int, repeated: bool = False) -> Packed:
    """A written table of node and phi (width numbers) for many calls of weighted_sums: kept
    local if its known number of rows bounds it by LOCAL_BYTES. repeated tells that phi are
    counts, of which many are equal: equal rows are then one, with their number."""
    table = features.select("node", "phi")
    if repeated:
        table = written(table.groupBy("node", "phi").agg(F.count("*").alias("n")), "equal-features")
        rows = table.count()
    if rows * (width + 1 + repeated) * 8 <= LOCAL_BYTES:
        return Packed(features, [_chunk(b, width) for b in table.toArrow().combine_chunks().to_batches() if b.num_rows])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _chunk(b, width)

    ship(features.sparkSession)
    root = shared_dir(features.sparkSession)
    if root.startswith(("file:", "/")):
        folder = f"{root}/packed-{uuid.uuid4().hex}"
        atexit.register(_remove, features.sparkSession, folder)
        return Packed(features, _files(table, packed, folder.removeprefix("file:")))
    chunks = written(table.mapInArrow(packed, "node binary, phi binary, n binary"), "packed-features")
    return Packed(features, chunks, chunks.rdd.getNumPartitions())


def _files(table: DataFrame, packed, folder: str) -> RDD:
    """Chunks as plain files in a folder that all executors see, one of each task, with a
    record of its path and the lengths of its arrays: a step then reads them past the JVM."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        path, lengths = f"{folder}/{uuid.uuid4().hex}", []
        with open(path, "wb") as out:
            for b in packed(batches):
                for a in b.columns:
                    lengths.append(out.write(a[0].as_buffer()))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([lengths], pa.list_(pa.int64()))], ["path", "lengths"])

    files = [(r["path"], r["lengths"]) for r in table.mapInArrow(stored, "path string, lengths array<bigint>").collect() if r["lengths"]]
    return table.sparkSession.sparkContext.parallelize(files, max(len(files), 1))


def _file_sums(file: tuple[str, list[int]], mu: np.ndarray, weights: np.ndarray) -> np.ndarray:
    path, lengths = file
    total = np.zeros(3 + len(mu) + weights.size)
    with open(path, "rb") as f:
        for k in range(0, len(lengths), 3):
            parts = [f.read(n) for n in lengths[k : k + 3]]
            if [len(x) for x in parts] != lengths[k : k + 3]:
                raise ValueError(f"{path} is cut short")
            total += _row_sums(parts, mu, weights)
    return total


def _chunk_sums(b: pa.RecordBatch, mu: np.ndarray, weights: np.ndarray) -> np.ndarray:
    rows = zip(*b.columns, strict=True)
    return sum((_row_sums([a.as_buffer() for a in row], mu, weights) for row in rows), np.zeros(3 + len(mu) + weights.size))


def _row_sums(row: list, mu: np.ndarray, weights: np.ndarray) -> np.ndarray:
    d, width = weights.shape
    head, inverse, over = np.zeros(3), np.zeros(d), np.zeros((d, width))
    node, phi, n = (np.frombuffer(a, t) for a, t in zip(row, ("i4", "f8", "f8"), strict=True))
    phi, cut = phi.reshape(len(node), width), np.searchsorted(node, np.arange(d + 1))
    if cut[0] or cut[-1] < len(node):
        raise ValueError("a node outside the range")
    for u, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        own, k = phi[i:j], n[i:j] if len(n) else np.ones(j - i)
        lam = mu[u] + own @ weights[u]
        ok = lam > 0
        lam = np.where(ok, lam, 1.0)
        inv = np.where(ok, k / lam, 0.0)
        head += k.sum(), k[~ok].sum(), k @ np.log(lam)
        inverse[u] += inv.sum()
        over[u] += inv @ own
    return np.r_[head, inverse, over.ravel()]


def _packed_sums(p: Packed, mu: np.ndarray, weights: np.ndarray) -> np.ndarray:
    size = 3 + len(mu) + weights.size
    if isinstance(p.chunks, list):
        return sum((_chunk_sums(b, mu, weights) for b in p.chunks), np.zeros(size))
    if isinstance(p.chunks, RDD):
        sums = p.chunks.map(lambda file: _file_sums(file, mu, weights))
        return sums.treeReduce(np.add) if p.chunks.getNumPartitions() * size > DRIVER_SUMS else sum(sums.collect(), np.zeros(size))
    if p.parts * size > DRIVER_SUMS:
        return task_sums(p.chunks, size, lambda b: _chunk_sums(b, mu, weights))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum((_chunk_sums(b, mu, weights) for b in batches), np.zeros(size))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    return sum((np.frombuffer(r["v"]) for r in p.chunks.mapInArrow(summed, "v binary").collect()), np.zeros(size))


def weighted_sums(features: DataFrame | Packed, mu: np.ndarray, weights: np.ndarray) -> Sums:
    """Sums over a table of node and phi, for intensity mu[node] + weights[node] . phi."""
    d, width = weights.shape

    def partial(b: pa.RecordBatch) -> np.ndarray:
        node = b.column(b.schema.get_field_index("node")).to_numpy(zero_copy_only=False).astype(np.int64)
        phi = dense(b, "phi", width)
        lam = mu[node] + np.einsum("kf,kf->k", phi, weights[node])
        ok = lam > 0
        inv = np.where(ok, 1 / np.where(ok, lam, 1), 0)
        over = np.zeros((d, width))
        for u in range(d):
            own = node == u
            over[u] = inv[own] @ phi[own]
        return np.r_[len(node), (~ok).sum(), np.log(lam[ok]).sum(), np.bincount(node, inv, d), over.ravel()]

    if isinstance(features, Packed):
        s = _packed_sums(features, np.asarray(mu, float), np.asarray(weights, float))
    else:
        s = task_sums(features.select("node", "phi"), 3 + d + d * width, partial)
    return Sums(int(round(s[0])), int(round(s[1])), float(s[2]), s[3 : 3 + d], s[3 + d :].reshape(d, width))
