"""Array files: event arrays in .npz, SVMlight members of .tar.gz, matrices, checksums."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.session import ship
from tidewire.sources.svm_text import read_svmlight


def read_npz_events(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Times in .npz files: path, key, node, t.

    An array of two axes has a row per node, one of objects a times array per node, and one
    axis is a single node. Each file is read by one task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    for key in z.files:
                        a = z[key]
                        for node, t in enumerate(a if a.ndim > 1 else [a]):
                            t = np.asarray(t, float)
                            t = t[~np.isnan(t)]  # ragged rows are filled with NaN
                            n = len(t)
                            yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([key] * n, pa.string()), pa.array(np.full(n, node, np.int32)), pa.array(t)], ["path", "key", "node", "t"])

    ship(spark)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(read, "path string, key string, node int, t double")


def read_tar_lines(spark: SparkSession, paths: str | list[str], pattern: str = ".svm") -> DataFrame:
    """member, line_no, raw of all members whose name holds the pattern, in .tar archives,
    compressed or not. Members are streamed, so a task holds one archive and one line."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        if not m.isfile() or pattern not in m.name:
                            continue
                        rows = []
                        for i, line in enumerate(tar.extractfile(m), 1):
                            rows.append((m.name, i, line.decode("utf-8", "replace").rstrip("\n")))
                            if len(rows) == 10_000:
                                yield _lines(rows)
                                rows = []
                        if rows:
                            yield _lines(rows)

    def _lines(rows):
        c = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string())], ["member", "line_no", "raw"])

    ship(spark)
    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(read, "member string, line_no bigint, raw string")


def checksums(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, size and SHA-256 of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_matrix(spark: SparkSession, a: np.ndarray, path: str) -> None:
    """A vector or matrix of the driver as Parquet rows of i and values."""
    a = np.atleast_2d(np.asarray(a, float))
    spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(a)], "i bigint, values array<double>").write.parquet(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("i bigint, values array<double>").parquet(path)


class Catalog:
    """Named datasets on reachable paths: format is parquet, svmlight, npz or lines in tar."""

    def __init__(self, entries: dict[str, dict]):
        self.entries = entries

    def table(self, spark: SparkSession) -> DataFrame:
        """name, format, path of all entries."""
        return spark.createDataFrame([(k, v["format"], str(v["path"])) for k, v in sorted(self.entries.items())], "name string, format string, path string")

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        e = self.entries[name]
        read = {"parquet": lambda s, p: s.read.parquet(p), "svmlight": read_svmlight, "npz": read_npz_events, "tar": read_tar_lines}[e["format"]]
        return read(spark, e["path"])
