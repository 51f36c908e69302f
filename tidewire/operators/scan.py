"""Exponentially decayed sums over the strict past, as a distributed scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.session import written


def _scan(decay: np.ndarray, add: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive scan of s[k] = decay[k] * s[k-1] + add[k] by doubling; also the decay products.

    decay is (n, u), add (n, d, u). Every factor is at most 1, so nothing overflows however
    long the gaps are; doubling stops once the products have died out.
    """
    a, b = decay.copy(), add.copy()
    step = 1
    while step < len(a):
        b[step:] += a[step:, None, :] * b[:-step]
        a[step:] *= a[:-step].copy()
        step *= 2
        if not (a[step:] > 0).any():
            break
    return a, b


class _Carry:
    """What a task remembers between batches: the last instant, its state before and after."""

    def __init__(self, n_nodes: int, decays: np.ndarray):
        self.r, self.t = None, 0.0
        self.left = np.zeros((n_nodes, len(decays)))
        self.after = self.left.copy()


def decayed_sums(rows: DataFrame, n_nodes: int, decays: list[float], node: str = "node", by: str = "r", time: str = "t") -> DataFrame:
    """Add phi to every row: for node v and decay u the sum of w * exp(-decay * (t - s)) over
    the rows of v at times s < t in the same realization, at place v * len(decays) + u.

    The weight w is the decay itself, so that an exponential kernel has integral 1; a decay of
    0 counts with weight 1. Rows of a null node are query points: they get phi and add
    nothing. Rows at equal times don't see each other. Rows with a null realization or time
    are dropped.

    The rows are sorted by realization and time over all tasks, whichever way realizations
    are sized, so one huge realization spreads over many tasks. A task scans its own rows and
    leaves a summary; the driver chains the summaries, one row per task, and a last narrow
    step adds to a task's first realization what the tasks before it left over.
    """
    spark = rows.sparkSession
    rates = np.array(decays, float)
    weight = np.where(rates > 0, rates, 1.0)
    n_u = len(rates)
    kept = rows.where(F.col(by).isNotNull() & F.col(time).isNotNull())
    # Rows grow by the features, so tasks aren't merged by the size they have before.
    ordered = kept.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by, time).sortWithinPartitions(by, time)
    own = kept.schema.names
    at_r, at_t, at_node = (own.index(c) for c in (by, time, node))
    out_names = [*own, "phi", "_part", "_last"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, c, first = TaskContext.get().partitionId(), _Carry(n_nodes, rates), None
        first_row = last_row = None
        for b in batches:
            if not b.num_rows:
                continue
            r = b.column(at_r).to_numpy(zero_copy_only=False)
            t = b.column(at_t).to_numpy(zero_copy_only=False).astype(float)
            v = b.column(at_node).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            if first is None:
                first, first_row = (r[0], t[0]), b.slice(0, 1)
            new = np.r_[True, (np.diff(r) != 0) | (np.diff(t) != 0)]
            start = np.flatnonzero(new)
            ir, it = r[start], t[start]
            which = np.cumsum(new) - 1
            add = np.zeros((len(start), n_nodes, n_u))
            ok = v >= 0
            np.add.at(add, (which[ok], v[ok]), weight)
            gap = np.diff(it, prepend=it[0])
            same = np.r_[False, ir[1:] == ir[:-1]]
            decay = np.exp(-np.outer(np.where(same, gap, 0.0), rates)) * same[:, None]
            joins = c.r is not None and ir[0] == c.r
            pending = joins and it[0] == c.t
            if joins:
                decay[0] = np.exp(-rates * (it[0] - c.t))
            product, after = _scan(decay, add)
            if joins:
                after += product[:, None, :] * c.after
            # The state before an instant: the state after the one before, decayed.
            before = np.zeros_like(after)
            before[1:] = decay[1:, None, :] * after[:-1]
            before[0] = decay[0] * c.after if joins else 0.0
            if pending:
                before[0] = c.left
            c.r, c.t, c.left, c.after = ir[-1], it[-1], before[-1].copy(), after[-1].copy()
            phi = before[which].reshape(len(r), -1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(phi.ravel()), n_nodes * n_u).cast(pa.list_(pa.float64()))
            last_row = b.slice(b.num_rows - 1, 1)
            none = pa.nulls(b.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.full(b.num_rows, part, np.int32)), none], out_names)
        if last_row is not None:
            # Summary rows: where the task began, and the last realization's time and state.
            for row, state in ((first_row, [float(first[1])]), (last_row, [float(first[0] == c.r), float(c.t), *c.after.ravel().tolist()])):
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([[]], pa.list_(pa.float64())), pa.array([part], pa.int32()), pa.array([state], pa.list_(pa.float64()))], out_names)

    schema = T.StructType([*kept.schema.fields, T.StructField("phi", T.ArrayType(T.DoubleType())), T.StructField("_part", T.IntegerType()), T.StructField("_last", T.ArrayType(T.DoubleType()))])
    local = written(ordered.mapInArrow(scanned, schema), "scan")
    told: dict[int, dict] = {}
    for e in local.where("_last is not null").select("_part", F.col(by).alias("_r"), "_last").collect():  # two rows per task
        told.setdefault(e["_part"], {})["first" if len(e["_last"]) == 1 else "last"] = e
    carried = []
    state, s_r, s_t = None, None, 0.0
    for part, e in sorted(told.items(), key=lambda x: (x[1]["first"]["_r"], x[1]["first"]["_last"][0])):
        begin, end = e["first"]["_r"], e["last"]
        single, t_last, after = bool(end["_last"][0]), end["_last"][1], np.array(end["_last"][2:]).reshape(n_nodes, n_u)
        if state is not None and s_r == begin:
            carried.append((part, s_r, s_t, state.ravel().tolist()))
            if single:
                after = after + state * np.exp(-rates * (t_last - s_t))
        state, s_r, s_t = after, end["_r"], t_last
    body = local.where("_last is null").drop("_last")
    if not carried:
        return body.drop("_part")
    kind = kept.schema[by].dataType.simpleString()
    extra = spark.createDataFrame(carried, f"_part int, _cr {kind}, _ct double, _cs array<double>")
    factors = F.array(*(F.exp(F.lit(-float(d)) * (F.col(time) - F.col("_ct"))) for d in rates))
    joined = body.join(F.broadcast(extra), (body["_part"] == extra["_part"]) & (body[by] == extra["_cr"]), "left")
    fixed = F.when(F.col("_ct").isNull(), F.col("phi")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(n_nodes * n_u - 1)), lambda i: F.col("phi")[i] + F.col("_cs")[i] * factors[i % n_u]))
    return joined.select(*own, fixed.alias("phi"))


def _spread(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows sorted by ranges over all tasks, written with the number of the task's range."""
    return written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)


def running_totals(rows: DataFrame, order: str, values: list[str], descending: bool = False) -> DataFrame:
    """Add to rows of distinct order the running sums of the values, as cum_<value>.

    Rows are sorted over all tasks; sums within a task are windows over its own rows, and the
    totals of the tasks before it, one row per task, are added by a small join. No task holds
    more than its range.
    """
    by = F.col(order).desc() if descending else F.col(order).asc()
    sorted_ = _spread(rows, [by], "totals")
    totals = sorted_.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values), F.min(order).alias("_o")).collect()
    base, run = [], dict.fromkeys(values, 0.0)
    for r in sorted(totals, key=lambda r: r["_o"], reverse=descending):
        base.append((r["_part"], *(float(run[v]) for v in values)))
        for v in values:
            run[v] += float(r[v] or 0)
    spark = rows.sparkSession
    before = spark.createDataFrame(base, "_part int, " + ", ".join(f"`_b_{v}` double" for v in values))
    w = Window.partitionBy("_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    summed = sorted_.select("*", *(F.sum(v).over(w).alias(f"_s_{v}") for v in values)).join(F.broadcast(before), "_part")
    return summed.select(*rows.columns, *((F.col(f"_s_{v}") + F.col(f"_b_{v}")).alias(f"cum_{v}") for v in values))


def ranks(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Add rank, from 1 within each value of by in the order given, and total, the value's rows.

    Ranges of (by, order) are ranked task by task; the counts of the ranges before, one per
    range and value, are added by a small join, so a value with most of the rows spreads too.
    """
    sorted_ = _spread(rows.where(F.col(by).isNotNull()), [F.col(by), *(F.col(c) for c in order)], "ranks")
    counts = sorted_.groupBy("_part", by).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("o"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("_part", by, before.alias("_before"), F.sum("n").over(Window.partitionBy(by)).alias("total"))
    own = F.row_number().over(Window.partitionBy("_part", by).orderBy(*order))
    return sorted_.withColumn("_own", own).join(base, ["_part", by]).select(*rows.columns, (F.col("_own") + F.col("_before")).alias("rank"), "total")


def previous(rows: DataFrame, by: list[str], order: list[str], value: str, name: str = "before") -> DataFrame:
    """Add the value of the row before in the order given, within the values of by; null for
    the first. Only the last row of each range, one per task, is carried over."""
    keys = [*by, *order]
    sorted_ = _spread(rows, [F.col(c) for c in keys], "previous")
    last = sorted_.groupBy("_part").agg(F.max_by(F.struct(*by, value), F.struct(*keys)).alias("l"), F.min(F.struct(*keys)).alias("o")).collect()
    carried, kept = [], None
    for r in sorted(last, key=lambda r: tuple(r["o"])):
        if kept is not None:
            carried.append((r["_part"], *kept))
        kept = tuple(r["l"])
    w = Window.partitionBy("_part", *by).orderBy(*order)
    marked = sorted_.withColumn(name, F.lag(value).over(w)).withColumn("_k", F.row_number().over(w))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    extra = rows.sparkSession.createDataFrame(carried, ", ".join(["_part int", *(f"`_c_{c}` {kinds[c]}" for c in by), f"_cv {kinds[value]}"]))
    match = [marked["_part"] == extra["_part"], marked["_k"] == 1, *(marked[c] == extra[f"_c_{c}"] for c in by)]
    on = match[0]
    for m in match[1:]:
        on = on & m
    return marked.join(F.broadcast(extra), on, "left").select(*rows.columns, F.coalesce(name, "_cv").alias(name))
