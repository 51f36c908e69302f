"""Features of events from the events in a band of time before them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.data import EventData


def band_pairs(left: DataFrame, right: DataFrame, behind: float, ahead: float = 0.0) -> DataFrame:
    """Pairs of left rows and right rows of the same realization with -ahead <= t - s <= behind,
    where t is the left time and s the right one.

    Columns of right get the prefix s_. Time is cut into buckets as wide as the band; right
    rows are repeated into the two or three buckets that can meet them, so the join is an
    equi-join that spreads one realization over its buckets, never over all its pairs.
    """
    width = max(behind + ahead, 1e-300)
    bucket = F.floor(F.col("t") / F.lit(width))
    a = left.withColumn("_b", bucket)
    reach = F.sequence(F.floor((F.col("t") - F.lit(ahead)) / F.lit(width)), F.floor((F.col("t") + F.lit(behind)) / F.lit(width)))
    b = right.select(*(F.col(c).alias(f"s_{c}") for c in right.columns), F.explode(reach).alias("s__b"))
    lag = F.col("t") - F.col("s_t")
    return a.join(b, (F.col("r") == F.col("s_r")) & (F.col("_b") == F.col("s__b")) & (lag <= F.lit(behind)) & (lag >= F.lit(-ahead))).drop("_b", "s__b").withColumn("lag", lag)


def _below(lag: Column, edges: list[float], first: int = 0) -> Column:
    """How many of the edges lie below lag: a tree of comparisons, as deep as their logarithm."""
    if not edges:
        return F.lit(first)
    half = len(edges) // 2
    return F.when(lag > F.lit(edges[half]), _below(lag, edges[half + 1 :], first + half + 1)).otherwise(_below(lag, edges[:half], first))


def right_closed_bin(lag: Column, edges) -> Column:
    """Bin m with edges[m] < lag <= edges[m + 1]; lag 0 belongs to bin 0."""
    return F.when(lag == 0, 0).otherwise(_below(lag, [float(e) for e in edges]) - 1)


def left_closed_bin(lag: Column, width: float) -> Column:
    """Bin floor(lag / width)."""
    return F.floor(lag / F.lit(float(width))).cast("int")


def dense_features(data: EventData, pairs: DataFrame, parts: list[Column]) -> DataFrame:
    """events with phi: at v * len(parts) + m the sum of parts[m] over an event's pairs with v.

    Pairs are added up per event and node before anything is gathered; an event gathers at
    most one entry per node. Events without pairs have zeros.
    """
    sums = pairs.groupBy("eid", "s_node").agg(F.array(*(F.sum(p) for p in parts)).alias("x"))
    maps = sums.groupBy("eid").agg(F.map_from_entries(F.collect_list(F.struct("s_node", "x"))).alias("m"))
    zeros = F.array_repeat(F.lit(0.0), len(parts))
    spread = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(data.n_nodes - 1)), lambda v: F.coalesce(F.try_element_at(F.col("m"), v), zeros)))
    flat = F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), len(parts) * data.n_nodes)).otherwise(spread)
    return data.events.join(maps, "eid", "left").select("r", "node", "t", "eid", flat.alias("phi"))


def bin_counts(data: EventData, edges, strict: bool = False) -> DataFrame:
    """Counts of earlier events by node and right-closed bin of their lag; phi as dense_features.

    Events at the same time count in bin 0 unless strict; an event never counts itself.
    """
    edges = [float(e) for e in edges]
    p = band_pairs(data.events, data.events, edges[-1]).where(F.col("lag") < F.lit(edges[-1]))
    p = p.where(F.col("lag") > 0) if strict else p.where("eid <> s_eid")
    m = right_closed_bin(F.col("lag"), edges)
    p = p.withColumn("m", m).where("m >= 0")
    return dense_features(data, p, [(F.col("m") == i).cast("double") for i in range(len(edges) - 1)])


def step_counts(data: EventData, width: float, size: int) -> DataFrame:
    """Counts of earlier or simultaneous other events by node and left-closed bin."""
    p = band_pairs(data.events, data.events, width * size).where("eid <> s_eid").withColumn("m", left_closed_bin(F.col("lag"), width)).where(F.col("m") < size)
    return dense_features(data, p, [(F.col("m") == i).cast("double") for i in range(size)])


def gaussian_features(data: EventData, means, std: float) -> DataFrame:
    """Sums of normal densities of the lags to strictly earlier events, by node and mean.

    Lags beyond nine deviations above the largest mean are left out; a density there is
    below 1e-17 of its peak.
    """
    p = band_pairs(data.events, data.events, float(max(means)) + 9 * std).where("lag > 0")
    c = 1 / (std * np.sqrt(2 * np.pi))
    return dense_features(data, p, [F.lit(float(c)) * F.exp(F.lit(-0.5) * F.pow((F.col("lag") - F.lit(float(m))) / F.lit(float(std)), F.lit(2.0))) for m in means])


def kernel_convolution(data: EventData, kernel: Callable[[Column], Column], support: float, strict: bool = True) -> DataFrame:
    """Per event and source node the sum of a kernel of finite support over the lags to the
    events before it, also those at the same time unless strict: eid, s_node, value. Events and
    nodes without such pairs give no row."""
    p = band_pairs(data.events, data.events, support).where((F.col("lag") > 0) if strict else (F.col("eid") != F.col("s_eid")))
    return p.groupBy("eid", "s_node").agg(F.sum(kernel(F.col("lag"))).alias("value"))
