"""Exact order statistics of columns over all tasks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values around the wanted ranks that the driver reads; more are narrowed down again.
MOST_VALUES = 100_000
#: Accuracy of the sketch that brackets the wanted ranks.
_ACCURACY = 10_000


def _ranks(n: int, shares: list[float], method: str) -> list[int]:
    at = [float(s * (n - 1)) for s in shares]
    return sorted({int(np.rint(a)) for a in at} if method == "nearest" else {f(a) for a in at for f in (math.floor, math.ceil)})


def order_statistics(df: DataFrame, wanted: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values at the wanted ranks, from 0, of the non-null values of each column.

    A sketch of all columns at once brackets each rank; one pass then counts what lies below
    and between, and only the values between are grouped. Should there be too many of these,
    they are bracketed in turn. Nothing is sorted, and no column is shuffled whole.
    """
    targets = [(c, k) for c, ks in wanted.items() for k in ks]
    x = {c: F.col(f"`{c}`").cast("double") for c in wanted}
    low, high = [-math.inf] * len(targets), [math.inf] * len(targets)

    def between(i: int):
        v = x[targets[i][0]]
        return v.isNotNull() & (v >= F.lit(low[i])) & (v <= F.lit(high[i]))

    while targets:
        counted = df.agg(*(e for i, (c, _) in enumerate(targets) for e in (F.count_if(x[c] < F.lit(low[i])).alias(f"b{i}"), F.count_if(between(i)).alias(f"m{i}")))).first()
        if sum(counted[f"m{i}"] for i in range(len(targets))) <= MOST_VALUES:
            break
        cuts = []
        for i, (c, k) in enumerate(targets):
            m, at = counted[f"m{i}"], k - counted[f"b{i}"]
            wide = 2 * m / _ACCURACY + 1
            shares = [min(max((at + d) / m, 0.0), 1.0) for d in (-wide, wide)]
            cuts.append(F.percentile_approx(F.when(between(i), x[c]), shares, _ACCURACY).alias(f"q{i}"))
        found = df.agg(*cuts).first()
        old, moved = list(zip(low, high)), False
        for i in range(len(targets)):
            low[i], high[i] = found[f"q{i}"]
        counted = df.agg(*(e for i, (c, _) in enumerate(targets) for e in (F.count_if(x[c] < F.lit(low[i])).alias(f"b{i}"), F.count_if(between(i)).alias(f"m{i}")))).first()
        for i, (_, k) in enumerate(targets):
            if not counted[f"b{i}"] <= k < counted[f"b{i}"] + counted[f"m{i}"]:
                low[i], high[i] = old[i]  # the sketch missed it
            moved |= (low[i], high[i]) != old[i]
        # A bracket of one value is as narrow as it gets, however often the value occurs.
        if not moved or all(a == b for a, b in zip(low, high)):
            break
    entries = F.array_compact(F.array(*(F.when(between(i), F.struct(F.lit(i).alias("i"), x[c].alias("x"))) for i, (c, _) in enumerate(targets))))
    out: dict[str, dict[int, float]] = {c: {} for c in wanted}
    if not targets:
        return out
    below = df.agg(*(F.count_if(x[c] < F.lit(low[i])).alias(f"b{i}") for i, (c, _) in enumerate(targets))).first()
    rows = df.select(F.explode(entries).alias("e")).groupBy("e.i", "e.x").agg(F.count("*").alias("m")).collect()  # distinct values between
    for i, (c, k) in enumerate(targets):
        run = below[f"b{i}"]
        for r in sorted((r for r in rows if r["i"] == i), key=lambda r: r["x"]):
            run += r["m"]
            if run > k:
                out[c][k] = r["x"]
                break
    return out


def column_quantiles(df: DataFrame, wanted: dict[str, list[float]], method: str = "linear") -> dict[str, list[float]]:
    """The quantiles of the non-null values of several columns in the same passes: 'linear'
    between the two ranks around share * (n - 1), or 'nearest', the rank rounded half to even.
    Empty columns give none."""
    n = df.agg(*(F.count(F.col(f"`{c}`").cast("double")).alias(c) for c in wanted)).first().asDict()
    found = order_statistics(df, {c: _ranks(n[c], s, method) for c, s in wanted.items() if n[c]})
    out = {}
    for c, shares in wanted.items():
        v = found.get(c, {})
        at = [float(s * (n[c] - 1)) for s in shares] if n[c] else []
        if method == "nearest":
            out[c] = [v[int(np.rint(a))] for a in at]
        else:
            out[c] = [v[math.floor(a)] + (v[math.ceil(a)] - v[math.floor(a)]) * (a - math.floor(a)) for a in at]
    return out


def quantiles(df: DataFrame, column: str, shares: list[float], method: str = "linear") -> list[float]:
    """column_quantiles of one column."""
    return column_quantiles(df, {column: shares}, method)[column]
