"""Uniform samples of fixed size from data of unknown length that arrives in pieces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import written

#: Rows of a reservoir that leave a task at once.
_OUT = 50_000


class Reservoir:
    """Algorithm L: keeps k of the items offered so far, each with equal chance, and draws how
    many items to skip until the next exchange, so it looks at few of them."""

    def __init__(self, k: int, rng: np.random.Generator):
        self.k, self.rng, self.seen = k, rng, 0
        self.items: list = []
        self.w, self.next = 1.0, k - 1
        if k > 0:
            self._skip()

    def _skip(self) -> None:
        self.w *= np.exp(np.log(1 - self.rng.random()) / self.k)
        gap = np.log(1 - self.rng.random()) / np.log1p(-self.w) if self.w < 1 else 0
        self.next += int(min(gap, 1 << 60)) + 1

    def chosen(self, n: int) -> list[tuple[int, int]]:
        """Of the next n items those to store, as (slot, offset); later ones overwrite."""
        out, begin = [], self.seen
        self.seen += n
        if self.k <= 0:
            return out
        fill = min(n, max(0, self.k - begin))
        out += [(begin + i, i) for i in range(fill)]
        while self.next < self.seen:
            out.append((int(self.rng.integers(self.k)), self.next - begin))
            self._skip()
        return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, k: int) -> int:
    """How many of k draws without replacement are good, at any size of the population.

    The chances relative to that of the mode are products of ratios of neighbours; 14 standard
    deviations to either side hold all of them that doubles can tell from 0.
    """
    low, high = max(0, k - bad), min(k, good)
    if low == high:
        return low
    total = good + bad
    mode = min(max((k + 1) * (good + 1) // (total + 2), low), high)
    half = int(14 * math.sqrt(k * (good / total) * (bad / total) * max(total - k, 0) / max(total - 1, 1))) + 40
    x = np.arange(max(low, mode - half), min(high, mode + half) + 1, dtype=np.float64)
    ratio = np.log(good - x[:-1]) + np.log(k - x[:-1]) - np.log(x[:-1] + 1) - np.log(bad - k + x[:-1] + 1)
    logs = np.r_[0.0, np.cumsum(ratio)]
    chance = np.cumsum(np.exp(logs - logs.max()))
    return int(x[min(np.searchsorted(chance, rng.random() * chance[-1], side="right"), len(x) - 1)])


def allocate(sizes: list[int], k: int, seed: list[int]) -> list[int]:
    """How many of k draws without replacement fall on each population."""
    left, rng, out = sum(sizes), np.random.default_rng(seed), []
    k = min(k, left)
    for n in sizes:
        left -= n
        out.append(hypergeometric(rng, n, left, k))
        k -= out[-1]
    return out


class _Filled:
    """A reservoir with its items: two arrays of keys and contents."""

    def __init__(self, k: int, seed: list[int]):
        self.pool = Reservoir(k, np.random.default_rng(seed))
        self.items: list[np.ndarray] | None = None

    def offer(self, columns: list[pa.Array]) -> None:
        picks = self.pool.chosen(len(columns[0]))
        if not picks:
            return
        slot, at = np.array(picks, np.int64).T
        new = [c.take(pa.array(at)).to_numpy(zero_copy_only=False) for c in columns]
        grown = int(slot.max()) + 1
        if self.items is None:
            self.items = [n[:0] for n in new]
        if grown > len(self.items[0]):
            self.items = [np.concatenate([i, np.resize(n[:1], grown - len(i))]) for i, n in zip(self.items, new, strict=True)]
        last = len(slot) - 1 - np.unique(slot[::-1], return_index=True)[1]  # later picks replace earlier ones
        for i, n in zip(self.items, new, strict=True):
            i[slot[last]] = n[last]


def _matched(first: DataFrame, plans: DataFrame, key: str, size: str, match: list[str]) -> DataFrame:
    """_plan, size, key and _h of every plan and record that it matches: equi-joins on the
    columns that a plan gives, for each set of given columns that occurs."""
    given = F.concat(F.lit("g"), *(F.when(F.col(m).isNull(), "0").otherwise("1") for m in match))
    plans = plans.select("_plan", size, *(F.col(m).alias(f"_p_{m}") for m in match), given.alias("_g"))
    sets = [r[0] for r in plans.select("_g").distinct().collect()]  # at most 2 ** the columns
    kinds = []
    for g in sets:
        wanted = [F.col(m) if on == "1" else F.lit(None).cast(dict(first.dtypes)[m]) for m, on in zip(match, g[1:], strict=True)]
        whole = F.lit(True)
        for m, on in zip(match, g[1:], strict=True):
            whole = whole & F.col(m).isNotNull() if on == "1" else whole
        kinds.append(F.when(whole, F.struct(F.lit(g).alias("_g"), *(w.alias(f"_p_{m}") for m, w in zip(match, wanted, strict=True)))))
    if not sets:
        return first.select(F.lit(0).cast("bigint").alias("_plan"), F.lit(0).cast("bigint").alias(size), key, "_h").limit(0)
    asked = first.select(key, "_h", F.explode(F.array_compact(F.array(*kinds))).alias("_w")).select(key, "_h", "_w.*")
    on = asked["_g"] == plans["_g"]
    for m in match:
        on = on & asked[f"_p_{m}"].eqNullSafe(plans[f"_p_{m}"])
    return asked.join(plans, on).select("_plan", F.col(size).cast("bigint").alias(size), key, "_h")


def sample(records: DataFrame, plans: DataFrame, key: str, arrival: list[str], payload: list[str], match: list[str], plan: str = "plan_id", size: str = "k", seed: int = 7) -> DataFrame:
    """Draw for every plan a uniform sample of its size among the records that it matches.

    A record is a distinct non-null key, however often it was sent; the delivery that counts is
    the least by the arrival columns (nulls first), then by content. A plan matches records by
    equality in the match columns, a null in the plan matching any value. A plan that matches
    fewer records than its size gets all of them; size null or below 1 gives none. Returns the
    plan, the key, the match and payload columns, one row per plan and sampled record. Empty
    tables give no rows; extra columns are ignored.

    Only keys and arrivals are shuffled, one row per record after partial minima, and joined to
    the plans. Each task sorts its own pairs by plan and runs one skip-based reservoir after
    the other, counting the records it represents, so it holds one reservoir at a time. The
    reservoirs are written to the shared folder. Their counts are merged plan by plan, each
    reservoir's part drawn from the hypergeometric distribution, and the payload of the drawn
    keys is fetched by a join at the end.
    """
    plans = written(plans.withColumn("_plan", F.monotonically_increasing_id()), "reservoir-plans")
    kinds = dict(records.dtypes)
    content = F.xxhash64(*match, *payload).alias("_h")
    sent = records.where(F.col(key).isNotNull()).select(F.col(key), F.struct(*arrival, content, *match).alias("_first"))
    first = sent.groupBy(key).agg(F.min("_first").alias("_first")).select(key, "_first._h", *(F.col(f"_first.{m}") for m in match))
    # The order makes a task that runs again offer its records alike.
    offered = _matched(first, plans.where(F.col(size) > 0), key, size, match).select("_plan", size, key, "_h").sortWithinPartitions("_plan", key)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, pool = TaskContext.get().partitionId(), None, None
        for b in batches:
            plan_ = b.column(0).to_numpy()
            edges = np.flatnonzero(np.r_[True, plan_[1:] != plan_[:-1], True]) if len(plan_) else []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if plan_[i] != now:
                    if pool:
                        yield from told(now, part, pool)
                    now, pool = plan_[i], _Filled(int(b.column(1)[i].as_py()), [seed, int(plan_[i]), part])
                pool.offer([b.column(c).slice(i, j - i) for c in (2, 3)])
        if pool:
            yield from told(now, part, pool)

    key_type = pa.int64() if kinds[key] == "bigint" else pa.int32() if kinds[key] == "int" else pa.string()

    def told(i: int, part: int, filled_: _Filled) -> Iterator[pa.RecordBatch]:
        seen = filled_.pool.seen
        yield _rows(i, part, seen, [-1], [None], [None])
        order = filled_.pool.rng.permutation(len(filled_.items[0]))
        for j in range(0, len(order), _OUT):
            own = order[j : j + _OUT]
            yield _rows(i, part, seen, np.arange(j, j + len(own)), filled_.items[0][own], filled_.items[1][own])

    def _rows(i: int, part: int, seen: int, rank, keys, content_) -> pa.RecordBatch:
        n = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int64)), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seen, np.int64)), pa.array(rank, pa.int64()), pa.array(keys, key_type), pa.array(content_, pa.int64())], ["_plan", "_part", "_seen", "_rank", key, "_h"])

    pools = written(offered.mapInArrow(filled, f"_plan bigint, _part int, _seen bigint, _rank bigint, `{key}` {kinds[key]}, _h bigint"), "reservoirs")

    def merged(counts: pd.DataFrame) -> pd.DataFrame:  # a plan's rows, one per task
        counts = counts.sort_values("_part")
        counts["_n"] = allocate(counts["_seen"].tolist(), int(counts["_k"].iloc[0]), [seed, int(counts["_plan"].iloc[0])])
        return counts[["_plan", "_part", "_n"]]

    wanted = plans.select("_plan", F.col(size).cast("bigint").alias("_k"), F.col(plan).alias(plan))
    taken = pools.where("_rank = -1").select("_plan", "_part", "_seen").join(wanted.drop(plan), "_plan").groupBy("_plan").applyInPandas(merged, "_plan bigint, _part int, _n bigint")
    drawn = pools.where("_rank >= 0").join(taken, ["_plan", "_part"]).where("_rank < _n").join(wanted.drop("_k"), "_plan").select(plan, key, "_h")
    full = records.select(key, content, *match, *payload).join(drawn, [key, "_h"])
    return full.dropDuplicates([plan, key]).select(plan, key, *match, *payload)
