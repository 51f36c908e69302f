"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections import defaultdict
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.tokens import VOCABULARY, token_counts
from tidewire.session import written

#: Rows of plan, source and size class, and of plan, source and band, that are sent to all tasks; more are joined.
MOST_SENT = 200_000
#: Order statistics of a group are searched in 2 ** 12 bins, then in as many within the bin that
#: holds the cut, until none of these has more documents than this.
CUT_ROWS = 100_000
_BITS, _LEVELS = 12, 4
#: Size classes per doubling of the tokens; a band is one doubling.
_CLASSES = 4


def spelling(source: Column | str) -> Column:
    """A source's name without case, outer blanks, and the kind of its separators."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_-]+", "_")


def sized(documents: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc, source in one spelling and n_tokens of every document that has tokens and a source."""
    named = documents.select(doc, spelling(source).alias("source"), F.col(text).alias("_t")).where("source is not null and _t is not null")
    return token_counts(named, [doc, "source"], "_t", vocabulary).where("n_tokens > 0")


def _class(tokens: str) -> Column:
    return F.floor(F.log2(tokens) * _CLASSES).cast("int")


def targets_of(targets: DataFrame, plan: str = "plan_id") -> DataFrame:
    """plan, source, weight, cap with sources in one spelling; rows of the same source join:
    weights add up, the least max_repeats holds. Weights null or below 0 count as 0; rows of a
    null plan or source are left out."""
    weight = F.sum(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    kept = targets.where(F.col("source").isNotNull() & F.col(plan).isNotNull())
    return kept.groupBy(F.col(plan).alias("plan"), spelling("source").alias("source")).agg(weight.alias("weight"), F.min("max_repeats").alias("cap"))


def copies_by_class(classes: dict[int, tuple[int, int]], need: float, cap: float, power: float) -> dict[int, float]:
    """Expected copies of the documents of each size class: min(cap, scale * mean size ** power),
    the scale such that all copies together hold need tokens, or the cap where they can't.
    classes has count and tokens by class."""
    tokens = sum(t for _, t in classes.values())
    if need >= cap * tokens:
        return dict.fromkeys(classes, float(cap))
    lift = {c: (t / n) ** power for c, (n, t) in classes.items()}
    low, high = 0.0, max(need / tokens, 1e-300) / min(lift.values()) * 2 + 1e-300
    given = lambda s: sum(min(cap, s * lift[c]) * t for c, (_, t) in classes.items())
    while given(high) < need:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if given(middle) < need else (low, middle)
    return {c: min(cap, high * lift[c]) for c in classes}


def allocation(targets: list[dict], stats: dict[str, dict[int, tuple[int, int]]], total: int | None, power: float, seed: int) -> tuple[list[tuple], list[tuple]]:
    """Per plan, source and class: whole copies, the chance of one more, and the band's number
    of such documents. Also per plan and source the target share and size."""
    rows, goals = [], []
    by_plan: dict = defaultdict(list)
    for t in targets:
        by_plan[t["plan"]].append(t)
    for plan, own in by_plan.items():
        weights = sum(t["weight"] for t in own)
        usable = [t for t in own if t["weight"] > 0 and stats.get(t["source"]) and (t["cap"] is None or t["cap"] > 0)]
        left = sum(t["weight"] for t in usable)
        size = {t["source"]: sum(x for _, x in stats[t["source"]].values()) for t in usable}
        bound = [t["cap"] * size[t["source"]] * left / t["weight"] for t in usable if t["cap"] is not None]
        whole = total if total is not None else min(bound, default=sum(size.values()))
        rng = np.random.default_rng([seed, *str(plan).encode()])
        for t in own:
            need = whole * t["weight"] / left if t in usable else 0.0
            goals.append((plan, t["source"], t["weight"] / weights if weights else 0.0, need, t["cap"]))
            if t not in usable:
                continue
            cap = float("inf") if t["cap"] is None else t["cap"]
            copies = copies_by_class(stats[t["source"]], need, cap, power)
            carry, bands = rng.random(), defaultdict(list)
            for c in sorted(copies):
                bands[c // _CLASSES].append(c)
            for band, classes in sorted(bands.items()):
                expected = sum(stats[t["source"]][c][0] * (copies[c] - floor(copies[c])) for c in classes)
                carry += expected
                n, carry = floor(carry + 1e-9), carry - floor(carry + 1e-9)  # fixed size, rounded in turn
                rows += [(plan, t["source"], c, band, floor(copies[c]), float(copies[c] - floor(copies[c])), n) for c in classes]
    return rows, goals


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, size_power: float = 0.5, seed: int = 11, doc: str = "doc_id", plan: str = "plan_id") -> tuple[DataFrame, DataFrame]:
    """Combine documents so that sources give their target shares of the tokens.

    sizes has the document, source and n_tokens, as sized() gives it. Returns (copies, goals):
    copies has plan, document, source, n_tokens and copies (1 or more) of every document in
    the mix, goals the plan's sources with target_share, goal_tokens and max_repeats.

    Weights are relative; sources without documents or with max_repeats below 1 give nothing
    and the others share their part. total is the size in tokens; by default it is the
    largest with which every source can give its share within max_repeats, or all tokens if
    nothing is capped. With a larger total a source that is too small gives all it may.
    Sources that a plan doesn't name stay out. Empty tables give no rows.

    A source's need spreads over its documents: expected copies grow with their size to the
    power size_power (0: alike for all), never above max_repeats. The whole copies are certain.
    For the rest, a document has a chance of one more copy, and each band of sizes gets a
    sample of fixed size by Pareto order sampling: documents are ranked by the odds of a
    uniform number over the odds of their chance, and the first n are taken. Numbers derive
    from seed, plan and document, so a task that runs again ranks alike. Ranks are cut by bin
    counts and an order within the one bin that holds the cut, so no group is sorted whole.
    """
    kind = dict(targets.dtypes)[plan]
    wanted = targets_of(targets, plan)
    classed = sizes.withColumn("class", _class("n_tokens"))
    stats = classed.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))

    def allotted(rows: pd.DataFrame) -> pd.DataFrame:  # a plan's rows, one per source and class
        own, found = [], defaultdict(dict)
        for source, some in rows.groupby("source"):
            cap = some["cap"].iloc[0]
            own.append({"plan": some["plan"].iloc[0], "source": source, "weight": some["weight"].iloc[0], "cap": None if pd.isna(cap) else int(cap)})
            found[source] = {int(c): (int(n), int(t)) for c, n, t in zip(some["class"], some["n"], some["t"], strict=True) if not pd.isna(c)}
        parts, goals = allocation(own, found, total, size_power, seed)
        a = pd.DataFrame(parts, columns=["plan", "source", "class", "band", "whole", "chance", "n"])
        return pd.concat([a, pd.DataFrame(goals, columns=["plan", "source", "target_share", "goal_tokens", "max_repeats"])]).astype({c: "Int64" for c in ("class", "band", "whole", "n", "max_repeats")})[_ALLOTTED]

    joined = wanted.join(stats, "source", "left").select("plan", "source", "weight", "cap", "class", "n", "t")
    schema = f"plan {kind}, source string, class int, band int, whole bigint, chance double, n bigint, target_share double, goal_tokens double, max_repeats bigint"
    both = written(joined.groupBy("plan").applyInPandas(allotted, schema).withColumnRenamed("plan", plan), "mix-allotted")
    given = both.where("class is not null").select(plan, "source", "class", "band", "whole", "chance", "n")
    goal = both.where("class is null").select(plan, "source", "target_share", "goal_tokens", "max_repeats")

    offered = classed.select(F.col(doc), "source", "n_tokens", "class").join(_sent(given), ["source", "class"])
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(plan), F.col(doc)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("chance")) / F.col("chance")
    q = F.when((F.col("chance") > 0) & (F.col("n") > 0), odds)
    place = F.least(F.floor(F.col("q") / (1 + F.col("q")) * F.lit(float(1 << _BITS * _LEVELS))), F.lit((1 << _BITS * _LEVELS) - 1))
    ranked = offered.withColumn("u", u).withColumn("q", q).withColumn("place", place)
    group = [plan, "source", "band"]
    cut, level = None, 0
    while level < _LEVELS:
        level += 1
        rest = _BITS * (_LEVELS - level)
        some = ranked.where("q is not null").withColumn("bin", F.shiftright("place", rest))
        if cut is not None:  # within the bin of the level before
            old = cut.select(*group, F.col("cut").alias("_cut"), F.col("rest").alias("_rest"))
            some = some.join(_sent(old), group).where(F.shiftright("bin", _BITS) == F.col("_cut")).withColumn("n", F.col("_rest"))
        bins = some.groupBy(*group, "bin").agg(F.count("*").alias("m"), F.first("n").alias("n"))  # at most 2 ** _BITS in a group
        before = F.coalesce(F.sum("m").over(Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        cut = bins.withColumn("before", before).where("before < n and before + m >= n").select(*group, F.col("bin").alias("cut"), (F.col("n") - F.col("before")).alias("rest"), "m")
        cut = written(cut, "mix-cut")
        if (cut.agg(F.max("m")).first()[0] or 0) <= CUT_ROWS:
            break
    known = ranked.join(_sent(cut.drop("m")), group, "left").withColumn("bin", F.shiftright("place", _BITS * (_LEVELS - level)))
    # A missing cut means that all of the group's documents are wanted, or none has a chance.
    clear = known.where("cut is null or bin is null or bin <> cut").withColumn("extra", F.when((F.col("q").isNotNull()) & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))), 1).otherwise(0))
    order = F.row_number().over(Window.partitionBy(*group).orderBy("q", doc))
    close = known.where("bin = cut").withColumn("extra", F.when(order <= F.col("rest"), 1).otherwise(0))
    copies = clear.unionByName(close).withColumn("copies", F.col("whole") + F.col("extra")).where("copies > 0")
    return copies.select(plan, doc, "source", "n_tokens", "copies"), goal


_ALLOTTED = ["plan", "source", "class", "band", "whole", "chance", "n", "target_share", "goal_tokens", "max_repeats"]


def _sent(rows: DataFrame) -> DataFrame:
    """A written table, sent to all tasks if it is small, so that no source gathers in a task;
    otherwise joined by shuffles, where Spark splits skewed sources."""
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def shares(copies: DataFrame, goals: DataFrame, plan: str = "plan_id") -> DataFrame:
    """Per plan and source: target and actual share, tokens, documents, copies, most copies of
    one document. Sources that give nothing have zeros."""
    given = copies.groupBy(plan, "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"))
    filled = goals.join(given, [plan, "source"], "left").fillna(0, ["tokens", "documents", "copies", "most_copies"])
    all_ = F.sum("tokens").over(Window.partitionBy(plan))
    return filled.withColumn("actual_share", F.when(all_ > 0, F.col("tokens") / all_).otherwise(0.0)).select(plan, "source", "target_share", "actual_share", "goal_tokens", "tokens", "documents", "copies", "most_copies", "max_repeats")


def mixed(documents: DataFrame, targets: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """mix() over documents: their tokens are counted once and written to the shared folder."""
    vocabulary = options.pop("vocabulary", VOCABULARY)
    return mix(written(sized(documents, vocabulary=vocabulary), "mix-sizes"), targets, **options)
