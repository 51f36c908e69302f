"""Scales, support recovery, ranking curves."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.quantiles import quantiles
from tidewire.operators.scan import running_totals

#: sqrt(2) * erfinv(1/2), which is also the upper quartile of the normal distribution.
_QUARTILE = NormalDist().inv_cdf(0.75)


def std_mad(df: DataFrame, column: str) -> float:
    """Median distance from the median over the normal quartile."""
    (m,) = quantiles(df, column, [0.5])
    return quantiles(df.select(F.abs(F.col(column) - F.lit(m)).alias("x")), "x", [0.5])[0] / _QUARTILE


def std_iqr(df: DataFrame, column: str) -> float:
    """Interquartile range, between linearly interpolated quartiles, times the normal quartile."""
    a, b = quantiles(df, column, [0.25, 0.75])
    return (b - a) * _QUARTILE


def support_metrics(pairs: DataFrame, truth: str = "truth", found: str = "found", eps: float = 1e-8) -> DataFrame:
    """fdp and recall of the nonzero coefficients found, over rows of true and found values."""
    t, f = F.abs(truth) > eps, F.abs(found) > eps
    hit = F.count_if(t & f)
    return pairs.agg((F.count_if(f & ~t) / F.greatest(F.count_if(f), F.lit(1))).alias("fdp"), F.when(F.count_if(t) > 0, hit / F.count_if(t)).alias("recall"))


def roc_points(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """threshold, fpr, tpr for every distinct score, from the top; label is 1 or 0."""
    per = rows.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.sum(1 - F.col(label).cast("double")).alias("neg"))
    cum = running_totals(per, "threshold", ["pos", "neg"], descending=True)
    all_ = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    # One row of totals.
    return cum.join(F.broadcast(all_)).select("threshold", F.try_divide("cum_neg", "q").alias("fpr"), F.try_divide("cum_pos", "p").alias("tpr"))


def auc(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """auc: the chance that a positive row scores above a negative one, ties counting half."""
    per = rows.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(F.col(label).cast("double")).alias("pos"), F.sum(1 - F.col(label).cast("double")).alias("neg"))
    cum = running_totals(per, "s", ["neg"])
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2))
    return cum.agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


def distance_to_best(history: DataFrame, value: str = "obj") -> DataFrame:
    """A history with each value's distance from the least one."""
    least = history.agg(F.min(value).alias("_least"))  # one row
    return history.join(F.broadcast(least)).withColumn("distance", F.col(value) - F.col("_least")).drop("_least")
