"""Preprocessing of longitudinal exposures kept as nonzero entries: case_id, interval, feature, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lagged(features: DataFrame, censoring: DataFrame, n_lags: list[int]) -> DataFrame:
    """Shift every exposure by 0 .. n_lags[feature] intervals, up to the censoring.

    The column of feature f at lag k is the sum of n_lags + 1 over the features before, plus k.
    """
    spark = features.sparkSession
    start, rows = 0, []
    for f, n in enumerate(n_lags):
        rows.append((f, int(n), start))
        start += n + 1
    offsets = spark.createDataFrame(rows, "feature int, n int, start int")  # a row per feature
    wide = features.where("value <> 0").join(F.broadcast(offsets), "feature").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    moved = wide.select("case_id", (F.col("interval") + F.col("k")).alias("interval"), (F.col("start") + F.col("k")).alias("feature"), "value")
    return moved.join(censoring.select("case_id", "censoring"), "case_id").where("interval < censoring").select("case_id", F.col("interval").cast("bigint").alias("interval"), "feature", F.col("value").cast("double").alias("value"))


def censored(entries: DataFrame, censoring: DataFrame) -> DataFrame:
    """Entries before their case's censoring."""
    return entries.join(censoring.select("case_id", "censoring"), "case_id").where("interval < censoring").drop("censoring")


def finite_products(features: DataFrame, n_features: int) -> DataFrame:
    """The features with a product column for every pair i < j, in order after the others:
    the product of the two values in the same interval."""
    a = features.select("case_id", "interval", F.col("feature").alias("i"), F.col("value").alias("a"))
    b = features.select("case_id", "interval", F.col("feature").alias("j"), F.col("value").alias("b"))
    pairs = a.join(b, ["case_id", "interval"]).where("i < j")
    return features.unionByName(pairs.select("case_id", "interval", _pair(n_features).alias("feature"), (F.col("a") * F.col("b")).alias("value")).where("value <> 0"))


def _pair(n: int):
    """Number of the pair (i, j), i < j, after n single features."""
    return (F.lit(n) + F.col("i") * F.lit(n) - (F.col("i") * (F.col("i") + 1) / 2).cast("int") + F.col("j") - F.col("i") - 1).cast("int")


def infinite_products(features: DataFrame, n_features: int) -> DataFrame:
    """For exposures that last from their first interval on: the features with, for every
    pair i < j of a case, an entry at the later of the two first exposures."""
    first = features.where("value <> 0").groupBy("case_id", "feature").agg(F.min("interval").alias("at"))
    a = first.select("case_id", F.col("feature").alias("i"), F.col("at").alias("a"))
    b = first.select("case_id", F.col("feature").alias("j"), F.col("at").alias("b"))
    pairs = a.join(b, "case_id").where("i < j").select("case_id", F.greatest("a", "b").alias("interval"), _pair(n_features).alias("feature"), F.lit(1.0).alias("value"))
    return features.select("case_id", "interval", "feature", F.col("value").cast("double").alias("value")).unionByName(pairs)


def active_cases(features: DataFrame, labels: DataFrame) -> DataFrame:
    """case_id of the cases with a positive sum of features and any label that isn't 0."""
    exposed = features.groupBy("case_id").agg(F.sum("value").alias("s")).where("s > 0").select("case_id")
    return exposed.join(labels.where("y <> 0").select("case_id").distinct(), "case_id", "left_semi")


def positive_cases(labels: DataFrame) -> DataFrame:
    """case_id of the cases with an event."""
    return labels.groupBy("case_id").agg(F.sum("y").alias("s")).where("s > 0").select("case_id")


def restrict(entries: DataFrame, cases: DataFrame) -> DataFrame:
    """The entries of the given cases; fewer than two cases raise an error."""
    if cases.limit(2).count() < 2:
        raise ValueError("fewer than two cases are left")
    return entries.join(cases, "case_id", "left_semi")
