"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import leak_index, mixing, overlap, permutation_index, quality, reservoir
from tidewire.llm import term_counts as terms
from tidewire.llm.sql import SQL
from tidewire.session import table

__all__ = ["QUERIES", "SQL"]


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences, records and mark of every column number of the two sparse datasets."""
    url = table(spark, folder, "url_svmlight_x").select(F.lit("url_svmlight").alias("dataset"), "row_id", "col", "value")
    kdd = table(spark, folder, "kdd2010")
    rows = kdd.select(F.lit("kdd2010").alias("dataset"), "row_id", F.explode(F.arrays_zip("cols", "vals")).alias("x"))
    entries = url.unionByName(rows.select("dataset", "row_id", F.col("x.cols").alias("col"), F.col("x.vals").alias("value")))
    records = url.select("dataset", "row_id").unionByName(kdd.select(F.lit("kdd2010").alias("dataset"), "row_id"))
    counts, totals = terms.term_counts(entries, "dataset", "row_id", "col", "value", ["url_svmlight", "kdd2010"], records)
    totals = spark.createDataFrame(sorted(totals.items()), "dataset string, n_all bigint")
    return terms.marked(counts.withColumn("col", F.col("col").cast("int")), totals, "dataset")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of too few or too many records."""
    return p1_counts(spark, folder).where("mark is not null").select("dataset", "col", "mark")


ADULT = overlap.Spec(length=123, max_diff=3, tol=0.0, gram=28, window=13)
IJCNN1 = overlap.Spec(length=22, max_diff=1, tol=0.0015, gram=12, window=10)


def _splits(spark: SparkSession, folder: str):
    """Dataset, its records, and pairs and members of its overlaps."""
    adult = table(spark, folder, "adult")
    yield "adult", adult, *overlap.overlaps(adult, ADULT)
    ijcnn1 = table(spark, folder, "ijcnn1").withColumn("cls", (F.col("label") > 0).cast("tinyint"))
    yield "ijcnn1", ijcnn1, *overlap.overlaps(ijcnn1, IJCNN1, cls="cls")


def _united(parts) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a training and a held-out record that are the same or nearly so."""
    pairs = ((name, overlap.expanded(p, m)) for name, _, p, m in _splits(spark, folder))
    return _united(x.select(F.lit(name).alias("dataset"), F.least("trn", "other").alias("row_a"), F.greatest("trn", "other").alias("row_b")) for name, x in pairs)


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping held-out records by dataset, split and source."""
    return _united(overlap.report(r, p, m).select(F.lit(name).alias("dataset"), "*") for name, r, p, m in _splits(spark, folder))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Overlaps between distinct contents, each named by its least row: the form for large tables."""
    return _united(p.select(F.lit(name).alias("dataset"), "rep_a", "rep_b", "n_diff") for name, _, p, _ in _splits(spark, folder))


def p2_members(spark: SparkSession, folder: str) -> DataFrame:
    """The content of every record that takes part."""
    return _united(m.select(F.lit(name).alias("dataset"), "row_id", "held", "rep") for name, _, _, m in _splits(spark, folder))


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A uniform sample of kdd2010 for every row of sample_plan."""
    return reservoir.sample(table(spark, folder, "kdd2010"), table(spark, folder, "sample_plan"), "row_id", ["piece_no", "arrived_at"], ["cols", "vals", "label"], ["split", "learner_id"])


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_report": p2_report, "p2_pairs": p2_pairs, "p2_members": p2_members, "p4_sample": p4_sample}


def p6_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Exact and proximity matches of test passages in documents."""
    return leak_index.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), proximity=True)


def p6_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents and test items match, exactly or by proximity."""
    return p6_matches(spark, folder).select("doc_id", "item_id", "kind")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and test items that share a run of at least ten words."""
    return leak_index.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of every document's text with the shares of its kinds of lines."""
    return quality.text_quality(table(spark, folder, "documents"), table(spark, folder, "common_words"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Failed checks per document."""
    return quality.failed_checks(p8_stats(spark, folder))


QUERIES |= {"p6_found": p6_found, "p6_matches": p6_matches, "p6_kinds": p6_kinds, "p8_found": p8_found, "p8_stats": p8_stats}


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of every plan's mix with their copies."""
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of every plan's sources."""
    return mixing.shares(*mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets")))


QUERIES |= {"p7_mix": p7_mix, "p7_shares": p7_shares}


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Close pairs of covtype vectors of which one is among the nearest five of the other."""
    near = permutation_index.neighbours(table(spark, folder, "covtype"), 5, radius=0.03)
    return near.where("dist <= 0.03").select(F.least("row_id", "neighbour").alias("row_a"), F.greatest("row_id", "neighbour").alias("row_b")).distinct()


def p5_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest others of every covtype vector whose row_id is divisible by 50."""
    vectors = table(spark, folder, "covtype")
    near = permutation_index.neighbours(vectors, 10, queries=vectors.select("row_id").where("row_id % 50 = 0"))
    return near.withColumn("dist", F.round("dist", 9))


QUERIES |= {"p5_found": p5_found, "p5_neighbours": p5_neighbours}


def p4_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many records each plan of sample_plan got."""
    return p4_sample(spark, folder).groupBy("plan_id").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("records"))


def p8_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The exact counts behind the statistics of every document's text."""
    return p8_stats(spark, folder).select("doc_id", "n_words", "n_letters", "n_visible", "n_symbols", "n_lines", "n_ended", "n_common")


QUERIES |= {"p4_sizes": p4_sizes, "p8_counts": p8_counts}


def p4_members(spark: SparkSession, folder: str) -> DataFrame:
    """How many of each plan's sampled records are records that the plan matches."""
    plans = table(spark, folder, "sample_plan").select("plan_id", F.col("split").alias("s"), F.col("learner_id").alias("l"))
    drawn = p4_sample(spark, folder).select("plan_id", "row_id", "cols", "vals", F.col("label").alias("y"))
    there = table(spark, folder, "kdd2010").select("row_id", "split", "learner_id", "cols", "vals", "label")
    same = there.join(drawn.join(plans, "plan_id"), ["row_id", "cols", "vals"]).where("label <=> y and (s is null or s = split) and (l is null or l = learner_id)")
    return same.groupBy("plan_id").agg(F.count_distinct("row_id").alias("n"))


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every plan's source has its share within two percentage points and keeps its cap."""
    s = p7_shares(spark, folder)
    given = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(Window.partitionBy("plan_id"))
    close = F.abs(F.col("actual_share") - F.when(F.col("tokens") > 0, F.col("target_share") / given).otherwise(0.0)) <= 0.02
    return s.select("plan_id", "source", F.round("target_share", 6).alias("target_share"), (F.col("tokens") > 0).alias("used"), close.alias("close"), F.coalesce(F.col("most_copies") <= F.col("max_repeats"), F.lit(True)).alias("capped"))


QUERIES |= {"p4_members": p4_members, "p7_kept": p7_kept}
