"""Equal rows as one content, named by its least key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import written


def contents(taken: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The distinct contents of rows, and which content each row has.

    taken has row (a key), x (the content, an array of doubles) and the columns keys within which contents count as
    equal. Returns contents (keys, h, x, rep) and members (keys, row, rep). Copies shrink per
    task before the shuffle. Rows find their content by its 64-bit hash alone, so x is
    shuffled once; only if two contents share a hash, which is looked up, do they also
    compare x.
    """
    # A hash passes over nulls, so that arrays which differ in their places would share one.
    hashed = taken.withColumn("h", F.xxhash64(F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))))
    reps = written(hashed.groupBy(*keys, "h", "x").agg(F.min("row").alias("rep")), name)
    shared = reps.groupBy(*keys, "h").agg(F.count("*").alias("n")).where("n > 1")
    on = [*keys, "h", *([] if shared.isEmpty() else ["x"])]
    return reps, hashed.select("row", *on).join(reps.select("rep", *on), on).select(*keys, "row", "rep")
