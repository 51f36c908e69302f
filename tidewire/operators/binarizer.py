"""One-hot encoding of continuous and discrete columns by bins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.bands import _below
from tidewire.operators.quantiles import column_quantiles
from tidewire.operators.scan import ranks
from tidewire.session import written

#: Categories of one column that stand in the plan; more are kept as a table and joined.
MOST_CATEGORIES = 10_000


def boundaries(df: DataFrame, column: str, n_cuts: int, method: str = "quantile") -> list[float]:
    """Distinct boundaries of the bins, minus to plus infinity."""
    return all_boundaries(df, [column], n_cuts, method)[column]


def all_boundaries(df: DataFrame, columns: list[str], n_cuts: int, method: str = "quantile") -> dict[str, list[float]]:
    """The boundaries of several columns, from the same passes over the data."""
    if not columns:
        return {}
    shares = np.linspace(0, 1, n_cuts + 2).tolist()
    if method == "quantile":
        points = column_quantiles(df, dict.fromkeys(columns, shares), "nearest")
    else:
        r = df.agg(*(f(F.col(f"`{c}`")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max)))).first()
        points = {c: np.linspace(float(r[f"a{i}"]), float(r[f"b{i}"]), n_cuts + 2).tolist() for i, c in enumerate(columns)}
    return {c: [-math.inf, *sorted(set(b))[1:-1], math.inf] for c, b in points.items()}


def bin_of(x: Column, b: list[float]) -> Column:
    """How many boundaries lie below x, less one: bins are closed at the right."""
    return _below(x, [v for v in b if not math.isinf(v)])


class Binarizer:
    """Learns types, bins and categories of columns, and encodes rows as sparse one-hot.

    A column's type is taken from its name's ending (:continuous, :discrete), from kinds, or
    detected: continuous if it casts to numbers and has more distinct values than 15, or than
    half the rows if these are at most 30.
    """

    def __init__(self, columns: list[str], n_cuts: int = 10, method: str = "quantile", remove_first: bool = False, kinds: dict[str, str] | None = None, bounds: dict[str, list[float]] | None = None):
        self.columns, self.n_cuts, self.method, self.remove_first = columns, n_cuts, method, remove_first
        self.kinds, self.bounds, self.categories = dict(kinds or {}), dict(bounds or {}), {}
        self.tables: dict[str, tuple[DataFrame, int]] = {}

    def fit(self, df: DataFrame) -> Binarizer:
        castable = {f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.StringType))}
        number = lambda c: F.expr(f"try_cast(`{c}` as double)")
        words = [(F.count_if(F.col(f"`{c}`").isNotNull() & number(c).isNull()) if c in castable else F.lit(1)).alias(f"b{i}") for i, c in enumerate(self.columns)]
        about = [F.approx_count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(self.columns)]
        seen = df.agg(F.count("*").alias("n"), *words, *about).first()
        limit = 15 if seen["n"] > 30 else seen["n"] / 2
        for i, c in enumerate(self.columns):
            if c not in self.kinds:
                said = next((k for k in ("continuous", "discrete") if c.endswith(f":{k}")), None)
                # Only whether there are more values than the limit matters; far above it the sketch tells.
                many = not said and not seen[f"b{i}"] and (seen[f"d{i}"] > 10 * limit + 10 or df.select(f"`{c}`").where(F.col(f"`{c}`").isNotNull()).distinct().limit(int(limit) + 1).count() > limit)
                self.kinds[c] = said or ("continuous" if many else "discrete")
        plain = df.select(*(number(c).alias(c) for c in self.columns if self.kinds[c] == "continuous" and c not in self.bounds))
        self.bounds |= all_boundaries(plain, plain.columns, self.n_cuts, self.method)
        return self._with_categories(df, [c for c in self.columns if self.kinds[c] == "discrete"])

    def _with_categories(self, df: DataFrame, columns: list[str]) -> Binarizer:
        """The categories of all discrete columns, from one shuffle of their distinct values."""
        if not columns:
            return self
        values = F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("x")) for i, c in enumerate(columns)))
        found = written(df.select(F.explode(values).alias("e")).select("e.*").where("x is not null").distinct(), "categories")
        sizes = {r["i"]: r["count"] for r in found.groupBy("i").count().collect()}  # a row per column
        few = [i for i, n in sizes.items() if n <= MOST_CATEGORIES]
        self.categories = {c: [] for i, c in enumerate(columns) if sizes.get(i, 0) <= MOST_CATEGORIES}
        for r in found.where(F.col("i").isin(few)).orderBy("i", "x").collect():  # at most MOST_CATEGORIES per column
            self.categories[columns[r["i"]]].append(r["x"])
        many = [i for i in sizes if i not in few]
        if many:
            ranked = written(ranks(found.where(F.col("i").isin(many)), "i", ["x"]), "category-ranks")
            self.tables = {columns[i]: (ranked.where(F.col("i") == i).select(F.col("x").alias(f"_x{i}"), (F.col("rank") - 1).cast("int").alias(f"_k{i}")), sizes[i]) for i in many}
        return self

    def sizes(self) -> list[int]:
        """Bins or categories per column."""
        return [len(self.bounds[c]) - 1 if self.kinds[c] == "continuous" else self.tables[c][1] if c in self.tables else len(self.categories[c]) for c in self.columns]

    def blocks(self) -> list[tuple[int, int]]:
        """Start and length of every column's block in the encoding."""
        lengths = [n - int(self.remove_first) for n in self.sizes()]
        return [(sum(lengths[:i]), n) for i, n in enumerate(lengths)]

    def joined(self, df: DataFrame) -> DataFrame:
        """df with the numbers of the categories that are kept as tables."""
        for numbers, _ in self.tables.values():
            x, _ = numbers.columns
            c = next(c for c, (t, _) in self.tables.items() if t is numbers)
            df = df.join(numbers, F.col(f"`{c}`").cast("string") == F.col(x), "left").drop(x)
        return df

    def bins(self) -> list[Column]:
        """The bin of every column, of a table as joined() gives it; null for a category that
        the fit didn't see."""
        out = []
        for c in self.columns:
            if self.kinds[c] == "continuous":
                out.append(bin_of(F.expr(f"try_cast(`{c}` as double)"), self.bounds[c]))
            elif c in self.tables:
                out.append(F.col(self.tables[c][0].columns[1]))
            else:
                at = F.array_position(F.array(*(F.lit(v) for v in self.categories[c])), F.col(f"`{c}`").cast("string"))
                out.append(F.when(at > 0, (at - 1).cast("int")))
        return out

    def transform(self, df: DataFrame, name: str = "onehot") -> DataFrame:
        """Add the places of the ones, ascending, as an array. An unseen category raises an
        error when the row is read; nulls have no place."""
        parts = []
        for c, (start, _), b in zip(self.columns, self.blocks(), self.bins(), strict=True):
            known = F.when(b.isNull() & F.col(f"`{c}`").isNotNull(), F.raise_error(F.lit(f"unseen category in {c}")).cast("int")).otherwise(b)
            parts.append(F.when(known >= int(self.remove_first), known + (start - int(self.remove_first))))
        return self.joined(df).select(*(F.col(f"`{c}`") for c in df.columns), F.array_compact(F.array(*parts)).alias(name))
