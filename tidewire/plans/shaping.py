"""What the query modules share: rounding, tables of driver arrays, SQL snippets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Decimals of computed numbers, alike on both sides of a comparison.
DECIMALS = 6


def r6(x: Column | str) -> Column:
    return F.round(x, DECIMALS)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def array_table(spark: SparkSession, a, names: str, value: str = "value", decimals: int = DECIMALS) -> DataFrame:
    """A driver array as rows of its indices and values; names are separated by spaces."""
    a = np.asarray(a, float)
    rows = [(*(int(i) for i in at), round(float(v), decimals) + 0.0) for at, v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, ", ".join([*(f"{n} int" for n in names.split()), f"{value} double"]))


def finished(fit):
    """The fit if it met its stop rule; an error if its limit ended it before."""
    if not fit.converged:
        raise ValueError(f"{type(fit).__name__} was not done within {fit.max_iter} rounds: {fit.history[-1:]}")
    return fit


def named_values(spark: SparkSession, decimals: int = DECIMALS, **values: float) -> DataFrame:
    """One row of named numbers."""
    kinds = {k: "bigint" if isinstance(v, int) else "double" for k, v in values.items()}
    row = tuple(v if isinstance(v, int) else round(float(v), decimals) + 0.0 for v in values.values())
    return spark.createDataFrame([row], ", ".join(f"{k} {t}" for k, t in kinds.items()))


def s6(x: str) -> str:
    return f"(round({x}, {DECIMALS}) + 0.0)"


def sql_values(name: str, columns: str, rows) -> str:
    """A CTE of literal rows, numbers as doubles where they are floats."""
    cell = lambda v: f"{v!r}::double" if isinstance(v, float) else repr(v)
    return f"{name}({columns}) as (values {', '.join('(' + ', '.join(cell(v) for v in row) + ')' for row in rows)})"
