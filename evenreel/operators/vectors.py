"""Arithmetic on fixed-length array columns, kept inside generated code.

Higher-order functions over arrays are interpreted element by element; sums
written out per dimension compile, combine map-side and never explode a row
into one row per dimension.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension(frame: DataFrame, column: str) -> int:
    """Length of the vectors in a column (0 for an empty table)."""
    first = frame.where(F.col(column).isNotNull()).select(F.size(column)).first()
    return int(first[0]) if first else 0


def dot(left: str, right: str, d: int) -> Column:
    """Inner product of two array columns; null when either is null."""
    if d == 0:
        return F.lit(0.0)
    return F.expr(" + ".join(f"{left}[{i}] * {right}[{i}]" for i in range(d)))


def weighted_dot(left: str, right: str, weights: Sequence[float]) -> Column:
    """Inner product with one constant weight per dimension."""
    terms = [f"({left}[{i}] * {right}[{i}] * {float(w)!r}D)" for i, w in enumerate(weights)]
    return F.expr(" + ".join(terms)) if terms else F.lit(0.0)


def against(column: str, weights: Sequence[float]) -> Column:
    """Inner product of an array column with constants."""
    terms = [f"({column}[{i}] * {float(w)!r}D)" for i, w in enumerate(weights)]
    return F.expr(" + ".join(terms)) if terms else F.lit(0.0)


def sum_columns(vector: str, d: int, weight: str | None = None, prefix: str = "_s") -> list[Column]:
    """Per-dimension sums of an array column, for one ``agg`` call."""
    scale = f"{weight} * " if weight else ""
    return [F.expr(f"sum({scale}{vector}[{i}])").alias(f"{prefix}{i}") for i in range(d)]


def gather(d: int, prefix: str = "_s") -> Column:
    """The array of the columns `sum_columns` made."""
    return F.array(*[F.col(f"{prefix}{i}") for i in range(d)])


def as_double(column: str) -> Column:
    return F.col(column).cast("array<double>")


def unit_vectors(items: DataFrame, column: str = "vec") -> DataFrame:
    """Vectors as doubles of length one, so that rich metadata is no advantage."""
    d = dimension(items, column)
    wide = items.withColumn(column, as_double(column))
    normed = wide.withColumn("_norm", F.greatest(F.sqrt(dot(column, column, d)), F.lit(1e-8)))
    scaled = F.array(*[F.col(column)[i] / F.col("_norm") for i in range(d)])
    return normed.withColumn(column, scaled).drop("_norm")
