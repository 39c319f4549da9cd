"""Exact ranks, quantiles, first rows and samples that survive hot groups.

A plain ``row_number() over (partition by user)`` puts a user who owns a third
of all rows into one task. Three rules keep that from happening here:

* the n best rows of a group: ``row_number <= n`` - Spark's window group limit
  prunes every task to n rows per group before the shuffle;
* the first row of a group: ``min_by`` / ``max_by``, which combine map-side;
* ranks of whole groups: rows are counted per distinct value first, the counts
  are accumulated per (group, value range) and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASH_PREFIX = 4  # 65,536 even ranges, and as many offsets at most


def hash_key(*parts: Column | str | int) -> Column:
    """Repeatable pseudo-random sort key of a row."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def first_per_key(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order`` (ascending)."""
    rest = [c for c in frame.columns if c not in keys]
    if not rest:
        return frame.select(*keys).distinct()
    picked = frame.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    )
    return picked.select(*keys, "_first.*").select(*frame.columns)


def last_per_key(frame: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last under ``order`` (ascending)."""
    rest = [c for c in frame.columns if c not in keys]
    picked = frame.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    )
    return picked.select(*keys, "_last.*").select(*frame.columns)


def top_per_group(
    frame: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every group; ``rank`` keeps the position."""
    name = rank or "_position"
    numbered = frame.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    kept = numbered.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def _rows_before(cells: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_before``: rows of the group in cells that sort earlier.

    ``cells`` holds counts ``_n`` and a range column ``_range`` that never falls
    along ``order``; windows run inside one range, and over one total per range.
    """
    preceding = (W.unboundedPreceding, -1)
    inside = W.partitionBy(*group, "_range").orderBy(*order).rowsBetween(*preceding)
    across = W.partitionBy(*group).orderBy("_range").rowsBetween(*preceding)
    totals = cells.groupBy(*group, "_range").agg(F.sum("_n").alias("_total"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(across), F.lit(0)))
    within = cells.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return (
        within.join(offsets.drop("_total"), [*group, "_range"])
        .withColumn("_before", F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_range")
    )


def value_counts(
    frame: DataFrame, group: Sequence[str], value: str, spread: Column, *, weight: Column | None = None
) -> DataFrame:
    """Distinct values of each group with ``_n`` rows and ``_before`` smaller rows.

    ``spread`` maps a value to its range number and must not fall as values rise.
    ``weight`` counts a row several times.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cells = frame.groupBy(*group, value).agg(rows.alias("_n"))
    return _rows_before(cells.withColumn("_range", spread), group, [value])


def score_ranges(value: Column, low: float, high: float, n: int = 1024) -> Column:
    """Range number of a bounded score, for ``spread``."""
    return F.greatest(
        F.lit(0), F.least(F.lit(n), F.floor((value - low) / (high - low) * n))
    ).cast("int")


def average_rank(
    frame: DataFrame, group: Sequence[str], value: str, rank: str, spread: Column
) -> DataFrame:
    """Rank of each row in its group, ties sharing their mean rank."""
    cells = value_counts(frame, group, value, spread).select(
        *group, value, (F.col("_before") + (F.col("_n") + 1) / F.lit(2.0)).alias(rank)
    )
    return frame.join(cells, [*group, value])


def ordinal_rank(
    frame: DataFrame,
    group: Sequence[str],
    value: Column,
    tie: Column,
    rank: str,
    spread: Column,
    *,
    prefix: int = 2,
) -> DataFrame:
    """1, 2, 3 ... in each group by ``value``, ties in order of the hash ``tie``.

    Rows tied on one value are split by the leading digits of the hash, so even
    a group of a single repeated value is spread over many tasks.
    """
    keyed = frame.withColumns(
        {"_value": value, "_tie": tie, "_digits": F.substring(tie, 1, prefix)}
    )
    cell = [*group, "_value", "_digits"]
    cells = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
    # every (value, digits) cell keeps the range of its value
    ranged = cells.withColumn("_range", spread)
    before = _rows_before(ranged, group, ["_value", "_digits"]).drop("_n")
    place = F.row_number().over(W.partitionBy(*cell).orderBy("_tie"))
    return (
        keyed.withColumn("_place", place)
        .join(before, cell)
        .withColumn(rank, (F.col("_place") + F.col("_before")).cast("long"))
        .drop("_value", "_tie", "_digits", "_place", "_before")
    )


def hash_rank(
    frame: DataFrame, tie: Column, rank: str, *, order: Sequence[str] = (), total: str | None = None
) -> DataFrame:
    """1, 2, 3 ... over the whole table in hash order, without a one-task sort.

    Leading digits of a hash are even ranges by construction: count them, then
    number the rows inside each. ``total`` names a column for the row count.
    """
    keyed = frame.withColumns({"_tie": tie, "_digits": F.substring(tie, 1, HASH_PREFIX)})
    totals = keyed.groupBy("_digits").agg(F.count(F.lit(1)).alias("_n"))
    # at most 16 ** HASH_PREFIX rows, whatever the table holds
    across = W.orderBy("_digits").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_digits",
        F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"),
        *([F.sum("_n").over(W.partitionBy()).alias(total)] if total else []),
    )
    place = F.row_number().over(W.partitionBy("_digits").orderBy("_tie", *order))
    return (
        keyed.withColumn("_place", place)
        .join(F.broadcast(offsets), "_digits")
        .withColumn(rank, (F.col("_place") + F.col("_before")).cast("long"))
        .drop("_tie", "_digits", "_place", "_before")
    )


def sample_share(frame: DataFrame, tie: Column, share: float, *, at_least: int = 1) -> DataFrame:
    """Exactly ``round(share * n)`` rows, chosen by hash order."""
    ranked = hash_rank(frame, tie, "_rank", total="_total")
    wanted = F.greatest(F.rint(F.col("_total") * F.lit(share)), F.lit(float(at_least)))
    return ranked.where(F.col("_rank") <= wanted).drop("_rank", "_total")


def largest(frame: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of the table; every task keeps only its own best n."""
    return frame.orderBy(*order).limit(n)
