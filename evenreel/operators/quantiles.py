"""Quantile cuts against a reference population."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenreel.operators.ordering import score_ranges, value_counts


def exact_quantiles(frame: DataFrame, column: str, points: Sequence[float]) -> list[float | None]:
    """Interpolated quantiles of a column, null for a column without values.

    Rows are counted per distinct value and the counts are accumulated per range
    of values, so no task holds all distinct values; only the order statistics
    next to the wanted positions reach the driver.
    """
    known = frame.select(F.col(column).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    n, low, high = known.agg(F.count("_v"), F.min("_v"), F.max("_v")).first()
    if not n or low == high:
        return [low] * len(points)
    places = [p * (n - 1) for p in points]
    wanted = sorted({f(x) for x in places for f in (math.floor, math.ceil)})
    counts = value_counts(known, [], "_v", score_ranges(F.col("_v"), low, high))
    inside = reduce(or_, [F.lit(i).between(F.col("_before"), F.col("_before") + F.col("_n") - 1) for i in wanted])
    found = [(r["_before"], r["_before"] + r["_n"], r["_v"]) for r in counts.where(inside).collect()]
    at = {i: next(v for first, end, v in found if first <= i < end) for i in wanted}
    return [
        at[math.floor(x)]
        if at[math.floor(x)] == at[math.ceil(x)]
        else (math.ceil(x) - x) * at[math.floor(x)] + (x - math.floor(x)) * at[math.ceil(x)]
        for x in places
    ]


def grouped_quantiles(frame: DataFrame, group: Sequence[str], column: str, points: Sequence[float]) -> DataFrame:
    """(group ..., quantiles): interpolated quantiles of a column in many groups at once.

    Counts per (group, value) are accumulated per (group, range of values), and
    each group picks the order statistics next to its positions from them: no
    buffer holds a group's distinct values, and nothing reaches the driver. Rows
    without a group or a value are left out, and so are groups without values.
    """
    value = F.col("_v")
    known = frame.select(*group, F.col(column).cast("double").alias("_v")).where(value.isNotNull())
    # rises with the value, whatever its sign and size
    spread = (F.signum(value) * F.floor(F.log1p(F.abs(value)) * 64)).cast("long")
    totals = known.groupBy(*group).agg(F.count(F.lit(1)).alias("_total"))
    cells = value_counts(known, group, "_v", spread).join(totals, list(group))
    last = F.col("_total") - 1

    def at(place: Column) -> Column:
        return F.max(F.when((place >= F.col("_before")) & (place < F.col("_before") + F.col("_n")), value))

    sides = [
        F.struct(at(F.floor(p * last)).alias("low"), at(F.ceil(p * last)).alias("high"), F.max(p * last).alias("place"))
        for p in points
    ]
    part = lambda x: x["place"] - F.floor(x["place"])
    return cells.groupBy(*group).agg(F.array(*sides).alias("_sides")).select(
        *group,
        F.transform(
            "_sides", lambda x: F.when(x["low"] == x["high"], x["low"]).otherwise((1 - part(x)) * x["low"] + part(x) * x["high"])
        ).alias("quantiles"),
    )


def quantile_edges(reference: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct quantile edges of a column: at most ``bins + 1`` numbers."""
    edges = exact_quantiles(reference, column, [i / bins for i in range(bins + 1)])
    return sorted({e for e in edges if e is not None})


def quantile_buckets(reference: DataFrame, column: str, value: Column, bins: int) -> Column:
    """1-based right-closed bucket of ``value``; null outside the edges.

    The lowest edge belongs to the first bucket. Fewer than three distinct edges
    cut nothing, and every bucket is null.
    """
    edges = quantile_edges(reference, column, bins)
    if len(edges) < 3:
        return F.lit(None).cast("int")
    below = reduce(add, [F.when(value > edge, 1).otherwise(0) for edge in edges])
    return F.when(value.between(edges[0], edges[-1]), F.greatest(below, F.lit(1)))


def vote_ranges(votes: Column) -> Column:
    """Range number of a vote count, rising with it."""
    return F.floor(F.log1p(votes.cast("double")) * 64).cast("int")


def rank_first_deciles(films: DataFrame, votes: str = "vote_count", *, bins: int = 10) -> DataFrame:
    """Equal-sized popularity deciles: films, lowest and highest vote count.

    Films tied on a vote count may fall on both sides of a cut. Which film does
    is immaterial to the report, so it is derived from the counts per distinct
    vote value and no film is ever ranked on its own.

    Rank r of n belongs to decile greatest(1, ceil((r - 1) * bins / (n - 1))).
    """
    known = films.where(F.col(votes).isNotNull()).select(F.col(votes).cast("long").alias("votes"))
    counts = value_counts(known, [], "votes", vote_ranges(F.col("votes")))
    last = F.greatest(known.agg(F.count(F.lit(1))).scalar() - 1, F.lit(1))
    cells = counts.select(
        "votes",
        F.col("_before").alias("first"),  # r - 1 of the first row with this value
        (F.col("_before") + F.col("_n") - 1).alias("final"),
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("decile"),
    )
    # whole r - 1 values in ((d-1)*last/bins, d*last/bins]; decile 1 starts at 0
    floor_of = lambda d: F.floor(d * last / F.lit(bins))
    low = F.when(F.col("decile") == 1, F.lit(0)).otherwise(floor_of(F.col("decile") - 1) + 1)
    high = floor_of(F.col("decile"))
    inside = F.least(F.col("final"), high) - F.greatest(F.col("first"), low) + 1
    return (
        cells.withColumn("films", inside)
        .where(F.col("films") > 0)
        .groupBy("decile")
        .agg(
            F.sum("films").alias("films"),
            F.min("votes").alias("votes_min"),
            F.max("votes").alias("votes_max"),
        )
        .orderBy("decile")
    )
