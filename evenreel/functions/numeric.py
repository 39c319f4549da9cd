"""Column functions over votes, ratings and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Popularity bands as absolute vote counts (upper end, label).
BANDS = (
    (0, "0"),
    (4, "1-4"),
    (19, "5-19"),
    (99, "20-99"),
    (499, "100-499"),
    (1999, "500-2k"),
    (9999, "2k-10k"),
    (None, "10k+"),
)
BAND_LABELS = tuple(label for _, label in BANDS)
TAIL_BANDS = ("0", "1-4", "5-19", "20-99")

# Prior of the shrunk crowd score, and the rating scale of models.
CROWD_PRIOR_MEAN = 6.5
CROWD_PRIOR_WEIGHT = 50.0
MIN_STARS = 0.5
MAX_STARS = 5.0


def band_ordinal(votes: Column) -> Column:
    """1-8, the position of a vote count among the bands; null counts as 0."""
    count = F.coalesce(votes.cast("double"), F.lit(0.0))
    steps = [F.when(count > top + 0.5, 1).otherwise(0) for top, _ in BANDS[:-1]]
    return reduce(lambda a, b: a + b, steps) + 1


def popularity_band(votes: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BAND_LABELS)), band_ordinal(votes))


def is_tail_band(band: Column) -> Column:
    return band.isin(*TAIL_BANDS)


def crowd_shrunk(average: Column, votes: Column) -> Column:
    """Crowd score pulled toward the prior by how few votes back it."""
    count = F.coalesce(votes.cast("double"), F.lit(0.0))
    score = F.coalesce(average.cast("double"), F.lit(CROWD_PRIOR_MEAN))
    prior = F.lit(CROWD_PRIOR_WEIGHT)
    return (count * score + prior * F.lit(CROWD_PRIOR_MEAN)) / (count + prior)


def half_even(value: Column) -> Column:
    return F.rint(value)


def clip_stars(value: Column) -> Column:
    return F.greatest(F.lit(MIN_STARS), F.least(F.lit(MAX_STARS), value))


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null instead of an error without spread."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0))


def decade(year: Column) -> Column:
    return (F.floor(year / F.lit(10.0)) * 10).cast("int")


def on_ten_point_scale(rating: Column) -> Column:
    number = rating.cast("double")
    return F.coalesce(number.between(1, 10) & (number == F.floor(number)), F.lit(False))


def ten_point(frame: DataFrame, column: str, *, doubled: bool = False) -> DataFrame:
    """Ratings as 1-10 integers; the job fails on a value off the scale.

    ``doubled`` turns half stars (0.5-5) into 1-10 first.
    """
    number = F.col(column).try_cast("double")
    value = half_even(number * 2) if doubled else number
    message = F.concat(
        F.lit("rating off the 1-10 scale: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))
    )
    checked = F.when(on_ten_point_scale(value), value.cast("int")).otherwise(
        F.raise_error(message).cast("int")
    )
    return frame.withColumn(column, checked)
