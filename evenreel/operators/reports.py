"""Reports over one person's - or every person's - rated films."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenreel.functions.numeric import decade
from evenreel.operators.ordering import largest, score_ranges, value_counts
from evenreel.operators.quantiles import grouped_quantiles, quantile_buckets
from evenreel.session import written

# Vote counts under which a film counts as obscure.
TAIL_THRESHOLDS = (100, 500, 1000, 5000)


def spearman(
    frame: DataFrame,
    group: Sequence[str],
    left: str,
    right: str,
    *,
    left_spread: Column,
    right_spread: Column,
    out: str = "spearman",
    min_rows: int = 3,
) -> DataFrame:
    """Rank correlation per group; null under three rows or without spread.

    Rows are first counted per distinct (left, right) pair, so hot pairs collapse
    map-side and the rows themselves are read once. Ranks of n rows always have
    the mean (n + 1) / 2.
    """
    group = list(group)
    pairs = (
        frame.where(F.col(left).isNotNull() & F.col(right).isNotNull())
        .select(
            *group, F.col(left).cast("double").alias(left), F.col(right).cast("double").alias(right)
        )
        .groupBy(*group, left, right)
        .agg(F.count(F.lit(1)).cast("double").alias("_w"))
    )

    def ranks(value: str, name: str, spread: Column) -> DataFrame:
        cells = value_counts(pairs, group, value, spread, weight=F.col("_w"))
        return cells.select(*group, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))

    ranked = pairs.join(ranks(left, "_l", left_spread), [*group, left]).join(
        ranks(right, "_r", right_spread), [*group, right]
    )
    sums = ranked.groupBy(*group).agg(
        F.sum("_w").alias("_n"),
        F.sum(F.col("_w") * F.col("_l") * F.col("_l")).alias("_ll"),
        F.sum(F.col("_w") * F.col("_r") * F.col("_r")).alias("_rr"),
        F.sum(F.col("_w") * F.col("_l") * F.col("_r")).alias("_lr"),
    )
    centre = F.col("_n") * ((F.col("_n") + 1) / 2) * ((F.col("_n") + 1) / 2)
    spreads = (F.col("_ll") - centre > 0.25) & (F.col("_rr") - centre > 0.25)
    product = F.sqrt((F.col("_ll") - centre) * (F.col("_rr") - centre))
    rho = F.when(
        (F.col("_n") >= min_rows) & spreads, (F.col("_lr") - centre) / F.nullif(product, F.lit(0.0))
    )
    return sums.select(*group, rho.alias(out))


def star_ranges(value: Column) -> Column:
    return score_ranges(value, 0.0, 10.0, 64)


def taste_summary(rated: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rated films, mean, spread, error floor and two rank correlations."""
    group = list(group)
    # each step is written, so that its shuffles go before the next one's come
    rated = written(rated.select(*group, "rating", "vote_count", "vote_average"), "rated")
    base = rated.where(F.col("rating").isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("rated_films"),
        F.avg("rating").alias("mean_rating"),
        F.stddev_pop("rating").alias("rating_sd"),
        F.stddev_pop("rating").alias("rmse_floor"),
    )
    logged = rated.withColumn("log_votes", F.log1p(F.col("vote_count").cast("double")))
    fame = spearman(
        logged,
        group,
        "rating",
        "log_votes",
        left_spread=star_ranges(F.col("rating")),
        right_spread=F.floor(F.col("log_votes") * 16).cast("int"),
        out="rho_popularity",
    )
    crowd = spearman(
        rated,
        group,
        "rating",
        "vote_average",
        left_spread=star_ranges(F.col("rating")),
        right_spread=star_ranges(F.col("vote_average")),
        out="rho_crowd",
    )
    fame, crowd = written(fame, "fame"), written(crowd, "crowd")
    return base.join(fame, group, "left").join(crowd, group, "left")


def profile_deciles(
    rated: DataFrame, catalogue: DataFrame, *, bins: int = 10
) -> DataFrame:
    """Rated films per popularity decile of the whole catalogue."""
    total = rated.agg(F.count(F.lit(1))).scalar()
    votes = F.col("vote_count").cast("double")
    return (
        rated.withColumn("decile", quantile_buckets(catalogue, "vote_count", votes, bins))
        .where(F.col("decile").isNotNull())
        .groupBy("decile")
        .agg(
            F.count(F.lit(1)).alias("films"),
            F.count("rating").alias("rated"),
            F.avg("rating").alias("mean_rating"),
        )
        .withColumn("share", F.col("films") / total)
        .orderBy("decile")
    )


def tail_share(rated: DataFrame, thresholds: Sequence[int] = TAIL_THRESHOLDS) -> DataFrame:
    """Films under each vote threshold, in one pass over the ratings."""
    counts = rated.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("vote_count") < t).alias(f"under_{t}") for t in thresholds],
    )
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("under_votes"), F.col(f"under_{t}").alias("films"))
            for t in thresholds
        ]
    )
    return counts.select("total", F.inline(rows)).select(
        "under_votes", "films", (F.col("films") / F.col("total")).alias("share")
    )


def popularity_gap(labelled: DataFrame, label: str = "set") -> DataFrame:
    """Films, median, p10 and p90 of votes per labelled set."""
    points = grouped_quantiles(labelled, [label], "vote_count", [0.5, 0.1, 0.9])
    films = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("films"))
    names = ("median_votes", "p10_votes", "p90_votes")
    return films.join(points, label, "left").select(
        label, "films", *[F.get("quantiles", F.lit(i)).cast("int").alias(name) for i, name in enumerate(names)]
    )


def overview_counts(joined: DataFrame) -> DataFrame:
    """Rated, seen and pending films, mean and spread of the ratings."""
    return joined.agg(
        F.count("rating").alias("rated"),
        F.count_if("seen").alias("watched"),
        F.count_if("watchlist_pending").alias("pending"),
        F.avg("rating").alias("mean_rating"),
        F.stddev_pop("rating").alias("rating_sd"),
    )


def rating_histogram(rated: DataFrame) -> DataFrame:
    return (
        rated.where(F.col("rating").isNotNull())
        .groupBy("rating")
        .agg(F.count(F.lit(1)).alias("films"))
        .orderBy("rating")
    )


def vote_histogram(films: DataFrame, *, width: float = 0.5) -> DataFrame:
    """Films per bin of log(1 + votes), with the density a chart would show."""
    logged = films.where(F.col("vote_count").isNotNull()).select(
        F.floor(F.log1p(F.col("vote_count").cast("double")) / width).cast("int").alias("bin")
    )
    counts = logged.groupBy("bin").agg(F.count(F.lit(1)).alias("films"))
    total = F.sum("films").over(W.partitionBy())  # a few dozen bins
    return counts.withColumn("density", F.col("films") / (total * F.lit(width))).orderBy("bin")


def explode_rating(rated: DataFrame, column: str) -> DataFrame:
    """One row per list entry with the film's rating; empty lists vanish."""
    return rated.select("rating", F.explode(column).alias(column)).where(F.col(column).isNotNull())


def by_list_entry(rated: DataFrame, column: str, *, min_films: int, top: int) -> DataFrame:
    """The most frequent list entries with their mean rating."""
    summary = (
        explode_rating(rated, column)
        .groupBy(column)
        .agg(F.count("rating").alias("films"), F.avg("rating").alias("mean_rating"))
        .where(F.col("films") >= min_films)
    )
    return largest(summary, [F.desc("films"), F.col(column)], top)


def by_decade(rated: DataFrame) -> DataFrame:
    return (
        rated.where(F.col("year").isNotNull())
        .groupBy(decade(F.col("year")).alias("decade"))
        .agg(F.count("rating").alias("films"), F.avg("rating").alias("mean_rating"))
        .orderBy("decade")
    )


def largest_misses(predictions: DataFrame, films: DataFrame, *, n: int = 25) -> DataFrame:
    """The predictions furthest off, with the films' titles."""
    off = predictions.withColumn("abs_error", F.abs(F.col("actual") - F.col("predicted")))
    worst = largest(off, [F.desc(F.round("abs_error", 9)), F.col("row")], n)
    titles = films.select(F.col("tmdb_id").alias("row"), "title", "year", "vote_count")
    return titles.join(F.broadcast(worst), "row")  # n rows


