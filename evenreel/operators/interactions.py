"""Films, status and coverage out of a long interaction table.

Every function takes the identifying columns as ``keys``: a single export uses
``["film_key"]``, a table of many people ``["user_id", "film_key"]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of interaction.
RATING, WATCHED, WATCHLIST, LIKE, DIARY, LIST_ENTRY = (
    "rating",
    "watched",
    "watchlist",
    "like",
    "diary",
    "list_entry",
)
OPTIONAL_KINDS = (DIARY, LIST_ENTRY)
SEEN_KINDS = (WATCHED, RATING, DIARY)

FILM = ("film_key",)


def _most_common(interactions: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The most frequent non-null value per film, the lowest one on a tie."""
    counts = (
        interactions.where(F.col(column).isNotNull())
        .groupBy(*keys, column)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return counts.groupBy(*keys).agg(
        F.min_by(column, F.struct(-F.col("_n"), F.col(column))).alias(column)
    )


def films_local(interactions: DataFrame, keys: Sequence[str] = FILM) -> DataFrame:
    """One row per film met anywhere, under its most frequent spelling."""
    keys = list(keys)
    base = interactions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_interactions"),
        F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"),
        F.bool_and("deleted").alias("deleted_only"),
    )
    return (
        base.join(_most_common(interactions, keys, "title"), keys, "left")
        .join(_most_common(interactions, keys, "year"), keys, "left")
        .select(
            *keys,
            "title",
            "year",
            "n_interactions",
            "kinds",
            F.col("film_key").startswith("ty:").alias("synthetic_key"),
            "deleted_only",
        )
    )


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def film_status(
    interactions: DataFrame,
    keys: Sequence[str] = FILM,
    *,
    diary_order: str = "watched_date",
    tie: str = "event_date",
) -> DataFrame:
    """Seen, rating, liked and pending per film.

    The rating row wins over the diary; of several diary values the last watched
    one counts, and a value without a date counts as watched after the dated ones.
    """
    keys = list(keys)
    kind = F.col("kind")
    rated = kind == RATING
    diary = (kind == DIARY) & F.col("value").isNotNull()
    order = F.struct(F.col(diary_order).isNull(), F.col(diary_order), F.col(tie), F.col("value"))
    flags = interactions.groupBy(*keys).agg(
        _any(kind.isin(*SEEN_KINDS)).alias("seen"),
        F.min_by(F.when(rated, F.col("value")), F.when(rated, F.struct(tie, "value"))).alias("_rating"),
        F.max_by(F.when(diary, F.col("value")), F.when(diary, order)).alias("_diary"),
        _any(kind == LIKE).alias("liked"),
        _any(kind == WATCHLIST).alias("on_watchlist"),
    )
    titles = films_local(interactions, keys).select(*keys, "title", "year")
    return titles.join(flags, keys).select(
        *keys,
        "title",
        "year",
        "seen",
        F.coalesce("_rating", "_diary").alias("rating"),
        "liked",
        "on_watchlist",
        (F.col("on_watchlist") & ~F.col("seen")).alias("watchlist_pending"),
    )


def coverage_report(interactions: DataFrame) -> DataFrame:
    """Rows, films and values per kind, so sparse signals stay visible."""
    return (
        interactions.groupBy("kind")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_distinct("film_key").alias("films"),
            F.count("value").alias("with_value"),
        )
        .withColumn("optional", F.col("kind").isin(*OPTIONAL_KINDS))
        .orderBy(F.desc("rows"), "kind")
    )


def known_films(per_user: DataFrame, *, order: str = "user_id") -> DataFrame:
    """Every user's films, one row per key: the first user's record."""
    return per_user.groupBy("film_key").agg(
        F.min_by(F.struct("title", "year"), F.struct(order, "title", "year")).alias("film")
    ).select("film_key", "film.title", "film.year")


def joined_view(status: DataFrame, film_map: DataFrame, films: DataFrame) -> DataFrame:
    """Status, map and metadata of films only (television is left out)."""
    ids = film_map.where(F.col("tmdb_id").isNotNull()).select("film_key", "tmdb_id")
    meta = films.where(F.col("media_type") == "movie").drop("title", "year")
    return status.join(ids, "film_key").join(meta, "tmdb_id")
