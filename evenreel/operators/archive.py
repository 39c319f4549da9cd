"""Rating archives keyed by their own film numbers, linked to catalogue ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenreel.functions.text import imdb_tt
from evenreel.operators.ordering import first_per_key
from evenreel.operators.quantiles import grouped_quantiles, quantile_buckets


def clean_links(links: DataFrame) -> DataFrame:
    """Links with a catalogue id, ids as whole numbers."""
    extra = [c for c in ("imdbId",) if c in links.columns]
    return links.select("movieId", F.col("tmdbId").cast("long").alias("tmdbId"), *extra).where(
        F.col("tmdbId").isNotNull()
    )


def link_films(film_map: DataFrame, links: DataFrame) -> DataFrame:
    """Resolved films with the archive's number, if it has one."""
    one = first_per_key(clean_links(links), ["tmdbId"], [F.col("movieId")])
    return (
        film_map.where(F.col("tmdb_id").isNotNull())
        .join(one, F.col("tmdb_id") == F.col("tmdbId"), "left")
        .withColumn("in_archive", F.col("movieId").isNotNull())
        .withColumn("imdb_id", imdb_tt(F.col("imdbId")))
        .drop("tmdbId")
    )


def bridge(links: DataFrame) -> DataFrame:
    """One-to-one movieId <-> tmdbId: lowest movieId per id, then lowest id per movie."""
    per_id = first_per_key(
        clean_links(links).select("movieId", "tmdbId"), ["tmdbId"], [F.col("movieId")]
    )
    return first_per_key(per_id, ["movieId"], [F.col("tmdbId")])


def by_movie_id(by_tmdb: DataFrame, links: DataFrame) -> DataFrame:
    """Values keyed by tmdb_id, re-keyed to movieId without fanning out."""
    return by_tmdb.join(
        bridge(links).withColumnRenamed("tmdbId", "tmdb_id"), "tmdb_id"
    ).drop("tmdb_id")


def by_tmdb_id(by_movie: DataFrame, links: DataFrame) -> DataFrame:
    """Values keyed by movieId, re-keyed to tmdb_id without fanning out."""
    return by_movie.join(
        bridge(links).withColumnRenamed("tmdbId", "tmdb_id"), "movieId"
    ).drop("movieId")


def rated_ids(links: DataFrame, ratings: DataFrame) -> DataFrame:
    """Catalogue ids of films somebody rated; linked but unrated ones are cold."""
    return (
        clean_links(links)
        .join(ratings.select("movieId"), "movieId", "left_semi")
        .select(F.col("tmdbId").alias("tmdb_id"))
        .distinct()
    )


def coverage_by_popularity(
    linked: DataFrame, catalogue: DataFrame, ratings_per_movie: DataFrame, *, bins: int = 10
) -> DataFrame:
    """Archive coverage of our films per popularity decile of the catalogue."""
    votes = catalogue.select("tmdb_id", F.col("vote_count").cast("double").alias("votes"))
    films = linked.join(votes, "tmdb_id", "left").join(
        ratings_per_movie.select("movieId", "n_ratings"), "movieId", "left"
    )
    placed = films.withColumn("decile", quantile_buckets(catalogue, "vote_count", F.col("votes"), bins))
    placed = placed.where(F.col("decile").isNotNull())
    middle = grouped_quantiles(placed, ["decile"], "n_ratings", [0.5])
    return (
        placed.groupBy("decile")
        .agg(F.count(F.lit(1)).alias("films"), F.count_if("in_archive").alias("in_archive"))
        .join(middle, "decile", "left")
        .select(
            "decile", "films", "in_archive",
            F.coalesce(F.get("quantiles", F.lit(0)).cast("int"), F.lit(0)).alias("median_ratings"),
        )
        .withColumn("coverage", F.col("in_archive") / F.col("films"))
        .orderBy("decile")
    )
