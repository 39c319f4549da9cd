"""The candidate catalogue: which films may be recommended, and what is known of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenreel.functions.numeric import band_ordinal, popularity_band
from evenreel.operators.ordering import first_per_key

WATCHABLE_STATUSES = ("Released",)


def _has_title() -> Column:
    return F.trim(F.coalesce(F.col("title"), F.lit(""))) != ""


def _released() -> Column:
    return F.coalesce(F.col("status").isin(*WATCHABLE_STATUSES), F.lit(False))


def recommendable(films: DataFrame) -> DataFrame:
    """Released, titled films, one row per id - never a filter on fame."""
    kept = films.where((F.col("media_type") == "movie") & _has_title() & _released())
    return first_per_key(kept, ["tmdb_id"], [F.col("title")])


def drop_counts(films: DataFrame) -> DataFrame:
    """How many films each rule drops, and the share kept, in one pass."""
    movies = films.where(F.col("media_type") == "movie").select(
        "tmdb_id", _has_title().alias("titled"), _released().alias("released")
    )
    kept_id = F.when(F.col("titled") & F.col("released"), F.col("tmdb_id"))
    return movies.agg(
        F.count_if(~F.col("titled")).alias("no_title"),
        F.count_if(F.col("titled") & ~F.col("released")).alias("not_released"),
        F.count_distinct(kept_id).alias("kept"),
        (F.count_distinct(kept_id) / F.count(F.lit(1))).alias("kept_share"),
    )


def exclude_seen(catalogue: DataFrame, seen_ids: DataFrame) -> DataFrame:
    return catalogue.join(seen_ids.select("tmdb_id"), "tmdb_id", "left_anti")


def overlay_enriched(catalogue: DataFrame, enriched: DataFrame) -> DataFrame:
    """The enriched record where there is one, the catalogue's otherwise."""
    rich = enriched.where(F.col("media_type") == "movie")
    rest = catalogue.join(
        rich.select("tmdb_id").where(F.col("tmdb_id").isNotNull()), "tmdb_id", "left_anti"
    )
    return rich.withColumn("enriched", F.lit(True)).unionByName(
        rest.withColumn("enriched", F.lit(False)), allowMissingColumns=True
    )


def band_report(catalogue: DataFrame) -> DataFrame:
    """Films and share per popularity band."""
    votes = F.col("vote_count")
    counts = catalogue.groupBy(
        band_ordinal(votes).alias("band_no"), popularity_band(votes).alias("band")
    ).agg(F.count(F.lit(1)).alias("films"))
    total = F.sum("films").over(W.partitionBy())  # eight bands
    return counts.withColumn("share", F.col("films") / total).orderBy("band_no")


def metadata_completeness(catalogue: DataFrame) -> DataFrame:
    """Share of films per band that have each kind of metadata."""
    votes = F.col("vote_count")
    shares = [
        F.avg((F.coalesce(F.size(c), F.lit(0)) > 0).cast("double")).alias(c)
        for c in ("keywords", "cast", "directors", "genres")
        if c in catalogue.columns
    ]
    if "overview" in catalogue.columns:
        text = F.trim(F.coalesce(F.col("overview"), F.lit("")))
        shares.append(F.avg((text != "").cast("double")).alias("overview"))
    return (
        catalogue.groupBy(band_ordinal(votes).alias("band_no"), popularity_band(votes).alias("band"))
        .agg(F.count(F.lit(1)).alias("films"), *shares)
        .orderBy("band_no")
    )
