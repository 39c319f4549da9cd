"""Crowd rating dumps: snapshots, title matching, re-keying, the pool."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenreel.functions.numeric import half_even
from evenreel.functions.text import normalize_title
from evenreel.operators.ordering import first_per_key, hash_key, hash_rank, last_per_key
from evenreel.operators.quantiles import exact_quantiles

# How a slug got its id.
LINKED = "linked"
MATCHED = "title_year"
AMBIGUOUS = "ambiguous"
UNMATCHED = "unmatched"
DEAD_LINK = "dead link"
NO_RECORD = "no film record"

MIN_RATERS = 10
ITEM_PRIOR = 20.0


def stack_in_order(frames: Sequence[DataFrame], sequence: str = "seq") -> DataFrame:
    """Union of frames, oldest first, numbered by age."""
    numbered = [f.withColumn(sequence, F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def latest_snapshot(ratings: DataFrame, *, sequence: str = "seq") -> DataFrame:
    """Each member's ratings from the newest dump that has the member.

    A dump is a member's whole rated list, so the newer one replaces the older
    as a whole and never film by film.
    """
    newest = ratings.groupBy("member").agg(F.max(sequence).alias(sequence))
    return ratings.join(newest, ["member", sequence], "left_semi")


def superseded_members(ratings: DataFrame, *, sequence: str = "seq") -> DataFrame:
    """Per dump: members present, and members a newer dump replaces."""
    newest = ratings.groupBy("member").agg(F.max(sequence).alias("newest"))
    presence = ratings.select("member", "dump", sequence).distinct()
    return (
        presence.join(newest, "member")
        .groupBy("dump")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.count_if(F.col(sequence) < F.col("newest")).alias("superseded"),
        )
    )


def match_by_title_year(unlinked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """slug -> (tmdb_id, how) where exactly one catalogue film fits.

    A film fits when its literal normalised title or original title equals the
    slug's and the years are at most one apart; an exact year beats a near one.

    The catalogue is reduced to the lowest and highest id per (title, year)
    first: equal means one film, unequal means several. A slug then meets three
    rows at most - its year and the two beside it - however many films share a
    famous title.
    """
    titles = [c for c in ("title", "original_title") if c in catalogue.columns]
    forms = (
        catalogue.where(F.col("year").isNotNull())
        .select(
            "tmdb_id",
            F.col("year").alias("near_year"),
            F.explode(F.array_distinct(F.array(*[normalize_title(F.col(c)) for c in titles]))).alias(
                "form"
            ),
        )
        .where(F.col("form") != "")
        .groupBy("form", "near_year")
        .agg(F.min("tmdb_id").alias("low"), F.max("tmdb_id").alias("high"))
    )
    asked = unlinked.select("slug", "year", normalize_title(F.col("title")).alias("form"))
    wanted = asked.where(F.col("year").isNotNull() & (F.col("form") != "")).select(
        "slug",
        "form",
        F.explode(
            F.array(
                F.struct(F.col("year").alias("near_year"), F.lit(0).alias("delta")),
                F.struct((F.col("year") - 1).alias("near_year"), F.lit(1).alias("delta")),
                F.struct((F.col("year") + 1).alias("near_year"), F.lit(1).alias("delta")),
            )
        ).alias("probe"),
    )
    found = (
        wanted.select("slug", "form", "probe.near_year", "probe.delta")
        .join(forms, ["form", "near_year"])
        .groupBy("slug", "delta")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .groupBy("slug")
        .agg(F.min_by(F.struct("low", "high"), "delta").alias("best"))
    )
    single = F.col("best.low") == F.col("best.high")
    return unlinked.select("slug").join(found, "slug", "left").select(
        "slug",
        F.when(single, F.col("best.low")).alias("tmdb_id"),
        F.when(F.col("best").isNull(), UNMATCHED)
        .when(single, MATCHED)
        .otherwise(AMBIGUOUS)
        .alias("how"),
    )


def slug_map(
    films: DataFrame, catalogue: DataFrame, live_ids: DataFrame | None = None, *, sequence: str = "seq"
) -> DataFrame:
    """One row per slug: its own link, else the title match.

    ``films`` stacks the dumps' film tables (see `stack_in_order`). The oldest
    link and the newest title and year win. A link outside ``live_ids`` is dead
    and the slug is matched like an unlinked one.
    """
    linked = first_per_key(
        films.where(F.col("tmdb_id").isNotNull()).select("slug", "tmdb_id", sequence),
        ["slug"],
        [F.col(sequence), F.col("tmdb_id")],
    ).drop(sequence)
    described = last_per_key(
        films.select("slug", "title", "year", sequence),
        ["slug"],
        [F.col(sequence), F.col("title")],
    ).drop(sequence)
    table = described.join(linked, "slug", "left")
    if live_ids is None:
        table = table.withColumn("live", F.col("tmdb_id").isNotNull())
    else:
        alive = live_ids.select(F.col("tmdb_id").alias("live_id")).distinct()
        table = table.join(alive, F.col("tmdb_id") == F.col("live_id"), "left").withColumn(
            "live", F.col("live_id").isNotNull()
        )
    rest = table.where(~F.col("live"))
    matched = match_by_title_year(rest.select("slug", "title", "year"), catalogue)
    resolved = rest.join(
        matched.select("slug", F.col("tmdb_id").alias("match_id"), F.col("how").alias("match_how")),
        "slug",
    ).select(
        "slug",
        "title",
        "year",
        F.col("match_id").alias("tmdb_id"),
        F.when(F.col("match_how") != UNMATCHED, F.col("match_how"))
        .when(F.col("tmdb_id").isNotNull(), DEAD_LINK)
        .otherwise(UNMATCHED)
        .alias("how"),
    )
    kept = table.where("live").select(
        "slug", "title", "year", "tmdb_id", F.lit(LINKED).alias("how")
    )
    return kept.unionByName(resolved)


def mapping_report(
    ratings: DataFrame, slugs: DataFrame, *, min_raters: int = MIN_RATERS
) -> DataFrame:
    """Slugs, ratings and pool-sized slugs carried by each mapping route."""
    per_slug = ratings.groupBy("slug").agg(F.count_distinct("member").alias("raters"))
    report = (
        per_slug.join(slugs.select("slug", "how"), "slug", "left")
        .groupBy(F.coalesce("how", F.lit(NO_RECORD)).alias("how"))
        .agg(
            F.count(F.lit(1)).alias("slugs"),
            F.sum("raters").alias("ratings"),
            F.count_if(F.col("raters") >= min_raters).alias("pool_sized"),
        )
    )
    total = F.sum("ratings").over(W.partitionBy())  # one row per route
    return report.withColumn("share", F.col("ratings") / total).orderBy(F.desc("ratings"), "how")


def ratings_by_film(ratings: DataFrame, slugs: DataFrame, *, sequence: str = "seq") -> DataFrame:
    """One row per (member, film): several slugs of one film are averaged."""
    ids = slugs.where(F.col("tmdb_id").isNotNull()).select("slug", "tmdb_id")
    return (
        ratings.join(ids, "slug")
        .groupBy("member", "tmdb_id")
        .agg(
            half_even(F.avg("rating")).cast("int").alias("rating"),
            F.max_by("dump", sequence).alias("dump"),
        )
    )


def as_model_ratings(ratings: DataFrame) -> DataFrame:
    """Integer user codes, film id as movieId, stars on 0.5-5."""
    codes = hash_rank(
        ratings.select("member").distinct(), hash_key(F.col("member")), "code", order=["member"]
    )
    return ratings.join(codes, "member").select(
        (F.col("code") - 1).cast("int").alias("userId"),
        F.col("tmdb_id").cast("long").alias("movieId"),
        (F.col("rating") / F.lit(2.0)).alias("rating"),
    )


def item_bias(
    ratings: DataFrame, item: str = "movieId", rating: Column | None = None, *, prior: float = ITEM_PRIOR
) -> DataFrame:
    """Each film's shrunk departure from the crowd mean: (sum - n*mean)/(n+prior)."""
    stars = F.col("rating") if rating is None else rating
    mean = ratings.agg(F.avg(stars)).scalar()
    sums = ratings.groupBy(item).agg(F.sum(stars).alias("_sum"), F.count(stars).alias("n"))
    return sums.select(
        item,
        "n",
        ((F.col("_sum") - F.col("n") * mean) / (F.col("n") + F.lit(prior))).alias("bias"),
    )


def pool(ratings: DataFrame, catalogue: DataFrame, *, min_raters: int = MIN_RATERS) -> DataFrame:
    """Catalogue films rated by at least ``min_raters`` distinct members."""
    return rated_films(ratings, min_raters=min_raters).join(
        catalogue.select("tmdb_id").distinct(), "tmdb_id", "left_semi"
    )


def rated_films(ratings: DataFrame, *, min_raters: int = MIN_RATERS) -> DataFrame:
    raters = ratings.groupBy("tmdb_id").agg(F.count_distinct("member").alias("raters"))
    return raters.where(F.col("raters") >= min_raters)


def rated_elsewhere(
    ratings: DataFrame, catalogue: DataFrame, *, min_raters: int = MIN_RATERS
) -> DataFrame:
    """How many well-rated films the catalogue does not list."""
    return (
        rated_films(ratings, min_raters=min_raters)
        .join(catalogue.select("tmdb_id"), "tmdb_id", "left_anti")
        .agg(F.count(F.lit(1)).alias("rated_elsewhere"))
    )


# Crowd-less share in which the stratified ranker was measured.
VALIDATED_COLD_SHARE = (0.25, 0.46)


def pool_summary(pool_films: DataFrame, catalogue: DataFrame, known_ids: DataFrame) -> DataFrame:
    """Films, crowd-less share, median votes, zero votes, share under 20 votes."""
    votes = F.coalesce(F.col("vote_count").cast("long"), F.lit(0))
    known = known_ids.select(F.col("tmdb_id").alias("known_id")).distinct()
    films = (
        catalogue.select("tmdb_id", votes.alias("votes"))
        .join(pool_films.select("tmdb_id"), "tmdb_id", "left_semi")
        .join(known, F.col("tmdb_id") == F.col("known_id"), "left")
    )
    low, high = VALIDATED_COLD_SHARE
    cold = F.avg(F.col("known_id").isNull().cast("double"))
    return films.agg(
        F.count(F.lit(1)).alias("films"),
        cold.alias("cold_share"),
        F.lit(exact_quantiles(films, "votes", [0.5])[0]).cast("double").alias("median_votes"),
        F.count_if(F.col("votes") == 0).alias("zero_votes"),
        F.avg((F.col("votes") < 20).cast("double")).alias("under_20_share"),
    ).withColumn("validated", F.col("cold_share").between(low, high))


def pool_by_year(
    pool_films: DataFrame, catalogue: DataFrame, first: int, last: int
) -> DataFrame:
    """Pool and catalogue films per release year, years without films included."""
    in_pool = pool_films.select(F.col("tmdb_id").alias("pool_id")).distinct()
    per_year = (
        catalogue.where(F.col("year").between(first, last))
        .join(in_pool, F.col("tmdb_id") == F.col("pool_id"), "left")
        .groupBy("year")
        .agg(F.count(F.lit(1)).alias("catalogue"), F.count("pool_id").alias("pool"))
    )
    years = catalogue.sparkSession.range(first, last + 1).select(
        F.col("id").cast("int").alias("year")
    )
    counted = years.join(per_year, "year", "left").na.fill(0, ["catalogue", "pool"])
    return counted.withColumn(
        "share", F.when(F.col("catalogue") > 0, F.col("pool") / F.col("catalogue"))
    ).orderBy("year")
