"""The rating-analytics tables, derived from the bundled star schema.

Parts play films, customers play members, order lines play ratings, events play
one export per user. ``oracle.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenreel.functions.numeric import half_even
from evenreel.operators import catalogue as cat
from evenreel.operators.interactions import DIARY, LIKE, RATING, WATCHED, WATCHLIST
from evenreel.session import written

HISTORY_SIZES = (5, 10, 20)


class Tables:
    """Views over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str, build) -> DataFrame:
        """A table of the pipeline, written once and read by all later steps."""
        if name not in self._stored:
            self._stored[name] = written(build(), name)
        return self._stored[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- crowd -------------------------------------------------------------
    def ratings10(self) -> DataFrame:
        """member, item, rating 1-10, dump and its age, flag of the crowd."""
        lines = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        old = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("member"),
            F.col("l_partkey").alias("item"),
            F.ceil(F.col("l_quantity") / 5).cast("int").alias("rating"),
            F.when(old, 0).otherwise(1).alias("seq"),
            F.when(old, "old").otherwise("new").alias("dump"),
            F.col("l_returnflag").alias("flag"),
        )

    def crowd(self) -> DataFrame:
        """The two dumps: member and slug as text."""
        return self.ratings10().select(
            F.concat(F.lit("m"), F.col("member").cast("string")).alias("member"),
            F.concat(F.lit("s"), F.col("item").cast("string")).alias("slug"),
            "rating",
            "dump",
            "seq",
        )

    def model_ratings(self) -> DataFrame:
        """userId, movieId, stars: one row per (member, film), repeats averaged."""
        return self.stored("ratings", self._model_ratings)

    def _model_ratings(self, flags: tuple[str, ...] | None = None) -> DataFrame:
        rows = self.ratings10()
        if flags is not None:
            rows = rows.where(F.col("flag").isin(*flags))
        return rows.groupBy(F.col("member").alias("userId"), F.col("item").alias("movieId")).agg(
            (half_even(F.avg("rating")) / 2).alias("rating")
        )

    def crowd_a(self) -> DataFrame:
        return self.stored("crowd-a", lambda: self._model_ratings(("A", "R")))

    def crowd_b(self) -> DataFrame:
        return self.stored("crowd-b", lambda: self._model_ratings(("N",)))

    # -- films -------------------------------------------------------------
    def films(self) -> DataFrame:
        """The film store: 20 columns, some titles blank, some films unreleased."""
        p = self.raw("part")
        r = F.round((F.col("p_retailprice") - 900) * 10).cast("long")
        size, kind, name, brand = (F.col(c) for c in ("p_size", "p_type", "p_name", "p_brand"))
        no_words = F.array().cast("array<string>")
        return p.select(
            F.col("p_partkey").alias("tmdb_id"),
            F.when(kind == "MEDIUM", "tv").otherwise("movie").alias("media_type"),
            F.format_string("tt%07d", F.col("p_partkey")).alias("imdb_id"),
            F.when((kind == "SMALL") & (size > 45), "")
            .otherwise(F.concat(name, F.lit(" "), brand))
            .alias("title"),
            name.alias("original_title"),
            F.lower(F.substring(kind, 1, 2)).alias("original_language"),
            (size + 1950).alias("year"),
            F.when(size >= 5, size * 2 + 60).alias("runtime"),
            F.when((kind == "PROMO") & (size > 40), "Planned").otherwise("Released").alias("status"),
            F.concat(name, F.lit(" by "), brand).alias("overview"),
            F.lower(kind).alias("tagline"),
            F.array(kind).alias("genres"),
            F.when(size >= 10, F.split(name, " ")).otherwise(no_words).alias("keywords"),
            F.when(size >= 25, F.array(F.concat(brand, F.lit(" Star")), name))
            .otherwise(no_words)
            .alias("cast"),
            F.array(brand).alias("directors"),
            F.array(F.substring(kind, 1, 2)).alias("production_countries"),
            F.expr("cast(round((p_retailprice - 900) * 10) as bigint) * "
                   "cast(round((p_retailprice - 900) * 10) as bigint) div 50").alias("vote_count"),
            ((r % 91) / F.lit(10.0)).alias("vote_average"),
            F.col("p_retailprice").alias("popularity"),
        )

    def catalogue(self) -> DataFrame:
        return cat.recommendable(self.films())

    def votes(self) -> DataFrame:
        return self.films().select("tmdb_id", "vote_count", "vote_average")

    def rated_films(self) -> DataFrame:
        """Every member's rated films beside the films' votes."""
        films = self.films().select(
            F.col("tmdb_id").alias("movieId"),
            "title",
            "year",
            "genres",
            "directors",
            "vote_count",
            "vote_average",
        )
        return self.model_ratings().join(films, "movieId")

    def house(self) -> DataFrame:
        """One rating per film - the crowd's mean - beside its features' sources."""
        mean = self.model_ratings().groupBy("movieId").agg(F.avg("rating").alias("rating"))
        return self.films().join(mean, F.col("tmdb_id") == F.col("movieId")).drop("movieId")

    def links(self) -> DataFrame:
        """Archive numbers: blank ids for one type, repeated ids for another."""
        kind = F.col("p_type")
        return self.raw("part").select(
            (F.col("p_partkey") + 500000).alias("movieId"),
            F.col("p_partkey").alias("imdbId"),
            F.when(kind == "PROMO", None)
            .when(kind == "LARGE", F.col("p_size"))
            .otherwise(F.col("p_partkey"))
            .cast("double")
            .alias("tmdbId"),
        )

    def vectors(self) -> DataFrame:
        """Content vectors of the films that have one: (movieId, vec)."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("movieId"), F.col("embedding").cast("array<double>").alias("vec")
        )

    def labelled_vectors(self) -> DataFrame:
        """row, rating, vec: one person's rated films with content vectors."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("row"),
            ((F.col("label") + 1) / F.lit(2.0)).alias("rating"),
            F.col("embedding").cast("array<double>").alias("vec"),
        )

    def documents(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("row"), "text")

    # -- dumps' film tables -------------------------------------------------
    def dump_films(self) -> list[DataFrame]:
        """Film tables of two dumps, oldest first."""
        p = self.raw("part")
        slug = F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("slug")
        year = (F.col("p_size") + 1950).alias("year")
        linked = F.when(~F.col("p_type").isin("PROMO", "SMALL"), F.col("p_partkey"))
        old = p.where(F.col("p_type") != "LARGE").select(
            slug, linked.alias("tmdb_id"), F.concat("p_name", F.lit(" "), "p_brand").alias("title"), year
        )
        new = p.where(F.col("p_type") != "ECONOMY").select(
            slug,
            F.lit(None).cast("long").alias("tmdb_id"),
            F.upper(F.concat("p_name", F.lit(", "), "p_brand")).alias("title"),
            year,
        )
        return [old, new]

    def live_ids(self) -> DataFrame:
        """Ids that still exist: series have been moved away."""
        return self.films().where(F.col("media_type") == "movie").select("tmdb_id")

    # -- exports -----------------------------------------------------------
    def interactions(self) -> DataFrame:
        """One export per user, in the interaction schema plus user_id."""
        kind = F.create_map(
            *[F.lit(x) for pair in (("purchase", RATING), ("view", WATCHED), ("click", WATCHLIST),
                                    ("signup", LIKE), ("error", DIARY)) for x in pair]
        )[F.col("event_type")]
        key = F.get_json_object("props", "$.k")
        events = self.raw("events").select(
            "event_id", "user_id", key.alias("film_key"), kind.alias("kind"), "value", "ts"
        )
        films = self.raw("part").select(
            F.col("p_partkey").cast("string").alias("film_key"),
            F.concat("p_name", F.lit(" "), "p_brand").alias("name"),
            (F.col("p_size") + 1950).alias("year"),
        )
        stars = F.least(F.lit(5.0), F.greatest(F.lit(0.5), F.ceil(F.col("value") / 10) / F.lit(2.0)))
        has_stars = F.col("kind").isin(RATING, DIARY)
        return events.join(films, "film_key").select(
            "user_id",
            "film_key",
            F.when(F.col("kind").isin(WATCHED, LIKE), F.lower("name")).otherwise(F.col("name")).alias("title"),
            "year",
            "kind",
            F.when(has_stars, stars).alias("value"),
            F.col("ts").alias("event_date"),
            F.when(F.col("kind") == DIARY, F.col("ts")).alias("watched_date"),
            (F.col("value") > 100).alias("deleted"),
        )

    def film_map(self) -> DataFrame:
        """Resolved films in several states of confidence."""
        kind = F.col("p_type")
        no_id = kind == "SMALL"
        tmdb_id = F.when(no_id, None).when(kind == "ECONOMY", F.col("p_size")).otherwise(F.col("p_partkey"))
        confidence = (
            F.when(kind == "SMALL", "unresolved")
            .when(kind == "MEDIUM", "medium")
            .when(kind == "ECONOMY", "high")
            .when(kind == "PROMO", "override")
            .otherwise("exact")
        )
        return self.raw("part").select(
            F.col("p_partkey").cast("string").alias("film_key"),
            F.concat("p_name", F.lit(" "), "p_brand").alias("title"),
            (F.col("p_size") + 1950).alias("year"),
            tmdb_id.cast("long").alias("tmdb_id"),
            F.when(~no_id, F.when(kind == "MEDIUM", "tv").otherwise("movie")).alias("media_type"),
            F.when(no_id, "").otherwise(F.col("p_name")).alias("tmdb_title"),
            F.when(~no_id, F.col("p_size") + 1950).alias("tmdb_year"),
            confidence.alias("confidence"),
            F.when(kind == "PROMO", "override").otherwise("auto").alias("source"),
        )

    def overrides(self) -> DataFrame:
        """An append-only table of corrections; one key per 20 orders or so recurs."""
        kind = F.col("o_orderpriority")
        return self.raw("orders").select(
            F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("film_key"),
            F.when(kind == "5-LOW", "").when(kind == "1-URGENT", "n/a")
            .otherwise(F.col("o_orderkey").cast("string")).alias("tmdb_id"),
            F.when(kind == "2-HIGH", " TV ").when(kind == "3-MEDIUM", "disc").otherwise("movie").alias(
                "media_type"
            ),
            F.col("o_orderkey").alias("seq"),
        )
