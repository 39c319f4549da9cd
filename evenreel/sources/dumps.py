"""Scraped crowd dumps and id exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenreel.functions.numeric import ten_point
from evenreel.functions.text import finite_number, json_list
from evenreel.operators.ordering import first_per_key
from evenreel.sources.files import quoted_records

#: No cell ever equals this, so no cell is read as null: "null" and "nan" are slugs.
NEVER = "\u0000\u0000"

CORRUPT = "_corrupt"
#: Where a row begins: file, byte range, line.
PLACE = "_place"


def read_crowd_ratings(
    spark: SparkSession, path: str, *, member: str, slug: str, rating: str, doubled: bool
) -> DataFrame:
    """(member, slug, rating 1-10) of one dump layout.

    Names lose their case (sharp s included) and outer white space; slugs stay as they are, even empty-looking
    ones. A rating off the scale fails the job.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, nullValue=NEVER, emptyValue="")
    frame = raw.select(
        F.replace(
            F.lower(F.regexp_replace(F.coalesce(F.col(member), F.lit("")), r"(?U)^\s+|\s+$", "")), F.lit("ß"), F.lit("ss")
        ).alias("member"),
        F.coalesce(F.col(slug), F.lit("")).alias("slug"),
        F.col(rating).alias("rating"),
    )
    return ten_point(frame, "rating", doubled=doubled)


def read_ragged(
    spark: SparkSession, path: str, columns: list[str], *, header: bool = True
) -> DataFrame:
    """A film table whose truncated rows are flagged, not guessed at.

    Rows with fewer or more fields than ``columns`` keep their text in
    ``_corrupt``; `intact` drops them and `scan_counts` counts them. Line breaks
    inside quotes belong to the row, and a large file is read by many tasks all the
    same. ``_place`` orders the rows as the files have them.
    """
    schema = ", ".join(f"`{c}` string" for c in (*columns, CORRUPT))
    options = {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
        "escape": '"', "nullValue": NEVER, "emptyValue": "",
    }
    records = quoted_records(spark.read.text(path), header=header)
    return records.select(F.from_csv("record", schema, options).alias("r"), PLACE).select("r.*", PLACE)


def intact(ragged: DataFrame) -> DataFrame:
    return ragged.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def scan_counts(ragged: DataFrame, usable: Column | None = None) -> DataFrame:
    """Rows read and rows skipped: (part, n); rows that aren't ``usable`` are skipped too."""
    skipped = F.col(CORRUPT).isNotNull()
    if usable is not None:
        skipped = skipped | ~F.coalesce(usable, F.lit(False))
    part = F.when(skipped, "skipped").otherwise("intact")
    # counts the first field: a scan may not read the corrupt column alone
    return ragged.groupBy(part.alias("part")).agg(F.count(ragged.columns[0]).alias("n"))


def _order(table: DataFrame) -> Column:
    """File order: the place of a scanned row, else the order in which rows come."""
    return F.col(PLACE) if PLACE in table.columns else F.monotonically_increasing_id()


def dump_films(
    table: DataFrame, *, slug: str, title: str, year: str, tmdb_id: str | None = None
) -> DataFrame:
    """(slug, tmdb_id, title, year) of a dump's film table, first row per slug."""
    linked = finite_number(F.col(tmdb_id)).cast("long") if tmdb_id else F.lit(None).cast("long")
    frame = table.select(
        F.col(slug).alias("slug"),
        linked.alias("tmdb_id"),
        F.col(title).alias("title"),
        finite_number(F.col(year)).cast("int").alias("year"),
        _order(table).alias("_line"),
    )
    return first_per_key(frame, ["slug"], [F.col("_line")]).drop("_line")


def names_a_film() -> Column:
    """Whether a row of a dump's film table has a readable id and a title."""
    return finite_number(F.col("tmdb_id")).cast("long").isNotNull() & (F.trim("movie_title") != "")


def dump_catalogue(table: DataFrame, line: str | None = None) -> DataFrame:
    """A dump's film table in the catalogue schema, one row per id.

    Rows without a readable id or a title are left out; a runtime of 0 means
    unknown.
    """
    blank = lambda name: F.when(F.trim(F.col(name)) != "", F.trim(F.col(name)))
    order = F.col(line) if line else _order(table)
    frame = table.where(names_a_film()).select(
        finite_number(F.col("tmdb_id")).cast("long").alias("tmdb_id"),
        blank("imdb_id").alias("imdb_id"),
        F.trim("movie_title").alias("title"),
        finite_number(F.col("year_released")).cast("int").alias("year"),
        blank("release_date").alias("release_date"),
        F.nullif(finite_number(F.col("runtime")).cast("int"), F.lit(0)).alias("runtime"),
        F.trim("overview").alias("overview"),
        json_list(F.col("genres")).alias("genres"),
        json_list(F.col("production_countries")).alias("production_countries"),
        blank("original_language").alias("original_language"),
        finite_number(F.col("vote_average")).alias("vote_average"),
        finite_number(F.col("vote_count")).cast("long").alias("vote_count"),
        F.lit("movie").alias("media_type"),
        order.alias("_line"),
    )
    return first_per_key(frame, ["tmdb_id"], [F.col("_line")]).drop("_line")


ID_EXPORT_SCHEMA = (
    "adult boolean, id long, original_title string, popularity double, video boolean"
)


def read_id_export(spark: SparkSession, path: str) -> DataFrame:
    """The line-JSON id export, plain or gzipped."""
    return spark.read.schema(ID_EXPORT_SCHEMA).json(path)


def id_export(raw: DataFrame, *, include_video: bool = False) -> DataFrame:
    """Ids worth fetching; concert and video releases only on request."""
    video = F.coalesce("video", F.lit(False))
    kept = raw if include_video else raw.where(~video)
    return kept.select(
        F.col("id").alias("tmdb_id"),
        F.coalesce("original_title", F.lit("")).alias("original_title"),
        F.coalesce("popularity", F.lit(0.0)).alias("export_popularity"),
    )


def most_popular_first(ids: DataFrame) -> DataFrame:
    return ids.orderBy(F.desc("export_popularity"), "tmdb_id")
