"""The resumable film store and the batch normalisation of fetched titles."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenreel.operators.ordering import first_per_key
from evenreel.operators.resolution import fresh_overrides
from evenreel.sources.files import path_exists


def pending_ids(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted ids the store does not hold yet."""
    return wanted.join(stored.select("tmdb_id"), "tmdb_id", "left_anti")


def load_store(batches: DataFrame, sequence: str = "batch") -> DataFrame:
    """The store without repeats: the earliest batch's record of each id."""
    rest = [F.col(c) for c in batches.columns if c not in ("tmdb_id", sequence)]
    return first_per_key(batches, ["tmdb_id"], [F.col(sequence), *rest]).drop(sequence)


def append_new(batch: DataFrame, path: str, stored: DataFrame | None) -> None:
    """Append records the store lacks; running a batch twice adds nothing."""
    rest = [F.col(c) for c in batch.columns if c != "tmdb_id"]
    fresh = first_per_key(batch, ["tmdb_id"], rest)
    if stored is not None:
        fresh = pending_ids(fresh, stored)
    fresh.write.mode("append").option("compression", "zstd").parquet(path)


def _readable(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of the files that can be read, each with its file; a torn file gives what comes before the tear."""
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True)
    return reader.parquet(path).withColumn("_file", F.col("_metadata.file_path"))


def store_manifest(spark: SparkSession, path: str, schema) -> DataFrame:
    """(file, rows) of the store's files as they are now; to be kept beside the store after each append."""
    return _readable(spark, path, schema).groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def damaged_files(spark: SparkSession, path: str, schema, manifest: DataFrame) -> DataFrame:
    """(file): recorded files that are gone, cannot be read or hold another number of rows than recorded.

    All columns are read, so that a tear behind the first of them shows as well.
    """
    rows = _readable(spark, path, schema)
    filled = reduce(add, [F.col(c).isNotNull().cast("int") for c in rows.columns if c != "_file"])
    found = rows.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("now"), F.sum(filled).alias("_filled"))
    checked = manifest.join(found, "file", "left")
    # the second condition never holds; it keeps all columns in the scan
    other = (F.col("now") != F.col("rows")) | (F.col("_filled") < 0)
    return checked.where(F.coalesce(other, F.lit(True))).select("file")


def load_healthy(spark: SparkSession, path: str, schema, manifest: DataFrame) -> DataFrame:
    """The store without its damaged and unrecorded files; what they held is pending again."""
    damaged = damaged_files(spark, path, schema, manifest)
    sound = manifest.select("file").join(damaged, "file", "left_anti").withColumnRenamed("file", "_file")
    return _readable(spark, path, schema).join(sound, "_file", "left_semi").drop("_file")


def titles_to_fetch(film_map: DataFrame) -> DataFrame:
    """Each resolved (id, medium) once, however many films share it."""
    return film_map.where(F.col("tmdb_id").isNotNull()).select("tmdb_id", "media_type").distinct()


def enrich(film_map: DataFrame, normalised: DataFrame) -> DataFrame:
    """Metadata of every resolved title that was fetched."""
    return titles_to_fetch(film_map).join(normalised, ["tmdb_id", "media_type"])


def missing_titles(film_map: DataFrame, normalised: DataFrame) -> DataFrame:
    """Resolved titles without a payload."""
    return titles_to_fetch(film_map).join(
        normalised.select("tmdb_id", "media_type"), ["tmdb_id", "media_type"], "left_anti"
    )


def write_result(frame: DataFrame, path: str, *, fmt: str = "parquet") -> None:
    """Write a result table as parquet, or as CSV with a header."""
    writer = frame.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def append_overrides(reviewed: DataFrame, path: str) -> DataFrame:
    """Write the rows whose film is not recorded yet behind the overrides at ``path``.

    Rows of one call share a sequence number above all earlier ones. A repeated call
    adds nothing. Returns the whole table, of which ``latest_overrides`` takes the
    last row per film.
    """
    spark = reviewed.sparkSession
    rows = reviewed.select("film_key", "tmdb_id", "media_type")
    if path_exists(spark, path):
        recorded = spark.read.parquet(path)
        last = recorded.agg(F.max("seq")).first()[0]
        rows = fresh_overrides(rows, recorded.select(F.trim("film_key").alias("film_key")).distinct())
    else:
        last = None
    number = F.lit(0 if last is None else last + 1).cast("long")
    rows.withColumn("seq", number).write.mode("append").parquet(path)
    return spark.read.parquet(path)
