"""Rating archive members -> typed parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenreel.sources.files import path_exists

# Members of the archive and their column types.
MEMBERS = {
    "ratings": "userId int, movieId int, rating float, timestamp long",
    "movies": "movieId int, title string, genres string",
    "links": "movieId int, imdbId long, tmdbId double",
    "tags": "userId int, movieId int, tag string, timestamp long",
}


def prepare(spark: SparkSession, folder: str, out: str, members: list[str] | None = None) -> list[str]:
    """Convert unpacked CSV members to zstd parquet; returns the tables present.

    Members already converted are left alone and absent ones skipped.
    """
    present = []
    for name in members or list(MEMBERS):
        target = f"{out}/{name}.parquet"
        if path_exists(spark, f"{target}/_SUCCESS"):
            present.append(name)
            continue
        if not path_exists(spark, f"{folder}/{name}.csv"):
            continue
        table = spark.read.csv(f"{folder}/{name}.csv", header=True, schema=MEMBERS[name], escape='"')
        table.write.mode("overwrite").option("compression", "zstd").parquet(target)
        present.append(name)
    return present


def load(spark: SparkSession, out: str, name: str) -> DataFrame:
    return spark.read.schema(MEMBERS[name]).parquet(f"{out}/{name}.parquet")
