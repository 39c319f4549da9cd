"""A personal film-rating export: flat files, list files and diaries.

Addresses of films sit in a column named ``<site> URI``; any such header is
taken. Diary rows carry the address of the *entry*, so they are matched by
title and year instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenreel.functions.text import film_slug, normalize_title, parse_year, title_year_key
from evenreel.operators.interactions import DIARY, LIKE, LIST_ENTRY, RATING, WATCHED, WATCHLIST
from evenreel.operators.ordering import first_per_key
from evenreel.sources.files import path_exists, read_text_csv, text_column

# First line of a list file (after the site's name) and the files
# of an export, in the order that decides which spelling seeds the title lookup.
LIST_MAGIC = r"^\S+ list export"
FLAT_FILES = (
    ("ratings.csv", RATING, True),
    ("watched.csv", WATCHED, False),
    ("watchlist.csv", WATCHLIST, False),
    ("likes/films.csv", LIKE, False),
)
LIST_FOLDERS = (("lists", False), ("deleted/lists", True))
DIARY_FILES = (("diary.csv", False), ("deleted/diary.csv", True), ("orphaned/diary.csv", True))

#: Stands for a line break inside quotes while a file is cut into lines.
HIDDEN = "\u0002"
#: Columns of a list file that are looked at.
LIST_WIDTH = 16

INTERACTIONS = T.StructType(
    [
        T.StructField("film_key", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("event_date", T.TimestampType()),
        T.StructField("watched_date", T.TimestampType()),
        T.StructField("rewatch", T.BooleanType()),
        T.StructField("list_name", T.StringType()),
        T.StructField("tags", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("deleted", T.BooleanType()),
    ]
)


def _blank_to_null(column: Column) -> Column:
    return F.when(F.trim(column) != "", column)


def _when(raw: Column) -> Column:
    return F.try_to_timestamp(raw)


def _conform(frame: DataFrame) -> DataFrame:
    """Interaction columns in order and type; absent ones become null."""
    return frame.select(
        *[
            text_column(frame, f.name).cast(f.dataType).alias(f.name)
            if f.name in frame.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in INTERACTIONS.fields
        ]
    )


def _uri_column(frame: DataFrame) -> Column:
    named = [c for c in frame.columns if c.endswith(" URI")]
    return F.col(f"`{named[0]}`") if named else F.lit(None).cast("string")


def uri_keyed(
    rows: DataFrame, kind: str, source: str, *, with_value: bool = False, deleted: bool = False
) -> DataFrame:
    """Rows keyed by a film address; rows without one are left out."""
    value = text_column(rows, "Rating").try_cast("double") if with_value else F.lit(None)
    return _conform(
        rows.select(
            film_slug(_uri_column(rows)).alias("film_key"),
            F.coalesce(text_column(rows, "Name"), F.lit("")).alias("title"),
            parse_year(text_column(rows, "Year")).alias("year"),
            F.lit(kind).alias("kind"),
            value.alias("value"),
            _when(text_column(rows, "Date")).alias("event_date"),
            _blank_to_null(text_column(rows, "Tags")).alias("tags"),
            F.lit(source).alias("source"),
            F.lit(deleted).alias("deleted"),
        ).where(F.col("film_key").isNotNull())
    )


def title_lookup(keyed: DataFrame, sequence: str = "seq") -> DataFrame:
    """(normalised title, year) -> the film key that used it first."""
    forms = keyed.select(
        normalize_title(F.col("title")).alias("form"),
        F.col("year").alias("form_year"),
        F.col("film_key").alias("known_key"),
        sequence,
    )
    return first_per_key(
        forms, ["form", "form_year"], [F.col(sequence), F.col("known_key")]
    ).drop(sequence)


def resolve_diary(diary: DataFrame, lookup: DataFrame) -> DataFrame:
    """Give diary rows the film key of their title and year, else a stand-in key."""
    asked = diary.withColumn("_form", normalize_title(F.col("title")))
    same = (F.col("_form") == F.col("form")) & F.col("year").eqNullSafe(F.col("form_year"))
    return (
        asked.join(lookup, same, "left")
        .withColumn(
            "film_key",
            F.coalesce(F.col("known_key"), title_year_key(F.col("title"), F.col("year"))),
        )
        .drop("_form", "form", "form_year", "known_key")
    )


def diary_rows(rows: DataFrame, source: str, *, deleted: bool) -> DataFrame:
    """Diary file rows in the interaction schema, their film key still open."""
    return _conform(
        rows.select(
            F.coalesce(text_column(rows, "Name"), F.lit("")).alias("title"),
            parse_year(text_column(rows, "Year")).alias("year"),
            F.lit(DIARY).alias("kind"),
            text_column(rows, "Rating").try_cast("double").alias("value"),
            _when(text_column(rows, "Date")).alias("event_date"),
            _when(text_column(rows, "Watched Date")).alias("watched_date"),
            F.coalesce(F.trim(text_column(rows, "Rewatch")) != "", F.lit(False)).alias("rewatch"),
            _blank_to_null(text_column(rows, "Tags")).alias("tags"),
            F.lit(source).alias("source"),
            F.lit(deleted).alias("deleted"),
        )
    )


def _cells(line: Column) -> Column:
    """Fields of one CSV record, hidden line breaks shown again; ``LIST_WIDTH`` at most."""
    names = [f"c{i}" for i in range(LIST_WIDTH)]
    record = F.from_csv(line, F.lit(", ".join(f"{n} string" for n in names)), {"escape": '"'})
    return F.transform(F.array(*[record[n] for n in names]), lambda c: F.replace(c, F.lit(HIDDEN), F.lit("\n")))


def _named(header: Column, cells: Column, name: str) -> Column:
    """The field under a header name; null where the header lacks it."""
    return F.get(cells, F.array_position(header, name).cast("int") - 1)


def list_blocks(files: DataFrame) -> DataFrame:
    """Entries of list files, given as rows (source, value) of whole texts.

    A list file has three blocks: a magic line, a header and one row about the
    list, a blank line, and a CSV of films. Without the magic line, or with the
    blank line too early, the file is no list and yields nothing. Line breaks
    inside quotes belong to their field; columns go by their header names.
    """
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    # every second stretch between quotation marks lies inside quotes
    stretches = F.transform(
        F.split(text, '"'),
        lambda s, i: F.when(i % 2 == 1, F.replace(s, F.lit("\n"), F.lit(HIDDEN))).otherwise(s),
    )
    parts = files.select("source", F.split(F.array_join(stretches, '"'), r"\n[,\s]*\n", 2).alias("parts"))
    about = F.split(F.element_at("parts", 1), "\n")
    films = F.filter(
        F.split(F.coalesce(F.try_element_at("parts", F.lit(2)), F.lit("")), "\n"),
        lambda line: F.regexp_replace(line, r"[,\s]", "") != "",
    )
    header = lambda line: F.transform(_cells(line), F.trim)
    lists = (
        parts.where(F.size("parts") == 2)
        .select("source", about.alias("about"), films.alias("films"))
        .where((F.size("about") >= 3) & F.element_at("about", 1).rlike(LIST_MAGIC) & (F.size("films") > 0))
        .select(
            "source",
            header(F.element_at("about", 2)).alias("about_header"),
            _cells(F.element_at("about", 3)).alias("about"),
            header(F.element_at("films", 1)).alias("header"),
            F.slice("films", 2, F.size("films")).alias("films"),
        )
    )
    entries = lists.select("*", F.explode("films").alias("line")).withColumn("film", _cells(F.col("line")))
    of_list = lambda name: _named(F.col("about_header"), F.col("about"), name)
    of_film = lambda name: _named(F.col("header"), F.col("film"), name)
    return entries.select(
        "source",
        of_list("Name").alias("list_name"),
        of_list("Tags").alias("tags"),
        of_list("Date").alias("date"),
        of_film("Name").alias("name"),
        of_film("Year").alias("year"),
        of_film("URL").alias("url"),
    )


def list_interactions(entries: DataFrame, *, deleted: bool) -> DataFrame:
    title = F.coalesce(F.col("name"), F.lit(""))
    year = parse_year(F.col("year"))
    return _conform(
        entries.select(
            F.coalesce(film_slug(F.col("url")), title_year_key(title, year)).alias("film_key"),
            title.alias("title"),
            year.alias("year"),
            F.lit(LIST_ENTRY).alias("kind"),
            _when(F.col("date")).alias("event_date"),
            "list_name",
            _blank_to_null(F.col("tags")).alias("tags"),
            "source",
            F.lit(deleted).alias("deleted"),
        )
    )


def load_export(spark: SparkSession, folder: str, *, include_deleted: bool = True) -> DataFrame:
    """All interactions of one export; missing files are normal."""
    empty = spark.createDataFrame([], INTERACTIONS)
    keyed = []
    for position, (name, kind, with_value) in enumerate(FLAT_FILES):
        rows = read_text_csv(spark, f"{folder}/{name}")
        if rows is not None:
            keyed.append(
                uri_keyed(rows, kind, name, with_value=with_value).withColumn("seq", F.lit(position))
            )
    numbered = reduce(DataFrame.unionByName, keyed, empty.withColumn("seq", F.lit(0)))
    lookup = title_lookup(numbered)

    parts = [numbered.drop("seq")]
    for name, deleted in LIST_FOLDERS:
        pattern = f"{folder}/{name}/*.csv"
        if (deleted and not include_deleted) or not path_exists(spark, pattern):
            continue
        files = spark.read.text(pattern, wholetext=True).select(
            F.concat(F.lit(f"{name}/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).alias(
                "source"
            ),
            "value",
        )
        parts.append(list_interactions(list_blocks(files), deleted=deleted))
    for name, deleted in DIARY_FILES:
        if deleted and not include_deleted:
            continue
        rows = read_text_csv(spark, f"{folder}/{name}")
        if rows is not None:
            open_rows = diary_rows(rows, name, deleted=deleted)
            parts.append(_conform(resolve_diary(open_rows, lookup)))
    return reduce(DataFrame.unionByName, parts)
