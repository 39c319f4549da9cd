"""Film and series payloads (JSON) -> one flat film table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenreel.functions.text import release_year

# How many billed cast members to keep, and the writing jobs.
CAST_DEPTH = 10
WRITING_JOBS = ("Writer", "Screenplay", "Story", "Author", "Novel")

_PERSON = "struct<id:long,name:string"
_NAMED = "array<struct<id:long,name:string>>"
_SHARED = f"""
    id long, original_language string, status string, adult boolean,
    overview string, tagline string, genres {_NAMED},
    production_countries array<struct<iso_3166_1:string>>,
    spoken_languages array<struct<iso_639_1:string>>,
    vote_average double, vote_count long, popularity double,
    external_ids struct<imdb_id:string>
"""
MOVIE_SCHEMA = f"""
    {_SHARED}, imdb_id string, title string, original_title string,
    release_date string, runtime long, budget long, revenue long,
    belongs_to_collection struct<id:long,name:string>,
    keywords struct<keywords:{_NAMED}>,
    credits struct<cast:array<{_PERSON},order:int>>,
                   crew:array<{_PERSON},job:string,department:string>>>
"""
SERIES_SCHEMA = f"""
    {_SHARED}, name string, original_name string, first_air_date string,
    episode_run_time array<long>, created_by {_NAMED},
    keywords struct<results:{_NAMED}>,
    aggregate_credits struct<cast:array<{_PERSON},order:int>>>
"""


def _present(column: Column) -> Column:
    return F.when(column != "", column)


def _text(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _list(items: Column, field: str, kind: str) -> Column:
    """The non-empty values of one field of a list of records."""
    values = F.transform(items, lambda item: item[field])
    kept = F.filter(
        values,
        (lambda v: v.isNotNull() & (v != "")) if kind == "string" else (lambda v: v.isNotNull() & (v != 0)),
    )
    return F.coalesce(kept, F.array().cast(f"array<{kind}>"))


def _billed(cast: Column) -> Column:
    """The first ten cast members by billing, file order among equals."""
    numbered = F.transform(
        cast,
        lambda person, i: F.struct(
            F.coalesce(person["order"], F.lit(CAST_DEPTH * 10)).alias("order"),
            i.alias("place"),
            person["id"].alias("id"),
            person["name"].alias("name"),
        ),
    )
    return F.slice(F.array_sort(numbered), 1, CAST_DEPTH)


def _flat(payload: Column, media: str, parts: dict[str, Column]) -> list[Column]:
    p = payload
    date = _present(parts["release_date"])
    return [
        p["id"].alias("tmdb_id"),
        F.lit(media).alias("media_type"),
        F.coalesce(_present(p["external_ids"]["imdb_id"]), parts["imdb_id"]).alias("imdb_id"),
        _text(parts["title"]).alias("title"),
        _text(parts["original_title"]).alias("original_title"),
        _present(p["original_language"]).alias("original_language"),
        date.alias("release_date"),
        release_year(date).alias("year"),
        parts["runtime"].alias("runtime"),
        _present(p["status"]).alias("status"),
        F.coalesce(p["adult"], F.lit(False)).alias("adult"),
        _text(p["overview"]).alias("overview"),
        _text(p["tagline"]).alias("tagline"),
        _list(p["genres"], "name", "string").alias("genres"),
        _list(parts["keywords"], "name", "string").alias("keywords"),
        _list(p["production_countries"], "iso_3166_1", "string").alias("production_countries"),
        _list(p["spoken_languages"], "iso_639_1", "string").alias("spoken_languages"),
        p["vote_average"].alias("vote_average"),
        p["vote_count"].alias("vote_count"),
        p["popularity"].alias("popularity"),
        parts["budget"].alias("budget"),
        parts["revenue"].alias("revenue"),
        parts["collection_id"].alias("collection_id"),
        parts["collection_name"].alias("collection_name"),
        _list(parts["directors"], "id", "long").alias("director_ids"),
        _list(parts["directors"], "name", "string").alias("directors"),
        _list(parts["writers"], "id", "long").alias("writer_ids"),
        _list(parts["writers"], "name", "string").alias("writers"),
        _list(_billed(parts["cast"]), "id", "long").alias("cast_ids"),
        _list(_billed(parts["cast"]), "name", "string").alias("cast"),
    ]


def normalize_movies(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Film payload texts in the film schema."""
    parsed = payloads.select(F.from_json(column, MOVIE_SCHEMA).alias("p"))
    p = F.col("p")
    crew = p["credits"]["crew"]
    writes = lambda x: F.coalesce(
        x["job"].isin(*WRITING_JOBS) | (x["department"] == "Writing"), F.lit(False)
    )
    parts = {
        "imdb_id": _present(p["imdb_id"]),
        "title": p["title"],
        "original_title": p["original_title"],
        "release_date": p["release_date"],
        "runtime": p["runtime"],
        "keywords": p["keywords"]["keywords"],
        "budget": p["budget"],
        "revenue": p["revenue"],
        "collection_id": p["belongs_to_collection"]["id"],
        "collection_name": p["belongs_to_collection"]["name"],
        "directors": F.filter(crew, lambda x: F.coalesce(x["job"] == "Director", F.lit(False))),
        "writers": F.filter(crew, writes),
        "cast": p["credits"]["cast"],
    }
    return parsed.select(*_flat(p, "movie", parts))


def normalize_series(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Series payload texts in the film schema; creators count as directors."""
    parsed = payloads.select(F.from_json(column, SERIES_SCHEMA).alias("p"))
    p = F.col("p")
    nothing = F.lit(None)
    parts = {
        "imdb_id": nothing.cast("string"),
        "title": p["name"],
        "original_title": p["original_name"],
        "release_date": p["first_air_date"],
        "runtime": F.try_element_at(p["episode_run_time"], F.lit(1)),
        "keywords": p["keywords"]["results"],
        "budget": nothing.cast("long"),
        "revenue": nothing.cast("long"),
        "collection_id": nothing.cast("long"),
        "collection_name": nothing.cast("string"),
        "directors": p["created_by"],
        "writers": F.array().cast(_NAMED),
        "cast": p["aggregate_credits"]["cast"],
    }
    return parsed.select(*_flat(p, "tv", parts))
