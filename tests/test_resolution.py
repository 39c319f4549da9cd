import json

import pytest
from pyspark.sql import functions as F

from evenreel.operators import resolution
from evenreel.sources import dumps, payloads, store

HIT = "film_key string, title string, year int, id long, candidate_title string, candidate_original string, release_date string, popularity double, media_type string"


def resolve(spark, title, year, hits):
    rows = [("k", title, year, i, t, o, d, p, m) for i, t, o, d, p, m in hits]
    return resolution.resolve_candidates(spark.createDataFrame(rows, HIT)).first()


@pytest.mark.parametrize(
    "title, year, hits, expected",
    [
        ("Marshland", 1979, [(1, "Marshland", "Болото", "1979-05-25", 1.0, "movie")], (1, "exact")),
        ("Marshland", 1979, [(1, "Marshland", "", "1980-01-01", 1.0, "movie")], (1, "exact")),
        ("Marshland", 1979, [(1, "Marshland", "", "1990-01-01", 9.0, "movie")], None),
        ("The Copper Bell", 1991, [(1, "Copper Bell", "", "1991-01-01", 1.0, "movie")], (1, "exact")),
        ("Harbour Watch II", 1994, [(1, "Harbour Watch III", "", "1994-01-01", 1.0, "movie")], None),
        ("Night Ferry", 2017, [(1, "Night Ferry 3000", "", "2017-01-01", 1.0, "movie")], None),
        ("Marshland", None, [(1, "Marshland", "", "1979-01-01", 1.0, "movie")], None),
        # popularity breaks ties only
        ("Meridian", 1972, [(1, "Meridian", "", "1972-01-01", 1.0, "movie"), (2, "Meridian", "", "1972-01-01", 5.0, "movie")], (2, "exact")),
        # a verbatim title outranks an article-stripped one, however famous
        ("Marshland", 1979, [(1, "The Marshland", "", "1979-01-01", 99.0, "movie"), (2, "Marshland", "", "1979-01-01", 1.0, "movie")], (2, "exact")),
        # a like-named series never displaces an exact film, but beats a weaker one
        ("Tallow", 1996, [(1, "Tallow", "", "1996-01-01", 1.0, "movie"), (2, "Tallow", "", "1996-01-01", 9.0, "tv")], (1, "exact")),
        ("Sevenfolds", 1989, [(1, "Sevenfoldses", "", "1991-01-01", 1.0, "movie"), (2, "Sevenfolds", "", "1989-01-01", 1.0, "tv")], (2, "exact")),
        ("Potter of Glenmoor", 2000, [(1, "Potters of Glenmoor", "", "2002-01-01", 1.0, "movie")], (1, "medium")),
        ("Potter of Glenmoor", 2000, [(1, "Potters of Glenmoor", "", "2001-01-01", 1.0, "movie")], (1, "high")),
    ],
)
def test_resolution_tiers(spark, title, year, hits, expected):
    row = resolve(spark, title, year, hits)
    assert (None if row is None else (row["tmdb_id"], row["confidence"])) == expected


def test_overrides_win_and_null_means_decided(spark):
    overrides = spark.createDataFrame(
        [("a", "1", "movie", 0), (" a ", "2", " TV", 1), ("b", "", "disc", 2), ("", "9", "", 3)],
        "film_key string, tmdb_id string, media_type string, seq int",
    )
    latest = resolution.latest_overrides(overrides)
    assert sorted(map(tuple, latest.collect()), key=str) == [("a", 2, "tv"), ("b", None, "movie")]
    films = spark.createDataFrame([("a", "A", 1), ("b", "B", 2), ("c", "C", 3), ("d", "D", 4)], "film_key string, title string, year int")
    matches = spark.createDataFrame(
        [("a", 7, "movie", "A", 1, "exact", 100.0, 0), ("c", 8, "movie", "C", 3, "medium", 86.0, 2)],
        "film_key string, tmdb_id long, media_type string, tmdb_title string, tmdb_year int, confidence string, title_score double, year_delta int",
    )
    film_map = resolution.resolve_batch(films, latest, matches)
    got = {r["film_key"]: (r["tmdb_id"], r["media_type"], r["confidence"], r["source"]) for r in film_map.collect()}
    assert got == {
        "a": (2, "tv", "override", "override"), "b": (None, None, "unresolved", "override"),
        "c": (8, "movie", "medium", "auto"), "d": (None, None, "unresolved", "auto"),
    }
    hits = spark.createDataFrame(
        [("c", i, 10 + i, f"Hit {i}", d) for i, d in enumerate(["1999-01-01", "", None, "2001-01-01"])],
        "film_key string, position int, id long, candidate_title string, release_date string",
    )
    table = {r["film_key"]: r for r in resolution.review_table(film_map, hits, url_base="https://x.example").collect()}
    assert set(table) == {"c", "d"}  # decided rows are not asked again
    assert table["c"]["auto_match"] == "8 | C (3) [medium, movie]"
    assert [table["c"][f"suggestion_{i}"] for i in (1, 2, 3)] == ["10 | Hit 0 (1999)", "11 | Hit 1 (????)", "12 | Hit 2 (????)"]
    assert table["d"]["suggestion_1"] == "" and table["d"]["tmdb_id"] == ""


def test_reviewed_rows_need_an_id_or_a_note(spark):
    review = spark.createDataFrame(
        [("a", "1", "tv", "A", ""), ("b", "", "", "B", "absent"), ("c", " ", None, "C", None), ("", "4", "", "", "x")],
        "film_key string, tmdb_id string, media_type string, title string, note string",
    )
    kept = resolution.reviewed_rows(review)
    assert [(r["film_key"], r["media_type"]) for r in kept.orderBy("film_key").collect()] == [("a", "tv"), ("b", "movie")]
    assert resolution.fresh_overrides(kept, spark.createDataFrame([("a",)], "film_key string")).count() == 1


def test_overrides_are_appended_once(spark, tmp_path):
    columns, path = "film_key string, tmdb_id string, media_type string", f"file://{tmp_path}/overrides"
    first = spark.createDataFrame([("a", "1", "movie"), ("b", "", "tv")], columns)
    assert store.append_overrides(first, path).count() == 2
    again = spark.createDataFrame([("a", "7", "movie"), ("c", "3", "tv")], columns)
    for _ in range(2):
        table = store.append_overrides(again, path)
    assert sorted(map(tuple, table.select("film_key", "tmdb_id", "seq").collect())) == [("a", "1", 0), ("b", "", 0), ("c", "3", 1)]
    assert store.append_overrides(again.where("false"), path).count() == 3


def test_movie_payload(spark):
    movie = {
        "id": 5, "title": "T", "original_title": "O", "release_date": "1999-03-01", "runtime": 100, "imdb_id": "tt0000005",
        "genres": [{"id": 1, "name": "Drama"}, {"id": 2, "name": ""}], "keywords": {"keywords": [{"id": 3, "name": "sea"}]},
        "production_countries": [{"iso_3166_1": "FR"}], "spoken_languages": [{"iso_639_1": "fr"}],
        "credits": {
            "cast": [{"id": 100 + i, "name": f"P{i}", "order": 14 - i} for i in range(15)],
            "crew": [{"id": 1, "name": "Dir", "job": "Director", "department": "Directing"},
                     {"id": 2, "name": "Wri", "job": "Novel", "department": "Crew"},
                     {"id": 3, "name": "Sta", "job": "Staff", "department": "Writing"}],
        },
    }
    row = payloads.normalize_movies(spark.createDataFrame([(json.dumps(movie),)], "payload string")).first()
    assert (row["tmdb_id"], row["imdb_id"], row["year"], row["genres"]) == (5, "tt0000005", 1999, ["Drama"])
    assert row["cast"] == [f"P{14 - i}" for i in range(10)] and row["cast_ids"][0] == 114
    assert row["directors"] == ["Dir"] and row["writers"] == ["Wri", "Sta"] and row["collection_id"] is None

    series = {"id": 6, "name": "S", "first_air_date": "", "episode_run_time": [], "created_by": [{"id": 9, "name": "Cre"}],
              "keywords": {"results": [{"id": 1, "name": "k"}]}, "external_ids": {"imdb_id": "tt6"}}
    tv = payloads.normalize_series(spark.createDataFrame([(json.dumps(series),)], "payload string")).first()
    assert (tv["media_type"], tv["year"], tv["runtime"], tv["budget"], tv["directors"], tv["keywords"], tv["imdb_id"]) == (
        "tv", None, None, None, ["Cre"], ["k"], "tt6")
    assert tv.asDict().keys() == row.asDict().keys()


def test_id_export_and_store(spark, tmp_path):
    path = tmp_path / "ids.json"
    path.write_text("\n".join(json.dumps(r) for r in [
        {"adult": False, "id": 1, "original_title": "A", "popularity": 1.0, "video": False},
        {"adult": False, "id": 2, "original_title": None, "popularity": 9.0, "video": False},
        {"adult": False, "id": 3, "popularity": 5.0, "video": True},
        {"adult": False, "id": 4, "original_title": "D"}]))
    raw = dumps.read_id_export(spark, f"file://{path}")
    assert [r["tmdb_id"] for r in dumps.most_popular_first(dumps.id_export(raw)).collect()] == [2, 1, 4]
    assert dumps.id_export(raw, include_video=True).count() == 4
    batches = spark.createDataFrame([(1, 0, "first"), (1, 1, "again"), (2, 1, "x")], "tmdb_id long, batch int, title string")
    assert sorted(map(tuple, store.load_store(batches).collect())) == [(1, "first"), (2, "x")]
    wanted = spark.createDataFrame([(1,), (5,)], "tmdb_id long")
    assert [r[0] for r in store.pending_ids(wanted, batches).collect()] == [5]
    out = f"file://{tmp_path}/result"
    store.write_result(batches, out, fmt="csv")
    assert spark.read.csv(out, header=True).count() == 3


def test_duplicates_and_counts(spark):
    film_map = spark.createDataFrame([("a", 1, "exact"), ("b", 1, "high"), ("c", 2, "exact"), ("d", None, "unresolved")],
                                     "film_key string, tmdb_id long, confidence string")
    assert [r["film_key"] for r in resolution.duplicate_ids(film_map).collect()] == ["a", "b"]
    assert [(r[0], r[1], r[2]) for r in resolution.confidence_counts(film_map).collect()][0] == ("exact", 2, 0.5)
    spaces = resolution.choose_namespace(
        spark.createDataFrame([("a", 1, "exact"), ("b", 2, "medium"), ("c", None, "unresolved")], "film_key string, tmdb_id long, confidence string"),
        spark.createDataFrame([("a", 9, "exact"), ("b", 8, "exact"), ("c", None, "unresolved")], "film_key string, tmdb_id long, confidence string"),
    )
    assert {r["film_key"]: (r["tmdb_id"], r["media_type"]) for r in spaces.collect()} == {"a": (1, "movie"), "b": (8, "tv"), "c": (None, None)}
    assert spaces.where(F.col("film_key") == "c").first()["confidence"] == "unresolved"
