"""Similar titles by index against all pairs, and the tiers that follow from them."""

import random

import pytest
from pyspark.sql import functions as F

from evenreel.functions.text import indel_ratio
from evenreel.operators import resolution, retrieval

TEXTS = "way string, text string, year int"
FILMS = "film_key string, title string, year int"
CATALOGUE = "tmdb_id long, title string, original_title string, year int, popularity double, media_type string"


def garbled(rng, text):
    letters = list(text)
    for _ in range(rng.randint(0, 4)):
        place = rng.randrange(len(letters) + 1)
        if rng.random() < 0.5 and letters:
            letters.pop(min(place, len(letters) - 1))
        else:
            letters.insert(place, rng.choice("abc é"))
    return "".join(letters)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 34))) for _ in range(60)]
    draw = lambda: {
        (rng.choice(["written", "sorted"]), text, 1990 + rng.randint(0, 9))
        for stem in stems for _ in range(5) if (text := garbled(rng, stem))
    }
    return draw(), draw()


@pytest.mark.parametrize("crowd", [0, 3, retrieval.CROWD])
def test_no_similar_text_is_missed(spark, texts, crowd):
    asked, indexed = texts
    expected = {
        (*a, b[1], b[2]): indel_ratio(a[1], b[1])
        for a in asked for b in indexed
        if a[0] == b[0] and abs(a[2] - b[2]) <= 2 and indel_ratio(a[1], b[1]) >= 85
    }
    found = retrieval.similar_texts(
        spark.createDataFrame(sorted(asked), TEXTS), spark.createDataFrame(sorted(indexed), TEXTS), crowd=crowd
    ).collect()
    got = {(r["way"], r["text"], r["year"], r["found"], r["found_year"]): r["score"] for r in found}
    assert len(found) == len(got)
    assert got == pytest.approx(expected)
    assert sum(score < 100 for score in expected.values()) > 100


def test_few_pairs_are_compared(spark):
    """Unlike titles share no piece: the comparisons are far fewer than all pairs."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    titles = [("written", f"{word()} {word()} {word()}", 2000) for _ in range(300)]
    rows = spark.createDataFrame(titles, TEXTS)
    met = retrieval._meet(
        retrieval._asked_pieces(retrieval._asked(rows)), retrieval._indexed_pieces(retrieval._indexed(rows))
    )
    assert 300 <= met.count() < 300 * 300 / 20


def test_a_text_is_cut_once_per_block_of_years_and_by_many_tasks(spark, monkeypatch):
    texts = lambda years: spark.createDataFrame([("written", "night ferry", 1990 + y) for y in range(years)], TEXTS)
    assert retrieval._indexed(texts(5)).count() == retrieval._indexed(texts(1)).count()
    assert retrieval._asked(texts(5)).count() == 3 * retrieval._asked(texts(5)).where("block = 398").count()
    monkeypatch.setattr(retrieval, "CELLS_PER_TASK", 2)
    many = spark.createDataFrame([("written", f"night ferry {i}", 1990) for i in range(40)], TEXTS)
    assert retrieval._indexed(many).rdd.getNumPartitions() == 20


def test_years_are_met_to_the_year(spark):
    asked = spark.createDataFrame([("written", "night ferry", y) for y in (1990, 1994)], TEXTS)
    indexed = spark.createDataFrame([("written", "nightferry", y) for y in range(1985, 2000)], TEXTS)
    found = retrieval.similar_texts(asked, indexed).collect()
    assert sorted((r["year"], r["found_year"]) for r in found) == [(y, y + d) for y in (1990, 1994) for d in range(-2, 3)]
    assert {round(r["score"], 6) for r in found} == {round(indel_ratio("night ferry", "nightferry"), 6)}


def all_pairs(spark, films, catalogue):
    """Every film with every record, scored by the operator for given candidates."""
    records = catalogue.select(
        F.col("tmdb_id").alias("id"), F.col("title").alias("candidate_title"),
        F.col("original_title").alias("candidate_original"), F.col("year").cast("string").alias("release_date"),
        "popularity", "media_type",
    )
    return resolution.resolve_candidates(films.join(records, F.lit(True)))


@pytest.mark.parametrize("crowd", [1, retrieval.CROWD])
def test_catalogue_wide_tiers_equal_all_pairs(spark, crowd):
    rng = random.Random(7)
    words = "the night ferry harbour watch copper bell glenmoor potter tallow été ii 3 of".split()
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
    records = [
        (i, title().title(), rng.choice([None, "", title()]), rng.choice([None, 1980, 1981, 1983, 1984]),
         rng.choice([None, 1.0, 2.0]), rng.choice(["movie", "movie", "tv"]))
        for i in range(150)
    ]
    asked = [
        (f"f{i}", rng.choice([garbled(rng, rng.choice(records)[1]), title(), "", None]),
         rng.choice([None, 1980, 1981, 1982, 1983]))
        for i in range(120)
    ]
    films, catalogue = spark.createDataFrame(asked, FILMS), spark.createDataFrame(records, CATALOGUE)
    expected = sorted(map(tuple, all_pairs(spark, films, catalogue).collect()))
    matches = retrieval.resolve_catalogue(films, catalogue, crowd=crowd)
    assert sorted(map(tuple, matches.select("film_key", "tmdb_id", "media_type", "tmdb_title", "tmdb_year", "confidence",
                                            "title_score", "year_delta").collect())) == expected
    assert {row[5] for row in expected} == {"exact", "high", "medium"}


def test_fuzzy_matches_reach_the_film_map_and_its_review(spark):
    films = spark.createDataFrame(
        [("a", "Potter of Glenmoor", 2000), ("b", "Potter of Glenmor", 2002), ("c", "Tallow", 1996), ("d", "Nothing Like It", 1996),
         ("e", "Tallow", 1996)], FILMS)
    catalogue = spark.createDataFrame(
        [(1, "Potters of Glenmoor", None, 2000, 1.0, "movie"), (2, "Tallow", "Talg", 1996, 1.0, "movie")], CATALOGUE)
    fixed = spark.createDataFrame([("e", 9, "tv")], "film_key string, tmdb_id long, media_type string")
    film_map = resolution.resolve_batch(films, fixed, retrieval.resolve_catalogue(films, catalogue))
    got = {r["film_key"]: (r["tmdb_id"], r["confidence"], r["tmdb_title"], r["tmdb_year"], r["year_delta"]) for r in film_map.collect()}
    assert got == {
        "a": (1, "high", "Potters of Glenmoor", 2000, 0), "b": (1, "medium", "Potters of Glenmoor", 2000, 2),
        "c": (2, "exact", "Tallow", 1996, 0), "d": (None, "unresolved", "", None, None),
        "e": (9, "override", "", None, None),
    }
    assert {r["film_key"] for r in resolution.pending_review(film_map).collect()} == {"b", "d"}


def test_empty_tables(spark):
    no_films, no_records = spark.createDataFrame([], FILMS), spark.createDataFrame([], CATALOGUE)
    one = spark.createDataFrame([("a", "A", 2000)], FILMS)
    assert retrieval.resolve_catalogue(no_films, no_records).count() == 0
    assert retrieval.resolve_catalogue(one, no_records).count() == 0
