import pytest

from evenreel.operators import archive, crowd
from evenreel.sources import dumps

RATING = "member string, slug string, rating int"
FILM = "slug string, tmdb_id long, title string, year int"
CATALOGUE = "tmdb_id long, title string, original_title string, year int"


def test_null_and_nan_are_slugs_and_names_are_casefolded(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    path.write_text("user_name,film_id,rating\n Bob ,null,0.5\nbob,nan,5.0\nAnn,NULL,2.5\n")
    rows = dumps.read_crowd_ratings(
        spark, f"file://{path}", member="user_name", slug="film_id", rating="rating", doubled=True
    )
    assert sorted(map(tuple, rows.collect())) == [("ann", "NULL", 5), ("bob", "nan", 10), ("bob", "null", 1)]


def test_ragged_rows_are_skipped_and_counted(spark, tmp_path):
    path = tmp_path / "films.csv"
    path.write_text('slug,id,title,year\na,1,"A, film",1999\nb,2\na,9,Again,2000\nc,,No link,nan\n')
    table = dumps.read_ragged(spark, f"file://{path}", ["slug", "id", "title", "year"])
    assert {r["part"]: r["n"] for r in dumps.scan_counts(table).collect()} == {"intact": 3, "skipped": 1}
    films = dumps.dump_films(dumps.intact(table), slug="slug", title="title", year="year", tmdb_id="id")
    assert sorted(map(tuple, films.select("slug", "tmdb_id", "title", "year").collect())) == [
        ("a", 1, "A, film", 1999), ("c", None, "No link", None),
    ]


def snapshot(spark):
    old = spark.createDataFrame([("ann", "a", 1), ("ann", "b", 2), ("bob", "a", 3)], RATING)
    new = spark.createDataFrame([("ann", "a", 9)], RATING)
    from pyspark.sql import functions as F

    return crowd.stack_in_order([old.withColumn("dump", F.lit("old")), new.withColumn("dump", F.lit("new"))])


def test_newer_snapshot_replaces_the_older_one_wholesale(spark):
    rows = crowd.latest_snapshot(snapshot(spark))
    assert sorted((r["member"], r["slug"], r["rating"]) for r in rows.collect()) == [("ann", "a", 9), ("bob", "a", 3)]
    counts = {r["dump"]: r["superseded"] for r in crowd.superseded_members(snapshot(spark)).collect()}
    assert counts == {"old": 1, "new": 0}


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame(
        [
            (1, "Parasite", "기생충", 2019), (2, "Parasite", "Parasite", 1982), (3, "Parasite", None, 1983),
            (4, "The Education", None, 2020), (5, "Twin", None, 2000), (6, "Twin", None, 2000),
            (7, "Near", None, 2001), (8, "Near", None, 1999), (9, "Same", "Same", 1990),
        ],
        CATALOGUE,
    )


def test_title_year_matching(spark, catalogue):
    slugs = [
        ("exact", "Parasite", 2019), ("prefers-exact", "Parasite", 1982), ("no-article", "Education", 2020),
        ("twins", "Twin", 2000), ("between", "Near", 2000), ("far", "Parasite", 1990), ("no-year", "Parasite", None),
        ("blank", "", 2019), ("both-titles", "same!", 1991),
    ]
    got = crowd.match_by_title_year(spark.createDataFrame(slugs, "slug string, title string, year int"), catalogue)
    assert {r["slug"]: (r["tmdb_id"], r["how"]) for r in got.collect()} == {
        "exact": (1, "title_year"), "prefers-exact": (2, "title_year"), "no-article": (None, "unmatched"),
        "twins": (None, "ambiguous"), "between": (None, "ambiguous"), "far": (None, "unmatched"),
        "no-year": (None, "unmatched"), "blank": (None, "unmatched"), "both-titles": (9, "title_year"),
    }


def test_slug_map_prefers_live_links(spark, catalogue):
    old = spark.createDataFrame(
        [("own", 77, "Parasite", 2019), ("dead", 88, "Parasite", 2019), ("gone", 88, "Nothing", 2019),
         ("video", 99, "Parasite", 2019)], FILM)
    new = spark.createDataFrame([("own", None, "Retitled", 2018), ("fresh", None, "Parasite", 2019)], FILM)
    live = spark.createDataFrame([(77,), (99,), (1,)], "tmdb_id long")
    table = crowd.slug_map(crowd.stack_in_order([old, new]), catalogue, live)
    assert {r["slug"]: (r["title"], r["tmdb_id"], r["how"]) for r in table.collect()} == {
        "own": ("Retitled", 77, "linked"), "dead": ("Parasite", 1, "title_year"), "gone": ("Nothing", None, "dead link"),
        "video": ("Parasite", 99, "linked"), "fresh": ("Parasite", 1, "title_year"),
    }


def test_two_slugs_of_one_film_are_one_rater(spark):
    from pyspark.sql import functions as F

    ratings = spark.createDataFrame(
        [("ann", "a", 7), ("ann", "b", 8), ("bob", "a", 3), ("bob", "x", 1), ("eve", "a", 6), ("eve", "b", 7)], RATING
    ).withColumn("dump", F.lit("d")).withColumn("seq", F.lit(0))
    slugs = spark.createDataFrame([("a", 1), ("b", 1), ("x", None)], "slug string, tmdb_id long")
    rows = crowd.ratings_by_film(ratings, slugs)
    # 7.5 and 6.5 round to the even neighbour
    assert sorted((r["member"], r["rating"]) for r in rows.collect()) == [("ann", 8), ("bob", 3), ("eve", 6)]
    films = spark.createDataFrame([(1, 5, 2000)], "tmdb_id long, vote_count long, year int")
    assert crowd.pool(rows, films, min_raters=3).first()["raters"] == 3
    assert crowd.pool(rows, films, min_raters=4).count() == 0
    model = crowd.as_model_ratings(rows)
    assert sorted(r["userId"] for r in model.collect()) == [0, 1, 2]
    assert sorted(r["rating"] for r in model.collect()) == [1.5, 3.0, 4.0]
    report = crowd.mapping_report(ratings, slugs.withColumn("how", F.lit("linked")).where("slug <> 'x'"), min_raters=3)
    assert {r["how"]: (r["slugs"], r["ratings"], r["pool_sized"]) for r in report.collect()} == {
        "linked": (2, 5, 1), "no film record": (1, 1, 0),
    }


def test_pool_reports(spark):
    pool = spark.createDataFrame([(1,), (2,), (3,)], "tmdb_id long")
    films = spark.createDataFrame(
        [(1, 0, 2000), (2, 10, 2000), (3, 500, 2002), (4, 9, 2002)], "tmdb_id long, vote_count long, year int"
    )
    known = spark.createDataFrame([(3,)], "tmdb_id long")
    row = crowd.pool_summary(pool, films, known).first()
    assert (row["films"], row["median_votes"], row["zero_votes"]) == (3, 10.0, 1)
    assert abs(row["cold_share"] - 2 / 3) < 1e-12 and not row["validated"]
    years = {r["year"]: (r["catalogue"], r["pool"], r["share"]) for r in crowd.pool_by_year(pool, films, 2000, 2002).collect()}
    assert years == {2000: (2, 2, 1.0), 2001: (0, 0, None), 2002: (2, 1, 0.5)}


def test_bridge_never_fans_out(spark):
    links = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, None), (4, 40.0)], "movieId int, tmdbId double")
    assert sorted(map(tuple, archive.bridge(links).select("movieId", "tmdbId").collect())) == [(1, 10), (4, 40)]
    values = spark.createDataFrame([(10, 0.5), (40, 0.7), (99, 0.9)], "tmdb_id long, bias double")
    there = archive.by_movie_id(values, links)
    back = archive.by_tmdb_id(there, links)
    assert sorted(map(tuple, back.select("tmdb_id", "bias").collect())) == [(10, 0.5), (40, 0.7)]
    rated = archive.rated_ids(links, spark.createDataFrame([(4,)], "movieId int"))
    assert [r[0] for r in rated.collect()] == [40]  # linked but unrated stays cold
