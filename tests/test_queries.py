"""A cross-section of the registered queries beside their SQL, on the smallest data."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the bundled tables")

SAMPLE = (
    "model_bias", "slug_map", "ratings_by_film", "film_status", "profile_deciles", "rec_stratified",
    "interactions", "dump_catalogue", "stream_ingest", "stream_coverage", "bias_borrowed", "frontier", "normalize_movie",
)


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from read_parquet('{FOLDER}/{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, con, name):
    frame = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[name])
    expected = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert rows(frame.columns, frame.collect()) == expected
    assert expected[1]


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 140


@pytest.mark.parametrize("name", ["tfidf_block_whole", "tfidf_vocabulary_whole"])
def test_whole_vocabulary_matches_its_sql(spark, con, name):
    frame = entry.queries()[name](spark, FOLDER)
    cursor = con.execute(entry.oracle_sql()[name])
    expected = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert rows(frame.columns, frame.collect()) == expected
    seen = con.execute(
        """select count(*) from (select term from (select doc_id, unnest(regexp_extract_all(lower(text), '[^ ]+')) as term
           from documents) group by 1 having count(distinct doc_id) >= 2)"""
    ).fetchone()[0]
    assert seen > 5000 and (name == "tfidf_block_whole" or len(expected[1]) == seen)


def test_boosted_trees_run_at_the_operators_default(monkeypatch):
    from evenreel.operators import personal
    from evenreel.plans import analytics_queries

    monkeypatch.setattr(analytics_queries, "_out_of_fold", lambda t, model: model)
    assert analytics_queries.model_gbt(None).settings == personal.GradientBoosted().settings
    assert personal.GradientBoosted().settings.trees == 400
