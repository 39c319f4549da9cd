"""Film status kept by batches, and a store with torn files."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from evenreel.operators import interactions as inter
from evenreel.plans.tables_queries import tear_files
from evenreel.sources import store
from evenreel.sources.files import folder_names
from evenreel.streaming import status

KEYS = ["user_id", "film_key"]
SCHEMA = (
    "user_id long, film_key string, title string, year int, kind string, value double, event_date timestamp, "
    "watched_date timestamp, deleted boolean"
)


def said(rng, n):
    day = lambda: datetime.datetime(2020, 1, 1) + datetime.timedelta(days=rng.randrange(9))
    kinds = [inter.RATING, inter.WATCHED, inter.WATCHLIST, inter.LIKE, inter.DIARY]
    return [
        (rng.randrange(3), f"f{rng.randrange(12)}", rng.choice(["One", "one", "Two", None]), rng.choice([1990, 1991, None]), rng.choice(kinds),
         rng.choice([None, 1.0, 2.5, 5.0]), day(), rng.choice([None, day()]), False)
        for _ in range(n)
    ]


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_batches_give_the_status_of_all_rows(spark, tmp_path):
    rng, state, everything = random.Random(1), str(tmp_path / "state"), []
    for number in range(7):
        rows = said(rng, 40)
        everything += rows
        batch = spark.createDataFrame(rows, SCHEMA)
        for _ in range(1 + number % 2):  # every other batch comes twice
            status.fold_batch(batch, number, state, KEYS, compact_every=2)
        assert len(folder_names(spark, state)) <= 3  # the state doesn't grow with the batches
    want = inter.film_status(spark.createDataFrame(everything, SCHEMA), KEYS)
    got = status.status_from_state(spark, state, KEYS)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    status.fold_batch(spark.createDataFrame(said(rng, 40), SCHEMA), 3, state, KEYS)  # merged long ago
    assert rows_of(status.status_from_state(spark, state, KEYS)) == rows_of(want)


def test_an_unfinished_merge_is_not_read(spark, tmp_path):
    state = str(tmp_path / "state")
    batch = spark.createDataFrame(said(random.Random(2), 30), SCHEMA)
    status.fold_batch(batch, 0, state, KEYS)
    before = rows_of(status.status_from_state(spark, state, KEYS))
    status.batch_flags(batch.limit(1), KEYS).write.parquet(f"{state}/upto=0/flags")  # broke off here
    assert rows_of(status.status_from_state(spark, state, KEYS)) == before
    with pytest.raises(ValueError):
        status.status_from_state(spark, str(tmp_path / "nothing"), KEYS)


def test_torn_files_are_pending_again(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "tmdb_id long, title string"
    films = spark.range(40).select(F.col("id").alias("tmdb_id"), F.concat(F.lit("Film "), F.col("id").cast("string")).alias("title"))
    for part in range(4):
        films.where(F.col("tmdb_id") % 4 == part).coalesce(1).write.parquet(f"{path}/part={part}")
    manifest = store.store_manifest(spark, path, schema)
    manifest.write.parquet(str(tmp_path / "manifest"))
    manifest = spark.read.parquet(str(tmp_path / "manifest"))
    assert store.damaged_files(spark, path, schema, manifest).count() == 0
    tear_files(spark, f"{path}/part=1/*.parquet")
    assert store.damaged_files(spark, path, schema, manifest).count() == 1
    healthy = store.load_healthy(spark, path, schema, manifest)
    left = {r["tmdb_id"] for r in store.pending_ids(films.select("tmdb_id"), healthy).collect()}
    assert left == set(range(1, 40, 4)) and healthy.count() == 30
