"""Quoted files cut in many byte ranges against Python's csv reader."""

import csv
import random

import pytest

from evenreel.sources import dumps
from evenreel.sources.files import quoted_records

COLUMNS = ["slug", "id", "title", "year"]


def row(rng, i):
    text = lambda: "".join(rng.choice(['a', 'é', ',', '"', '\n', ' ', 'b', '","']) for _ in range(rng.randint(0, 9)))
    cells = [f"s{i}", str(rng.randint(0, 99)), "x" + text(), "1999", "extra"]
    return cells[: rng.choice([4, 4, 4, 4, 2, 3, 5])]


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    yield lambda size: (spark.conf.set(names[0], str(size)), spark.conf.set(names[1], "1"))
    for name, value in zip(names, before):
        spark.conf.set(name, value)


@pytest.mark.parametrize("size", [17, 64, 1000, 1_000_000])
def test_rows_do_not_depend_on_the_byte_ranges(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    expected = []
    for name in ("one", "two"):
        rows = [row(rng, i) for i in range(60)]
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as file:
            file.write("﻿" if name == "two" else "")
            writer = csv.writer(file, lineterminator="\n", quoting=csv.QUOTE_MINIMAL)
            writer.writerow(COLUMNS)
            for cells in rows:
                writer.writerow(cells)
                file.write("\n" if rng.random() < 0.1 else "")  # an empty line between records
        expected += rows
    small_ranges(size)
    table = dumps.read_ragged(spark, f"file://{tmp_path}", COLUMNS)
    if size < 1000:
        assert spark.read.text(f"file://{tmp_path}").rdd.getNumPartitions() > 4
    found = table.orderBy("_place").collect()
    whole = [tuple(r[c] for c in COLUMNS) for r in found if r["_corrupt"] is None]
    assert whole == [tuple(cells) for cells in expected if len(cells) == 4]
    counts = {r["part"]: r["n"] for r in dumps.scan_counts(table).collect()}
    assert counts == {"intact": len(whole), "skipped": len(expected) - len(whole)}


def test_the_first_row_of_a_slug_wins_across_ranges(spark, tmp_path, small_ranges):
    rows = [f's{i % 7},{i},"title\nof {i}",1999' for i in range(70)]
    (tmp_path / "films.csv").write_text("\n".join(["slug,id,title,year", *rows]) + "\n")
    small_ranges(50)
    table = dumps.intact(dumps.read_ragged(spark, f"file://{tmp_path}/films.csv", COLUMNS))
    films = dumps.dump_films(table.repartition(5), slug="slug", title="title", year="year", tmdb_id="id")
    assert sorted((r["slug"], r["tmdb_id"]) for r in films.collect()) == [(f"s{i}", i) for i in range(7)]


def test_quotes_inside_unquoted_fields_and_an_open_end(spark, tmp_path):
    (tmp_path / "a.txt").write_text('a,5" disc,b\nc,"open\nto the, end\n')
    (tmp_path / "empty.txt").write_text("")
    records = quoted_records(spark.read.text(f"file://{tmp_path}"))
    assert [r["record"] for r in records.orderBy("_place").collect()] == ['a,5" disc,b', 'c,"open\nto the, end']
