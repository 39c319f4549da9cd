"""The registered queries beside their SQL, and the pipeline beside brute force."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from evenreel.llm import decontamination, language, mixing, queries, simhash
from evenreel.llm.common import unpacked

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the bundled tables")


def test_all_are_registered():
    names = set(entry.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.split('.')[0]} as select * from read_parquet('{FOLDER}/{file}')")
    frame = queries.QUERIES[name](spark, FOLDER)
    cursor = con.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    want = Counter(tuple(r) for r in cursor.fetchall())
    assert Counter(tuple(r) for r in frame.select(*names).collect()) == want
    assert want and sorted(names) == sorted(frame.columns)


def test_documents_come_in_training_order(spark):
    rows = queries.op9_mixing(spark, FOLDER).collect()
    times = [r["position"] for r in rows]
    known = [t for t in times if t is not None]
    assert known == sorted(known) and all(t is None for t in times[len(known):])
    assert all((r["position"] is None) == (r["copies"] == 0) and (r["second_position"] is None) == (r["copies"] < 2) for r in rows)
    assert all(r["second_position"] > r["position"] for r in rows if r["copies"] == 2) and max(r["copies"] for r in rows) == 2


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = stages["language_id"](spark, docs, FOLDER)
    assert kept.columns == docs.columns
    known = {r["doc_id"] for r in kept.collect()}
    assert known <= {i for i, r in rows.items() if language.has_letter(r["text"])} and len(known) > 0.95 * len(rows)
    single = stages["simhash_near_dedup"](spark, docs, FOLDER)
    prints = {i: simhash.fingerprint(r["text"]) for i, r in rows.items()}
    near = {i: [j for j in rows if (prints[i] ^ prints[j]).bit_count() <= 3] for i in rows}
    least, before = {i: i for i in rows}, None
    while least != before:
        before, least = least, {i: min(least[j] for j in near[i]) for i in rows}
    assert {r["doc_id"] for r in single.collect()} == {i for i in rows if least[i] == i}
    clean = {r["doc_id"] for r in stages["benchmark_decontamination"](spark, docs, FOLDER).collect()}
    items = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    plain = [b" ".join(decontamination.words_of(t)) for t in items]
    assert clean == {
        i for i, r in rows.items() if not any(t in b" ".join(decontamination.words_of(r["text"])) for t in plain)
    }
    mixed = stages["source_mixing"](spark, docs, FOLDER)
    assert mixed.columns == docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert max(copies.values()) <= 2 and all(rows[i]["text"] for i in copies)
    result = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["shard"] for r in result} <= set(range(corpus_pipeline.N_SHARDS))
    assert {r["doc_id"] for r in result} <= known & clean


def test_stages_stand_odd_tables(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, `_doc` int, `_metadata` int, `_row` int, `x``y` int"
    long = " ".join(f"wort{i}" for i in range(30_000))
    texts = [None, "", " \n", "² ½ ①", "the same text here", "the same text here", "et la même chose", long, long + " ende", "12"]
    rows = [(i if i % 4 else None, t, "en" if i % 2 else None, None if i % 3 else "s", 1, 1, 2, 3, 4, 5) for i, t in enumerate(texts * 2)]
    for n, table in enumerate((rows, [])):
        docs = spark.createDataFrame(table, names)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs.write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = stage(spark, spark.read.parquet(str(tmp_path / f"{n}-{k}")), FOLDER)
            if name != "sharding":
                assert docs.schema.names == spark.createDataFrame([], names).columns
        out = docs.collect()
        kept = spark.read.parquet(str(tmp_path / f"{n}-2")).collect()
        assert bool(out) == bool(table)
        assert {r["text"] for r in kept} <= set(texts[4:9])  # no text without a letter
        assert len({r["text"] for r in kept}) == len(kept)


def test_slots_follow_the_training_order(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    shards = {}
    for name, schedules in (("as registered", mixing.SCHEDULES), ("reversed", mixing.SCHEDULES[::-1])):
        order = mixing.curriculum(mixing.mix(docs, carry=True, schedules=schedules), 7)
        want = [r["doc_id"] for r in order.orderBy("position", "source", "doc_id").collect()]
        unpacked(order, "_doc", docs.columns).write.parquet(str(tmp_path / name))
        rows = corpus_pipeline.deal_shards(spark, spark.read.parquet(str(tmp_path / name)), FOLDER).collect()
        shard = {r["doc_id"]: r["shard"] for r in rows}
        got = {k: [r["doc_id"] for r in sorted(rows, key=lambda r: r["slot"]) if r["shard"] == k] for k in set(shard.values())}
        assert got == {k: [i for i in want if shard[i] == k] for k in got}
        assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(len(got[k]))) for k in got)
        shards[name] = got
    assert shards["as registered"] != shards["reversed"]
