"""Tables written by tasks whose size does not depend on the input's."""

import math

import __spark_entry__
import pytest

from evenreel import session

SETTINGS = (session.PIECES, session.PIECE_SIZE, session.SPLIT_SIZE)


def settings(spark):
    return [spark.conf.get(key, None) for key in SETTINGS]


def test_pieces_grow_with_the_rows_and_settings_come_back(spark):
    before = settings(spark)
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (0, session.ROWS_PER_PIECE, 40 * session.ROWS_PER_PIECE + 1):
        with session.sized_shuffles(spark, rows):
            pieces = spark.range(10).selectExpr("id % 3 as id").groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
            assert int(spark.conf.get(session.PIECES)) == max(own, math.ceil(rows / session.ROWS_PER_PIECE))
            assert "hashpartitioning(id#" in pieces and f", {max(own, math.ceil(rows / session.ROWS_PER_PIECE))})" in pieces
        assert settings(spark) == before
    with pytest.raises(ValueError), session.sized_shuffles(spark, 1):
        raise ValueError
    assert settings(spark) == before


@pytest.mark.parametrize("name", ["ratings_by_film", "pool", "rated_elsewhere", "pool_summary", "pool_by_year"])
def test_rating_reports_are_written_in_pieces_by_their_rows(spark, tmp_path, monkeypatch, name):
    source = "/root/testdata/sf0.001"
    seen = []
    sized = session.sized_shuffles

    def noted(spark, rows):
        seen.append(rows)
        return sized(spark, rows)

    monkeypatch.setattr("evenreel.plans.tables_queries.sized_shuffles", noted)
    __spark_entry__.queries()[name](spark, source)
    assert seen == [spark.read.parquet(f"{source}/lineitem.parquet").count()]
