import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenreel.operators import ordering, quantiles, reports


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    # user 0 owns most rows, and one value is most of theirs
    user = np.where(rng.random(3000) < 0.7, 0, rng.integers(1, 6, 3000))
    value = np.where(rng.random(3000) < 0.5, 2.5, np.round(rng.random(3000) * 5, 2))
    return pd.DataFrame({"user": user, "item": np.arange(3000), "value": value, "other": np.round(rng.random(3000) * 5, 1)})


def test_average_rank_is_exact_in_hot_groups(spark, rows):
    frame = spark.createDataFrame(rows)
    got = ordering.average_rank(frame, ["user"], "value", "rank", ordering.score_ranges(F.col("value"), 0, 5, 16)).toPandas()
    rows = rows.assign(want=rows.groupby("user")["value"].rank())
    merged = got.merge(rows, on="item")
    assert len(merged) == 3000 and (merged["rank"] == merged["want"]).all()


def test_ordinal_rank_is_a_permutation_in_order(spark, rows):
    frame = spark.createDataFrame(rows)
    got = ordering.ordinal_rank(
        frame, ["user"], -F.col("value"), ordering.hash_key(F.col("item"), 0), "r",
        ordering.score_ranges(F.col("_value"), -5, 0, 16),
    ).toPandas()
    for _, part in got.groupby("user"):
        part = part.sort_values("r")
        assert part["r"].tolist() == list(range(1, len(part) + 1))
        assert (part["value"].diff().dropna() <= 0).all()


def test_hash_rank_and_samples_are_exact(spark):
    ids = spark.range(1000).withColumnRenamed("id", "userId")
    ranks = ordering.hash_rank(ids, ordering.hash_key(F.col("userId"), 0), "r", total="n").toPandas()
    assert sorted(ranks["r"]) == list(range(1, 1001)) and set(ranks["n"]) == {1000}
    sample = ordering.sample_share(ids, ordering.hash_key(F.col("userId"), 0), 0.2)
    assert sample.count() == 200
    other = ordering.sample_share(ids, ordering.hash_key(F.col("userId"), 1), 0.2)
    assert set(r[0] for r in sample.collect()) != set(r[0] for r in other.collect())


def test_spearman_matches_pandas_and_is_null_without_spread(spark, rows):
    flat = pd.DataFrame({"user": [9] * 5 + [8] * 2, "item": range(7), "value": [1.0] * 5 + [1.0, 2.0], "other": [1.0, 2, 3, 4, 5, 1, 2]})
    everything = pd.concat([rows, flat])
    got = reports.spearman(
        spark.createDataFrame(everything), ["user"], "value", "other",
        left_spread=reports.star_ranges(F.col("value")), right_spread=reports.star_ranges(F.col("other")),
    ).toPandas().set_index("user")["spearman"]
    for user, part in rows.groupby("user"):
        want = part["value"].rank().corr(part["other"].rank())
        assert abs(got[user] - want) < 1e-9
    assert np.isnan(got[9]) and np.isnan(got[8])


@pytest.mark.parametrize("n", [7, 20, 101])
def test_rank_first_deciles_match_equal_cuts(spark, n):
    votes = np.random.default_rng(n).integers(0, 5, n)
    films = spark.createDataFrame(pd.DataFrame({"vote_count": votes}))
    got = quantiles.rank_first_deciles(films).toPandas()
    series = pd.Series(votes)
    labels = pd.qcut(series.rank(method="first"), 10, labels=range(1, 11))
    want = series.groupby(labels, observed=True).agg(["size", "min", "max"])
    assert got["decile"].tolist() == list(want.index)
    assert got[["films", "votes_min", "votes_max"]].to_numpy().tolist() == want.to_numpy().tolist()


def test_profile_deciles_are_cut_against_the_catalogue(spark):
    catalogue = spark.range(1000).select(F.col("id").alias("vote_count"))
    rated = spark.createDataFrame([(3.0, v) for v in (1, 2, 3, 4, 5)], "rating double, vote_count long")
    rows = reports.profile_deciles(rated, catalogue).collect()
    assert [(r["decile"], r["films"]) for r in rows] == [(1, 5)]
    tail = {r["under_votes"]: r["films"] for r in reports.tail_share(
        spark.createDataFrame([(3.0, v) for v in (50, 600, 2000, 20_000)], "rating double, vote_count long")).collect()}
    assert tail == {100: 1, 500: 1, 1000: 2, 5000: 3}


def test_first_and_top_rows(spark):
    frame = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, o int, v string")
    first = ordering.first_per_key(frame, ["k"], [F.col("o")])
    assert sorted(map(tuple, first.collect())) == [("a", 1, "y"), ("b", 3, "z")]
    last = ordering.last_per_key(frame, ["k"], [F.col("o")])
    assert sorted(map(tuple, last.collect())) == [("a", 2, "x"), ("b", 3, "z")]
    plan = ordering.top_per_group(frame, ["k"], [F.col("o")], 1)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # groups are pruned before the shuffle
