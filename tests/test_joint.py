"""Models scored in one pass say what each says alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenreel.functions.numeric import clip_stars
from evenreel.operators import models, protocol
from evenreel.operators.joint import SharedTables
from evenreel.operators.ranking import comparable
from evenreel.session import written


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(11)
    rows = [
        (user, int(film), float(rng.integers(1, 11)) / 2)
        for user in range(40)
        for film in rng.choice(60, size=int(rng.integers(25, 50)), replace=False)
    ]
    return written(spark.createDataFrame(rows, "userId long, movieId long, rating double"), "ratings")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(12)
    # some films have no vector
    return spark.createDataFrame([(i, rng.normal(0, 1, 4).tolist()) for i in range(52)], "movieId long, vec array<double>")


def everyone(vectors, lent):
    tower = lambda **options: models.ContentTower(vectors, **options)
    predicted, borrowed = tower(item_bias="predicted"), tower(item_bias="borrowed", borrowed=lent)
    return [
        models.UserMean(), models.ItemMean(), models.BiasModel(), models.BiasModel(user_prior=10.0),
        models.BiasedMF(n_factors=4, min_item_ratings=3), tower(), tower(item_bias="none"), tower(bias_weight=0.5),
        predicted, borrowed, models.StratifiedRanker(predicted), models.StratifiedRanker(borrowed),
    ]


def test_one_pass_says_what_each_model_says_alone(spark, ratings, vectors):
    cold = written(protocol.cold_items(ratings, share=0.3), "cold")
    test = written(protocol.split_users(ratings, n_test_users=10, min_ratings=25), "test")
    train = written(protocol.train_ratings(ratings, test, cold), "train")
    lent = spark.createDataFrame([(i, i / 60 - 0.4) for i in range(45)], "movieId long, lent double")
    fitted = models.fit_all(everyone(vectors, lent), train)
    for together, alone in zip(fitted, everyone(vectors, lent)):
        if isinstance(alone, models.ContentTower):
            assert np.allclose(together.weights, alone.fit(train).weights)
    cases = written(protocol.cold_cases(ratings.join(test, "userId", "left_semi"), cold, (5, 10)), "cases")
    given, held = cases.where("given").drop("given"), cases.where("not given").drop("given")
    key = [*protocol.CASE, "movieId"]
    together = protocol.score_cases(fitted, cases).toPandas()
    assert len(together) == held.count() * len(fitted)
    for model in fitted:
        alone = model.score(given, held, list(protocol.CASE))
        predicted = clip_stars(F.col("score"))
        ranked = comparable(F.col("rank_score") if "rank_score" in alone.columns else predicted)
        alone = alone.select(*key, predicted.alias("p"), ranked.alias("r")).toPandas()
        both = together[together.model == model.name].merge(alone, on=key)
        assert len(both) == len(alone) == held.count()
        assert np.allclose(both.predicted, both.p) and np.allclose(both.ranked, both.r), model.name


def test_tables_that_models_share_are_joined_once(ratings, vectors):
    given = ratings.limit(40).withColumn("n_given", F.lit(5))
    towers = [models.ContentTower(vectors, bias_weight=w, learn_weights=False).fit(ratings) for w in (0.0, 0.5, 1.0)]
    shared = SharedTables(given, protocol.CASE)
    for model in (*towers, models.StratifiedRanker(towers[0]).fit(ratings), models.ItemMean().fit(ratings), models.BiasModel().fit(ratings)):
        shared.score(model)
    items, histories = (list(tables) for tables in shared._tables.values())
    # vectors, three towers' biases, one table of means; one profile, one user bias
    assert (len(items), len(histories)) == (5, 2)
    wide = shared.onto(given)
    assert wide.count() == 40 and len(set(wide.columns)) == len(wide.columns)


def test_a_model_without_a_joint_score_takes_part_beside_the_others(ratings):
    class Three:
        name = "three"

        def fit(self, ratings):
            return self

        def score(self, given, targets, by):
            return targets.withColumn("score", F.lit(3.0))

    test = protocol.split_users(ratings, n_test_users=6, min_ratings=25)
    got = protocol.evaluate_generalisation([models.ItemMean(), Three()], ratings, test, (5,)).collect()
    assert {(r["model"], r["n_given"]) for r in got} == {("item_mean", 5), ("three", 5)} and len(got) == 12
    cold = protocol.cold_items(ratings)
    nobody = protocol.evaluate_cold([models.UserMean(), Three()], ratings, test.limit(0), cold, (5,))
    assert nobody.count() == 0
