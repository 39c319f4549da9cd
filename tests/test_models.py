import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evenreel import session
from evenreel.operators import crossval, features, linear, metadata, models, personal, protocol, ranking, reports, vectors
from evenreel.plans import analytics_queries


@pytest.fixture(scope="module")
def truth():
    """Ratings with item quality, generosity and one taste axis."""
    rng = np.random.default_rng(0)
    quality, axis = rng.normal(3.5, 0.6, 60), rng.normal(0, 1, 60)
    rows = []
    for user in range(50):
        taste, generous = rng.normal(), rng.normal(0, 0.3)
        for item in rng.choice(60, size=int(rng.integers(35, 55)), replace=False):
            score = quality[item] + generous + taste * axis[item] + rng.normal(0, 0.2)
            rows.append((user, int(item), float(np.clip(score, 0.5, 5.0))))
    frame = pd.DataFrame(rows, columns=["userId", "movieId", "rating"])
    side = rng.normal(0, 1, (60, 3))
    vec = np.column_stack([axis, side])
    return frame, vec


@pytest.fixture(scope="module")
def ratings(spark, truth):
    return spark.createDataFrame(truth[0]).cache()


@pytest.fixture(scope="module")
def vecs(spark, truth):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(truth[1]) if i < 50]
    return spark.createDataFrame(rows, "movieId long, vec array<double>").cache()


@pytest.fixture(scope="module")
def cases(ratings):
    table = protocol.history_cases(ratings, (10,)).cache()
    return table.where("given").drop("given"), table.where("not given").drop("given")


BY = ["n_given", "userId"]


def brute_bias(frame, prior=20.0):
    mu = frame.rating.mean()
    g = frame.groupby("movieId").rating.agg(["sum", "count"])
    return mu, (g["sum"] - g["count"] * mu) / (g["count"] + prior)


def test_bias_model_is_shrunk_mean_plus_user_offset(truth, ratings, cases):
    given, held = cases
    frame, _ = truth
    mu, b = brute_bias(frame)
    got = models.BiasModel(user_prior=10.0).fit(ratings).score(given, held, BY).toPandas()
    shown = given.toPandas()
    bu = (shown.rating - mu - shown.movieId.map(b)).groupby(shown.userId).agg(lambda x: x.sum() / (len(x) + 10))
    want = mu + got.movieId.map(b) + got.userId.map(bu)
    assert np.allclose(got.score, want)
    assert models.BiasModel().name == "bias" and models.BiasModel(user_prior=10).name == "bias_u10"


def brute_tower(truth, given, held, *, weights=None, bias_weights=None):
    frame, vec = truth
    mu, b = brute_bias(frame)
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    out = {}
    for user, mine in given.groupby("userId"):
        res = mine.rating.to_numpy() - mu - mine.movieId.map(b).to_numpy()
        bu = res.sum() / (len(res) + 10)
        known = mine.movieId.to_numpy() < 50
        profile = ((res - bu)[known] @ unit[mine.movieId.to_numpy()[known]]) / max(known.sum(), 1)
        w = np.ones(vec.shape[1]) if weights is None else np.asarray(weights)
        for item in held[held.userId == user].movieId:
            x = unit[item] if item < 50 else np.zeros(vec.shape[1])
            out[user, item] = mu + b[item] + bu + x @ (w * profile)
    return out


def test_tower_scores_match_numpy(truth, ratings, vecs, cases):
    given, held = cases
    tower = models.ContentTower(vecs, learn_weights=False).fit(ratings)
    got = tower.score(given, held, BY).toPandas()
    want = brute_tower(truth, given.toPandas(), held.toPandas())
    assert np.allclose(got.score, [want[u, i] for u, i in zip(got.userId, got.movieId)])


def test_all_users_fit_the_taste_weights(spark, vecs):
    films = spark.range(20).select(F.col("id").alias("movieId"))
    stars = (F.pmod(F.xxhash64("userId", "movieId"), F.lit(10)) + 1) / 2
    many = spark.range(4100).select(F.col("id").alias("userId")).crossJoin(films).withColumn("rating", stars)
    few = spark.range(9000, 9010).select(F.col("id").alias("userId")).crossJoin(films.where("movieId < 19")).withColumn("rating", stars)
    ratings, shared = many.unionByName(few).cache(), {}
    models.ContentTower(vecs).fit(ratings, shared)
    halves = shared[id(ratings), 0].groupBy("userId").agg(F.count_if("shown").alias("shown"), F.count(F.lit(1)).alias("n"))
    assert halves.agg(F.count("userId"), F.max("userId"), F.min("shown"), F.max("shown"), F.min("n")).first()[:] == (4100, 4099, 10, 10, 20)


def test_tower_learns_that_the_taste_axis_matters(truth, ratings, vecs, cases):
    given, held = cases
    tower = models.ContentTower(vecs).fit(ratings)
    assert np.argmax(np.abs(tower.weights)) == 0
    learned = tower.score(given, held, BY).toPandas()
    want = brute_tower(truth, given.toPandas(), held.toPandas(), weights=tower.weights)
    assert np.allclose(learned.score, [want[u, i] for u, i in zip(learned.userId, learned.movieId)])
    plain = models.BiasModel(user_prior=10.0).fit(ratings).score(given, held, BY).toPandas()
    error = lambda f: np.sqrt(((f.rating - f.score) ** 2).mean())
    assert error(learned) < error(plain)


def test_missing_bias_strategies(spark, truth, ratings, vecs):
    frame, vec = truth
    cold = list(range(40, 60))
    warm = ratings.where(F.col("movieId") < 40)
    mu, b = brute_bias(frame[frame.movieId < 40])
    lent = pd.Series({i: 0.5 * b.get(i, 0.2) + 0.1 for i in range(45)})
    lender = spark.createDataFrame([(int(i), float(v)) for i, v in lent.items()], "movieId long, lent double")

    def bias(strategy, **options):
        tower = models.ContentTower(vecs, item_bias=strategy, learn_weights=False, **options).fit(warm)
        return {r["movieId"]: (r["candidate_bias"], r["history_bias"]) for r in tower.items.collect()}, tower

    known, _ = bias("known")
    assert known[45] == (0.0, 0.0) and abs(known[3][0] - b[3]) < 1e-12
    none, _ = bias("none")
    assert none[3][0] == 0.0 and abs(none[3][1] - b[3]) < 1e-12
    predicted, tower = bias("predicted")
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    design, target = unit[:40], b.loc[range(40)].to_numpy()
    weights = np.linalg.solve(design.T @ design + 10 * np.eye(4), design.T @ target)
    assert np.allclose(tower.bias_weights, weights)
    assert abs(predicted[45][0] - unit[45] @ weights) < 1e-12
    borrowed, _ = bias("borrowed", borrowed=lender, learn_bias=False)
    assert abs(borrowed[3][0] - b[3]) < 1e-12  # a measured bias is never overridden
    assert abs(borrowed[42][0] - (lent[42] - 0.1) / 0.5) < 1e-9  # the line undoes the other crowd's scale
    assert borrowed[48][0] == 0.0 and cold
    with pytest.raises(ValueError):
        models.ContentTower(vecs, item_bias="borrowed")
    with pytest.raises(ValueError):
        models.ContentTower(vecs, item_bias="nonsense")


def test_truncated_svd_matches_numpy(spark):
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 30)) + 0.05 * rng.normal(size=(40, 30))
    dense[rng.random(dense.shape) < 0.3] = 0.0
    rows = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    cells = spark.createDataFrame(rows, "row long, col long, value double")
    svd = linear.truncated_svd(cells, 4, iterations=8)
    want = np.linalg.svd(dense, compute_uv=False)
    assert np.allclose(svd.singular_values, want[:4], rtol=1e-3)
    table = svd.columns.toPandas().sort_values("col")
    v = np.vstack(table["vec"])
    assert np.allclose(v.T @ v, np.eye(4), atol=1e-8)
    assert abs(svd.captured - (want[:4] ** 2).sum() / (want**2).sum()) < 1e-3
    projected = linear.project(cells, svd.columns, 4).toPandas().sort_values("row")
    assert np.allclose(np.vstack(projected["vec"]), dense @ v, atol=1e-8)


def test_biased_mf_folds_histories_in(ratings, cases, truth):
    given, held = cases
    model = models.BiasedMF(n_factors=3, min_item_ratings=5, iterations=5).fit(ratings)
    got = model.score(given, held, BY).toPandas()
    mu, b = brute_bias(truth[0])
    factors = {r["movieId"]: np.array(r["factor"]) for r in model.items.where("factor is not null").collect()}
    shown = given.toPandas()
    for user, mine in list(shown.groupby("userId"))[:5]:
        after = mine.rating.to_numpy() - mu - mine.movieId.map(b).to_numpy()
        bu = after.sum() / (len(after) + 10)
        x = np.vstack([factors[i] for i in mine.movieId])
        taste = np.linalg.solve(x.T @ x + 8 * np.eye(3), x.T @ (after - bu))
        part = got[got.userId == user]
        want = [mu + b[i] + bu + factors[i] @ taste for i in part.movieId]
        assert np.allclose(part.score, want)


@pytest.mark.parametrize("long", [models.LONG_HISTORY, 1_000_000, 2])
def test_a_history_of_any_length_folds_in_by_sums(spark, monkeypatch, long):
    monkeypatch.setattr(models, "LONG_HISTORY", long)
    rng = np.random.default_rng(5)
    rows = [(u, i, float(rng.integers(1, 11)) / 2) for u in range(12) for i in range(30) if rng.random() < 0.7 or u == 0]
    ratings = spark.createDataFrame(rows, "userId long, movieId long, rating double")
    model = models.BiasedMF(n_factors=3, min_item_ratings=2, iterations=3).fit(ratings)
    hot = spark.range(20_000).select(F.lit(0).cast("long").alias("userId"), (F.col("id") % 30).alias("movieId"), F.lit(4.0).alias("rating"))
    few = spark.createDataFrame([(1, 3, 5.0), (1, 4, 1.0), (2, 1, 5.0), (2, 2, 3.0), (2, 3, 1.0)], ratings.schema)
    got = {r["userId"]: r for r in model.fold_in(hot.union(few), ["userId"]).collect()}
    assert got[1]["taste"] is None and len(got) == 3
    items = {r["movieId"]: r for r in model.items.collect()}
    for user, mine in ((0, [(i, 4.0) for i in range(30)] * 666 + [(i, 4.0) for i in range(20)]), (2, [(1, 5.0), (2, 3.0), (3, 1.0)])):
        after = np.array([r for _, r in mine]) - ratings.agg(F.avg("rating")).first()[0] - np.array([items[i]["bias"] for i, _ in mine])
        x = np.vstack([items[i]["factor"] for i, _ in mine])
        bu = after.sum() / (len(after) + 10)
        assert np.allclose(got[user]["taste"], np.linalg.solve(x.T @ x + 8 * np.eye(3), x.T @ (after - bu)), atol=1e-8)


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6))
    y = 3 + x @ np.array([0.6, -0.4, 0, 0, 0.2, 0]) + rng.normal(0, 0.1, 120)
    frame = pd.DataFrame({"row": range(120), "rating": y, "vec": list(x)})
    return frame, spark.createDataFrame(frame).cache()


def test_ridge_strength_is_chosen_by_leave_one_out(library):
    frame, table = library
    fit = linear.ridge_leave_one_out(table, "vec", "rating")
    x, y = np.vstack(frame.vec), frame.rating.to_numpy()
    best = None
    for alpha in linear.alpha_grid():
        loss = 0.0
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            xm, ym = x[keep].mean(0), y[keep].mean()
            c = x[keep] - xm
            w = np.linalg.solve(c.T @ c + alpha * np.eye(6), c.T @ (y[keep] - ym))
            loss += (y[i] - ym - (x[i] - xm) @ w) ** 2
        if best is None or loss < best[0]:
            best = (loss, alpha)
    assert abs(fit.alpha - best[1]) < 1e-9
    c = x - x.mean(0)
    assert np.allclose(fit.weights, np.linalg.solve(c.T @ c + fit.alpha * np.eye(6), c.T @ (y - y.mean())))


@pytest.mark.parametrize(("block_bytes", "slab_rows", "clusters"), [(64 << 20, 1 << 15, None), (1500, 16, None), (1500, 16, 1), (64 << 20, 16, 5)])
def test_knn_is_exact_in_one_block_and_in_many(library, block_bytes, slab_rows, clusters):
    frame, table = library
    train, test = table.where("row < 90"), table.where("row >= 80")
    model = personal.ContentKNN(neighbours=7, block_bytes=block_bytes, slab_rows=slab_rows, clusters=clusters).fit(train)
    assert len(model.index.centres) == {None: 1 if block_bytes > 10_000 else 9}.get(clusters, clusters)
    got = model.predict(test).toPandas().set_index("row")["predicted"]
    x = np.vstack(frame.vec)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for row in range(80, 120):
        sims = unit[:90] @ unit[row]
        near = np.argsort(-sims)[:7]
        gap = 1 - sims[near]
        exact = gap <= 1e-12
        want = frame.rating[near][exact].mean() if exact.any() else (frame.rating[near] / gap).sum() / (1 / gap).sum()
        assert abs(got[row] - want) < 1e-6


def test_debias_moves_only_the_popularity_term(library):
    _, table = library
    plain = personal.ContentRidge().fit(table)
    free = personal.ContentRidge(debias=True, popularity_at=0).fit(table)
    a, b = plain.predict(table).toPandas(), free.predict(table).toPandas()
    shift = np.array([plain.solution.weights[0] * (free.typical - v[0]) for v in a["vec"]])
    assert np.allclose(b["predicted"], a["predicted"] + shift)


def test_blends_and_stacks(spark, library):
    frame, table = library
    noisy = spark.createDataFrame(
        [(int(r), float(y), [float(y)]) for r, y in zip(frame.row, frame.rating) if r < 100],
        "row long, item_mean double, factors array<double>",
    )
    useless = spark.createDataFrame(
        [(int(r), float((r * 7919) % 13), [float((r * 31) % 7)]) for r in frame.row], "row long, item_mean double, factors array<double>"
    )
    good = personal.SupportGatedBlend(personal.GlobalMean(), personal.CollaborativeFold(noisy)).fit(table)
    assert good.weight > 0.9
    got = good.predict(table).toPandas().set_index("row")["predicted"]
    assert abs(got[110] - frame.rating.mean()) < 1e-9  # uncovered films fall back to content
    poor = personal.SupportGatedBlend(personal.ContentRidge(), personal.CollaborativeFold(useless)).fit(table)
    assert poor.weight < 0.2
    stack = personal.StackedEnsemble([personal.ContentRidge(), personal.CollaborativeFold(useless)]).fit(table)
    assert all(w >= 0 for w in stack.weights) and stack.weights[0] > 0.8
    assert [r["model"] for r in stack.weight_table(spark).collect()][0] == "content_ridge"


def test_crowd_score_falls_back_without_spread(spark):
    flat = spark.createDataFrame([(1, 4.0, 6.5), (2, 3.0, 6.5), (3, 2.0, 6.5)], "row long, rating double, crowd_shrunk double")
    assert [r["predicted"] for r in personal.CrowdScore().fit(flat).predict(flat).collect()] == [3.0] * 3


def test_boosted_trees_learn_something(library):
    frame, table = library
    out = personal.GradientBoosted(trees=8, step=0.3).fit(table).predict(table).toPandas()
    assert ((out.predicted - out.rating) ** 2).mean() < frame.rating.var() * 0.6


def test_tfidf_matches_the_formula(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "row long, text string")
    block = features.TfIdf(features.TextSettings(min_df=1)).fit(docs)
    got = {(r["row"], r["term"]): r["value"] for r in block.transform(docs).collect()}
    idf = {t: np.log(4 / (1 + df)) + 1 for t, df in {"a": 1, "b": 2, "c": 1}.items()}
    one = np.array([2 * idf["a"], idf["b"]])
    assert np.isclose(got[1, "a"], one[0] / np.linalg.norm(one)) and np.isclose(got[1, "b"], one[1] / np.linalg.norm(one))
    assert not any(row == 3 for row, _ in got)
    capped = features.TfIdf(features.TextSettings(min_df=1, max_features=1)).fit(docs)
    assert [r["term"] for r in capped.vocabulary.collect()] == ["a"]
    pairs = features.term_counts(docs, features.TextSettings(bigrams=True, stop_words=("c",)))
    assert {(r["row"], r["term"]): r["tf"] for r in pairs.collect()} == {
        (1, "a"): 2, (1, "b"): 1, (1, "a b"): 1, (1, "b a"): 1, (2, "b"): 1}


def test_empty_vocabulary_gives_a_zero_column(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "row long, text string")
    block = features.ReducedText(features.TextSettings(min_df=2), 4).fit(docs)
    assert sorted(map(tuple, block.transform(docs, "p").collect())) == [(1, "p0", 0.0), (2, "p0", 0.0)]


def test_reduced_text_is_standardised(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words, 6))) for i in range(40)], "row long, text string")
    out = features.ReducedText(features.TextSettings(min_df=1), 3).fit(docs).transform(docs, "t").toPandas()
    stats = out.groupby("term")["value"].agg(["mean", lambda v: v.std(ddof=0)])
    assert len(stats) == 3 and np.allclose(stats.iloc[:, 0], 0, atol=1e-9) and np.allclose(stats.iloc[:, 1], 1, atol=1e-9)


def test_unit_vectors(vecs):
    unit = vectors.unit_vectors(vecs)
    lengths = [sum(x * x for x in r["vec"]) for r in unit.collect()]
    assert np.allclose(lengths, 1.0)


def test_stratified_ranker_keeps_group_order_and_prefix_shares(spark):
    rows = [("u", i, i < 80, float((i * 37) % 100)) for i in range(100)]
    scored = spark.createDataFrame(rows, "userId string, movieId int, known boolean, score double")
    out = ranking.interleave(scored, ["userId"]).toPandas().sort_values("rank_score", ascending=False)
    for n in (10, 25, 50):
        assert abs(out.head(n).known.mean() - 0.8) <= 1.5 / n
    for _, part in out.groupby("known"):
        assert part.score.is_monotonic_decreasing
    tied = scored.withColumn("score", F.lit(1.0))
    first = ranking.interleave(tied, ["userId"]).orderBy(F.desc("rank_score")).limit(10).toPandas()
    assert sorted(first.movieId) != list(range(10))  # ties do not go to the lowest ids


def test_item_vectors_place_like_films_together(spark):
    rows = []
    for i in range(60):
        kind = "noir" if i % 2 else "western"
        rows.append((i, [kind], [kind, f"{kind} night"], [f"Director {kind} {i % 4}"], ["US"], 1950 + i % 7, 90 + i % 5,
                     i * 10, 6.0, "en", f"a {kind} story about {kind} people and {kind} towns", ""))
    films = spark.createDataFrame(
        rows, "tmdb_id long, genres array<string>, keywords array<string>, directors array<string>, "
        "production_countries array<string>, year int, runtime int, vote_count long, vote_average double, "
        "original_language string, overview string, tagline string")
    table = metadata.item_vectors(films, n_components=6, keyword_components=2, synopsis_components=2)
    got = {r["movieId"]: np.array(r["vec"]) for r in table.collect()}
    assert len(got) == 60 and all(len(v) == 6 for v in got.values())
    unit = {k: v / np.linalg.norm(v) for k, v in got.items()}
    same = np.mean([unit[a] @ unit[b] for a in range(0, 60, 2) for b in range(0, 60, 2) if a != b])
    other = np.mean([unit[a] @ unit[b] for a in range(0, 60, 2) for b in range(1, 60, 2)])
    assert same > other + 0.3
    with pytest.raises(ValueError):
        features.FilmMatrix(["genres", "nonsense"])


@pytest.fixture(scope="module")
def shelf(spark):
    """Rated films in the films' own columns."""
    rows = []
    for i in range(80):
        kind = "noir" if i % 2 else "western"
        rows.append((i, i, 3.0 + (i % 2) + i % 3 / 10, [kind], [kind, f"{kind} night", f"word {i % 7}"], [f"Director {i % 4}"],
                     [f"Star {i % 5}"], ["US"], 1950 + i % 7, None if i % 9 == 0 else 90 + i % 5, i * 10, 6.0 + i % 4, "en" if i % 3 else "fr",
                     f"a {kind} story about {kind} people and towns of the {i % 6} th kind", "x"))
    return spark.createDataFrame(
        rows, "row long, tmdb_id long, rating double, genres array<string>, keywords array<string>, directors array<string>, "
        "cast array<string>, production_countries array<string>, year int, runtime int, vote_count long, vote_average double, "
        "original_language string, overview string, tagline string").cache()


def test_a_held_film_changes_nothing_in_the_fit(shelf):
    train, held = shelf.where("row < 60"), shelf.where("row >= 60")
    loud = held.withColumns({"genres": F.array(F.lit("brand new")), "keywords": F.array(F.lit("unheard of")),
                             "overview": F.lit("words that nobody wrote before"), "year": F.lit(1800), "original_language": F.lit("xx")})
    fitted = metadata.FilmVectors(("genres", "keywords", "numeric", "language"), keyword_components=2).fit(train)
    plain = {r["row"]: r["vec"] for r in fitted.transform(shelf).collect()}
    beside = {r["row"]: r["vec"] for r in fitted.transform(train.unionByName(loud)).collect()}
    assert all(np.allclose(plain[i], beside[i]) for i in range(60))
    assert not any("new" in term or "unheard" in term or "xx" in term for term in fitted.terms)
    assert len(plain[0]) == fitted.width == len(fitted.terms)
    numbers = np.array([plain[i][fitted.place("numeric:log_votes")] for i in range(60)])
    assert abs(numbers.mean()) < 1e-9 and abs(numbers.std() - 1) < 1e-9  # of the training films alone


@pytest.mark.parametrize(("blocks", "components"), [(("keywords", "numeric", "language"), None), (("genres", "numeric"), 2)])
def test_stored_vectors_are_the_same(spark, shelf, tmp_path, blocks, components):
    fitted = metadata.FilmVectors(blocks, components=components, keyword_components=2).fit(shelf)
    fitted.save(str(tmp_path / "stored"))
    again = metadata.FilmVectors.load(spark, str(tmp_path / "stored"))
    want = {r["tmdb_id"]: r["vec"] for r in fitted.vectors(shelf).collect()}
    got = {r["tmdb_id"]: r["vec"] for r in again.vectors(shelf).collect()}
    assert want.keys() == got.keys() and all(np.allclose(want[i], got[i]) for i in want)


def test_models_on_metadata_predict_every_film_once(shelf):
    vectors = metadata.FilmVectors(("genres", "numeric", "language"))
    models_ = [metadata.OnMetadata(m, vectors) for m in (personal.ContentRidge(), personal.ContentKNN(neighbours=5))]
    held = crossval.cross_validate(models_, shelf, k=2).toPandas()
    assert len(held) == 160 and held.groupby("model").row.nunique().eq(80).all() and held.predicted.notna().all()
    assert ((held.predicted - held.actual) ** 2).mean() < 0.2  # the genre tells most of the rating


def test_a_fold_describes_its_films_once(shelf, monkeypatch):
    labels = []

    def written(frame, label, compression=None):
        labels.append(label)
        return session.written(frame, label, compression)

    for module in (metadata, crossval):
        monkeypatch.setattr(module, "written", written)
    joins = []

    class Reads(personal.ContentRidge):
        def predict(self, films):
            joins.append(str(films.select("row", "vec")._jdf.queryExecution().optimizedPlan()).count("Join"))
            return super().predict(films)

    held = crossval.cross_validate([metadata.OnMetadata(Reads(), metadata.FilmVectors(("genres", "numeric")))], shelf, k=2)
    assert held.count() == 80
    # features of a fold's training and held films, predictions per fold, films beside finished vectors
    assert labels.count("features") == 4 and labels.count("out-of-fold") == 2 and joins == [1, 1]


def test_blocks_of_the_fit_are_laid_out_once(shelf, monkeypatch):
    made, plain = [], features.RowBlocks

    class Counted(plain):
        def __init__(self, cells):
            made.append(1)
            super().__init__(cells)

    for module in (metadata, features):
        monkeypatch.setattr(module, "RowBlocks", Counted)
    monkeypatch.setattr(linear, "RowBlocks", Counted)
    fitted = metadata.FilmVectors(("genres", "keywords"), components=3, keyword_components=2).fit(shelf)
    own = {r["tmdb_id"]: r["vec"] for r in fitted.vectors(shelf).collect()}
    assert len(made) == 2  # of the keywords, and of the whole matrix
    again = {r["tmdb_id"]: r["vec"] for r in fitted.vectors(shelf.select("*")).collect()}
    assert own.keys() == again.keys() and all(np.allclose(own[i], again[i]) for i in own)


def test_debias_on_metadata_finds_its_column(shelf):
    vectors = metadata.FilmVectors(("genres", "numeric"))
    free = metadata.OnMetadata(personal.ContentRidge(debias=True), vectors).fit(shelf)
    famous = shelf.withColumn("vote_count", F.lit(10**6).cast("long")).withColumn("vote_average", F.lit(None).cast("double"))
    obscure = famous.withColumn("vote_count", F.lit(3).cast("long"))
    a, b = (dict(free.predict(x).select("row", "predicted").collect()) for x in (famous, obscure))
    shrunk = free.vectors.place("numeric:crowd_shrunk")
    assert all(abs(a[i] - b[i]) < 1e-6 + abs(free.model.solution.weights[shrunk]) * 10 for i in a)
    with pytest.raises(ValueError):
        metadata.FilmVectors(("genres",)).fit(shelf).place("numeric:log_votes")


def test_vocabularies_are_limited_on_request_only(shelf):
    whole = metadata.FilmVectors(("directors",)).fit(shelf)
    assert whole.width == 4 and metadata.FilmVectors(("directors",), vocabularies={"directors": 3}).fit(shelf).width == 3


def test_archive_vectors_are_fitted_on_linked_films(spark, shelf):
    bridge = spark.createDataFrame([(900 + i, float(i)) for i in range(0, 80, 2)], "movieId long, tmdbId double")
    settings = {"blocks": ("genres", "numeric"), "n_components": 3}
    got = dict(metadata.archive_vectors(shelf, bridge, **settings).collect())
    alone = dict(metadata.item_vectors(shelf.where("tmdb_id % 2 = 0"), **settings).collect())
    assert got.keys() == {900 + i for i in alone} and all(np.allclose(got[900 + i], alone[i]) for i in alone)


def test_svd_of_low_rank_and_empty_matrices(spark):
    one = spark.range(40).select((F.col("id") % 8).alias("row"), (F.col("id") % 5).alias("col"), F.lit(1.0).alias("value"))
    svd = linear.truncated_svd(one, 3, iterations=2)  # rank one: fewer vectors than asked
    assert len(svd.singular_values) == 1 and abs(svd.captured - 1.0) < 1e-9
    zero = linear.truncated_svd(one.withColumn("value", F.lit(0.0)), 3)
    assert zero.captured == 0.0 and zero.columns.count() == 5
    assert linear.truncated_svd(one.where("row < 0"), 3).columns.count() == 0


def test_no_long_vector_passes_through_the_driver(spark, monkeypatch):
    cells = spark.range(4000).select((F.col("id") % 80).alias("row"), (F.col("id") % 50).alias("col"), F.lit(1.0).alias("value"))
    plans, image = [], linear.RowBlocks.image_chunks

    def spied(self, chunks, matrix):
        plans.append(chunks._jdf.queryExecution().executedPlan().toString())
        return image(self, chunks, matrix)

    monkeypatch.setattr(linear.RowBlocks, "image_chunks", spied)
    blocks = linear.RowBlocks(cells)
    svd = linear.truncated_svd(blocks, 3, iterations=1)
    plans.append(blocks.chunks(svd.columns)._jdf.queryExecution().executedPlan().toString())
    assert all("BroadcastHashJoin [col" not in plan for plan in plans) and len(plans) == 2


def test_rounds_of_an_svd_leave_one_table_of_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "scratch_path", lambda spark, label: f"{tmp_path}/{label}-{len(list(tmp_path.glob(label + '*')))}-{time.time_ns()}")
    cells = spark.range(900).select((F.col("id") % 90).alias("row"), F.pmod(F.xxhash64("id"), F.lit(40)).alias("col"), F.lit(1.0).alias("value"))
    svd = linear.truncated_svd(cells, 3, iterations=3)
    assert len(list(tmp_path.glob("vectors-*"))) == 1  # before: one per round beside it
    assert svd.columns.count() == 40


@pytest.mark.parametrize("most", [1 << 25, 100_000])
def test_vectors_move_once_per_block_whatever_the_cells(spark, monkeypatch, most):
    monkeypatch.setattr(linear, "BLOCK_CELLS", most)
    at = F.pmod(F.xxhash64("id"), F.lit(500))
    row = F.when(F.col("id") < 150_000, 0).when(F.col("id") % 7 < 6, F.col("id") % 7)  # one long row, one without an id
    cells = spark.range(300_000).select(row.alias("row"), at.alias("col"), (F.col("id") % 5 - 1.5).alias("value"))
    blocks = linear.RowBlocks(cells)
    assert blocks.blocks == -(-300_000 // most)
    local = cells.groupBy("row", "col").agg(F.sum("value").alias("value")).toPandas()
    names = [None if np.isnan(r) else int(r) for r in local["row"].drop_duplicates()]
    dense = np.zeros((len(names), 500))
    for r, c, v in zip(local["row"], local["col"], local["value"]):
        dense[names.index(None if np.isnan(r) else int(r)), int(c)] = v
    v = np.column_stack([np.arange(500) % 7 - 3.0, np.arange(500) % 11 - 5.0, np.ones(500)])
    vectors = spark.createDataFrame([(i, [float(x) for x in line]) for i, line in enumerate(v)], "col long, vec array<double>")
    mix = np.array([[1.0, 2.0], [0.0, 1.0], [3.0, 0.0]])
    moved = blocks._shares(blocks.chunks(vectors), mix).agg(F.sum(F.size("vec"))).first()[0]
    assert moved <= 2 * 500 * blocks.blocks  # before: again for every 2 ** 18 cells
    image = {r["col"]: r["vec"] for r in blocks.image(vectors, mix).collect()}
    assert np.allclose([image[i] for i in range(500)], dense.T @ (dense @ v @ mix))
    assert np.allclose(blocks.gram(blocks.chunks(vectors), mix), (dense @ v @ mix).T @ (dense @ v @ mix))
    rows = {r["row"]: r["vec"] for r in linear.project(blocks, vectors.where("col < 400"), 3).collect()}
    assert np.allclose([rows[r] for r in names], dense[:, :400] @ v[:400]) and len(rows) == len(names)
    few = cells.where("row = 3 and col < 250 or row = 4 and col >= 250")
    assert {r["row"] for r in linear.project(few, vectors.where("col < 250"), 3).collect()} == {3}


def test_words_are_not_shuffled_for_a_vocabulary_that_can_be_broadcast(spark):
    docs = spark.createDataFrame([(i % 30, f"a b{i % 7} c{i % 3} a") for i in range(60)] + [(None, "a b1"), (3, None)], "row long, text string")
    block = features.TfIdf(features.TextSettings(sublinear=True)).fit(docs)
    table = block.transform(docs)
    plan = table._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "REPARTITION_BY_COL" in shuffles[0]  # the texts
    lengths = table.groupBy("row").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert len(lengths) == 31 and all(abs(r["n"] - 1) < 1e-9 for r in lengths)


def test_factors_of_labelled_films_are_made_once(spark, ratings):
    labelled = spark.createDataFrame([(3,), (4,), (4,), (900,)], "row long")
    tables = SimpleNamespace(model_ratings=lambda: ratings, labelled_vectors=lambda: labelled)
    table = analytics_queries._factor_table(tables)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # before: the ratings, again with every use
    whole = {r["movieId"]: r for r in models.item_factors(ratings).collect()}
    got = {r["row"]: r for r in table.collect()}
    assert sorted(got) == [3, 4] and table.count() == 2
    assert all(abs(got[i]["item_mean"] - whole[i]["item_mean"]) < 1e-12 for i in got)
    assert all(np.allclose(got[i]["factors"], whole[i]["factors"]) for i in got)


def test_correlations_of_a_taste_summary_are_written(spark):
    rows = [(u, i, float(1 + (3 * u + i * i) % 9) / 2, None if i == 7 else 10 * i % 70, float(i % 5)) for u in range(3) for i in range(12)]
    rated = spark.createDataFrame(rows + [(None, 1, 2.0, 5, 3.0), (1, 40, None, 5, 3.0)], "userId long, movieId long, rating double, vote_count long, vote_average double")
    table = reports.taste_summary(rated, ["userId"])
    assert "Window" not in table._jdf.queryExecution().executedPlan().toString()  # before: all shuffles stayed to the end
    got = {r["userId"]: r for r in table.collect()}
    frame = pd.DataFrame(rows, columns=["userId", "movieId", "rating", "vote_count", "vote_average"])
    assert got.keys() == {None, 0, 1, 2} and got[None]["rated_films"] == 1 and got[None]["rho_crowd"] is None
    for user, part in frame.groupby("userId"):
        for column, name in (("vote_count", "rho_popularity"), ("vote_average", "rho_crowd")):
            known = part.dropna(subset=[column])
            want = known["rating"].rank().corr(known[column].rank())
            assert abs(got[user][name] - want) < 1e-9 and got[user]["rated_films"] == 12
