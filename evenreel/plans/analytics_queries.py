"""Queries over reports, ranking, features, models and protocols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenreel.functions import numeric as num
from evenreel.operators import archive, crossval, crowd, features, linear, metadata, models, personal, protocol, ranking, reports
from evenreel.operators import interactions as inter
from evenreel.operators.ordering import average_rank
from evenreel.operators.quantiles import rank_first_deciles
from evenreel.operators.vectors import dimension, dot, unit_vectors
from evenreel.plans.oracle import band, band_no, spearman, statement
from evenreel.plans.registry import query, r6
from evenreel.plans.tables_queries import _COVERAGE, _joined
from evenreel.plans.views import HISTORY_SIZES
from evenreel.session import written

KEYS = ["user_id", "film_key"]

# -- interaction reports ---------------------------------------------------------


@query(
    "films_local",
    statement(
        """select i.user_id, i.film_key, n.title, i.year, i.n_interactions, i.kinds, false as synthetic_key, i.deleted_only
           from (select user_id, film_key, min(year) as year, count(*) as n_interactions,
                        array_to_string(list_sort(list(distinct kind)), '|') as kinds, bool_and(deleted) as deleted_only
                 from inter group by all) i
           join film_names n on n.user_id = i.user_id and n.film_key = i.film_key""",
        "inter",
        "film_names",
    ),
)
def films_local(t):
    return inter.films_local(t.interactions(), KEYS)


@query(
    "film_status",
    statement(
        "select user_id, film_key, title, year, seen, rating, liked, on_watchlist, watchlist_pending from status",
        "status",
    ),
)
def film_status(t):
    return inter.film_status(t.interactions(), KEYS)


@query("coverage_report", statement(_COVERAGE, "inter"))
def coverage_report(t):
    return inter.coverage_report(t.interactions())


@query(
    "overview_counts",
    statement(
        """select count(rating) as rated, count(*) filter (where seen) as watched, count(*) filter (where watchlist_pending) as pending,
                  round(avg(rating), 6) as mean_rating, round(stddev_pop(rating), 6) as rating_sd from joined""",
        "joined",
    ),
)
def overview_counts(t):
    return reports.overview_counts(_joined(t)).select(
        "rated", "watched", "pending", *r6("mean_rating", "rating_sd")
    )


@query("overview_ratings", statement("select rating, count(*) as films from rated group by 1", "rated"))
def overview_ratings(t):
    return reports.rating_histogram(t.rated_films())


@query(
    "overview_votes",
    statement(
        """select floor(ln(1 + vote_count) / 0.5)::integer as bin, count(*) as films,
                  round(count(*)::double / ((select count(*) from films) * 0.5::double), 6) as density from films group by 1""",
        "films",
    ),
)
def overview_votes(t):
    return reports.vote_histogram(t.films()).select("bin", "films", *r6("density"))


@query(
    "explode_rating",
    statement("select genre as genres, rating, count(*) as n from (select unnest(genres) as genre, rating from rated) group by all", "rated"),
)
def explode_rating(t):
    return reports.explode_rating(t.rated_films(), "genres").groupBy("genres", "rating").agg(
        F.count(F.lit(1)).alias("n")
    )


def _entries_sql(column: str, least: int, top: int) -> str:
    return statement(
        f"""select x as {column}, count(rating) as films, round(avg(rating), 6) as mean_rating
            from (select unnest({column}) as x, rating from rated) group by x having count(rating) >= {least}
            order by films desc, x limit {top}""",
        "rated",
    )


@query("overview_genres", _entries_sql("genres", 5, 15))
def overview_genres(t):
    table = reports.by_list_entry(t.rated_films(), "genres", min_films=5, top=15)
    return table.select("genres", "films", *r6("mean_rating"))


@query("overview_directors", _entries_sql("directors", 3, 20))
def overview_directors(t):
    table = reports.by_list_entry(t.rated_films(), "directors", min_films=3, top=20)
    return table.select("directors", "films", *r6("mean_rating"))


@query(
    "overview_decades",
    statement(
        "select (year // 10 * 10)::integer as decade, count(rating) as films, round(avg(rating), 6) as mean_rating from rated group by 1",
        "rated",
    ),
)
def overview_decades(t):
    return reports.by_decade(t.rated_films()).select("decade", "films", *r6("mean_rating"))


# -- taste and popularity ----------------------------------------------------------


@query(
    "spearman",
    statement(
        "select userId, round(rho, 6) as rho from (" + spearman("rated", "userId", "rating", "vote_count", "rho") + ")",
        "rated",
    ),
)
def spearman_query(t):
    rho = reports.spearman(
        t.rated_films(),
        ["userId"],
        "rating",
        "vote_count",
        left_spread=reports.star_ranges(F.col("rating")),
        right_spread=F.floor(F.log1p("vote_count") * 16).cast("int"),
        out="rho",
    )
    return rho.select("userId", *r6("rho"))


@query(
    "taste_summary",
    statement(
        """select b.userId, rated_films, round(mean_rating, 6) as mean_rating, round(sd, 6) as rating_sd, round(sd, 6) as rmse_floor,
                  round(rho_popularity, 6) as rho_popularity, round(rho_crowd, 6) as rho_crowd
           from (select userId, count(*) as rated_films, avg(rating) as mean_rating, stddev_pop(rating) as sd from rated group by 1) b
           left join fame using (userId) left join score using (userId)""",
        "rated",
        "fame",
        "score",
        extra={
            "fame": (spearman("rated", "userId", "rating", "vote_count", "rho_popularity"), ("rated",)),
            "score": (spearman("rated", "userId", "rating", "vote_average", "rho_crowd"), ("rated",)),
        },
    ),
)
def taste_summary(t):
    table = reports.taste_summary(t.rated_films(), ["userId"])
    return table.select(
        "userId", "rated_films", *r6("mean_rating", "rating_sd", "rmse_floor", "rho_popularity", "rho_crowd")
    )


_EDGES = {
    "edges": (
        """select list_sort(list_distinct(quantile_cont(vote_count::double,
             [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as e from catalogue""",
        ("catalogue",),
    ),
}
_BUCKET = """case when {v} between e[1] and e[-1] then greatest(1, len(list_filter(e, lambda x: x < {v}::double)))::integer end"""


@query(
    "profile_deciles",
    statement(
        f"""select decile, count(*) as films, count(rating) as rated, round(avg(rating), 6) as mean_rating,
                   round(count(*)::double / (select count(*) from rated), 6) as share
            from (select rating, {_BUCKET.format(v='vote_count')} as decile from rated, edges) where decile is not null group by 1""",
        "rated",
        "edges",
        extra=_EDGES,
    ),
)
def profile_deciles(t):
    table = reports.profile_deciles(t.rated_films(), t.catalogue())
    return table.select("decile", "films", "rated", *r6("mean_rating", "share"))


@query(
    "tail_share",
    statement(
        """select x as under_votes, count(*) filter (where vote_count < x) as films,
                  round(count(*) filter (where vote_count < x)::double / count(*), 6) as share
           from rated, (select unnest([100, 500, 1000, 5000])::integer as x) group by 1""",
        "rated",
    ),
)
def tail_share(t):
    return reports.tail_share(t.rated_films()).select("under_votes", "films", *r6("share"))


@query(
    "popularity_gap",
    statement(
        """select "set", count(*) as films, trunc(quantile_cont(vote_count::double, 0.5))::integer as median_votes,
                  trunc(quantile_cont(vote_count::double, 0.1))::integer as p10_votes,
                  trunc(quantile_cont(vote_count::double, 0.9))::integer as p90_votes
           from (select 'rated' as "set", vote_count from joined where rating is not null
                 union all select 'watchlist pending', vote_count from joined where watchlist_pending) group by 1""",
        "joined",
    ),
)
def popularity_gap(t):
    joined = _joined(t)
    label = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("rating").isNotNull(), F.lit("rated")),
                F.when(F.col("watchlist_pending"), F.lit("watchlist pending")),
            )
        )
    ).alias("set")
    return reports.popularity_gap(joined.select(label, "vote_count"))


@query(
    "popularity_report",
    statement(
        """select greatest(1, ceil((r - 1) * 10.0::double / greatest(n - 1, 1)))::integer as decile, count(*) as films,
                  min(vote_count) as votes_min, max(vote_count) as votes_max
           from (select vote_count, row_number() over (order by vote_count, tmdb_id) as r, count(*) over () as n
                 from films where vote_count is not null) group by 1""",
        "films",
    ),
)
def popularity_report(t):
    return rank_first_deciles(t.films())


@query(
    "coverage_by_popularity",
    statement(
        f"""select decile, count(*) as films, count(movieId) as in_archive,
                   coalesce(trunc(quantile_cont(n_ratings::double, 0.5))::integer, 0) as median_ratings,
                   round(count(movieId)::double / count(*), 6) as coverage
            from (select l.movieId, n.n_ratings, {_BUCKET.format(v='f.vote_count')} as decile
                  from (select m.tmdb_id, a.movieId from film_map m
                        left join (select min(movieId) as movieId, tmdbId from links where tmdbId is not null group by 2) a on a.tmdbId = m.tmdb_id
                        where m.tmdb_id is not null) l
                  left join catalogue f on f.tmdb_id = l.tmdb_id
                  left join (select movieId + 500000 as movieId, count(*) as n_ratings from mr group by 1) n on n.movieId = l.movieId, edges)
            where decile is not null group by 1""",
        "film_map",
        "links",
        "catalogue",
        "mr",
        "edges",
        extra=_EDGES,
    ),
)
def coverage_by_popularity(t):
    per_movie = t.model_ratings().groupBy((F.col("movieId") + 500000).alias("movieId")).agg(
        F.count(F.lit(1)).alias("n_ratings")
    )
    linked = archive.link_films(t.film_map(), t.links())
    table = archive.coverage_by_popularity(linked, t.catalogue(), per_movie)
    return table.select("decile", "films", "in_archive", "median_ratings", *r6("coverage"))


# -- biases and simple models --------------------------------------------------------

_ITEM_BIAS = {
    "mu": ("select avg(rating) as mu from mr", ("mr",)),
    "ib": (
        "select movieId, count(*) as n, (sum(rating) - count(*) * any_value(mu)) / (count(*) + 20.0::double) as bias from mr, mu group by 1",
        ("mr", "mu"),
    ),
}


@query(
    "item_bias",
    statement("select movieId, n, round(bias, 6) as bias from ib", "ib", extra=_ITEM_BIAS),
)
def item_bias(t):
    return crowd.item_bias(t.model_ratings()).select("movieId", "n", *r6("bias"))


def _seeded(user: str = "userId", item: str = "movieId", seed: int = 0) -> str:
    return f"md5(concat_ws(':', {user}, {item}, '{seed}'))"


_SIZES = "(select unnest([5, 10, 20])::integer as n_given)"

# shown and held films of every user, at each history size
_HISTORY = {
    "placed": (
        f"""select *, row_number() over (partition by userId order by {_seeded()}, movieId) as pos,
                   count(*) over (partition by userId) as total from mr""",
        ("mr",),
    ),
    "cases": (
        f"select n_given, userId, movieId, rating, pos <= n_given as given from placed, {_SIZES} where total > n_given + 5",
        ("placed",),
    ),
}


@query(
    "profile_split",
    statement("select n_given, userId, movieId, rating, given from cases", "cases", extra=_HISTORY),
)
def profile_split(t):
    return protocol.history_cases(t.model_ratings(), HISTORY_SIZES)


_TEST_SHARE = 0.4


def _chosen(ratings: str) -> str:
    """Test members: a share of those with enough ratings, in hash order."""
    return f"""select userId from (select userId, row_number() over (order by md5(concat_ws(':', userId, '0'))) as r, count(*) over () as n
             from (select userId from {ratings} group by 1 having count(*) >= 40)) where r <= greatest(1, round_even({_TEST_SHARE}::double * n, 0))"""


def _baseline_ctes(train: str, cases: str, prefix: str) -> dict:
    p = prefix
    return {
        f"{p}mu": (f"select avg(rating) as mu from {train}", (train,)),
        f"{p}im": (
            f"select movieId, (sum(rating) + 20 * any_value(mu)) / (count(*) + 20.0::double) as m from {train}, {p}mu group by 1",
            (train, f"{p}mu"),
        ),
        f"{p}hist": (
            f"""select n_given, userId, avg(rating) as um, avg(rating - coalesce(m, mu)) as bu, sum(rating - coalesce(m, mu)) / (count(*) + 10.0::double) as bu10
                from {cases} left join {p}im using (movieId), {p}mu where given group by 1, 2""",
            (cases, f"{p}im", f"{p}mu"),
        ),
        f"{p}base": (
            f"""select c.*, coalesce(m, mu) as im, um, bu, bu10 from {cases} c left join {p}im using (movieId)
                join {p}hist h on h.n_given = c.n_given and h.userId = c.userId, {p}mu where not given""",
            (cases, f"{p}im", f"{p}hist", f"{p}mu"),
        ),
    }


# fitted on the train members of the whole crowd, scored on the test members
_GENERAL_SPLIT = {
    "g_users": (_chosen("mr"), ("mr",)),
    "g_train": ("select * from mr where userId not in (select userId from g_users)", ("mr", "g_users")),
    "g_placed": (
        f"""select *, row_number() over (partition by userId order by {_seeded()}, movieId) as pos, count(*) over (partition by userId) as total
            from mr where userId in (select userId from g_users)""",
        ("mr", "g_users"),
    ),
    "g_cases": (
        f"select n_given, userId, movieId, rating, pos <= n_given as given from g_placed, {_SIZES} where total > n_given + 5",
        ("g_placed",),
    ),
    **_baseline_ctes("g_train", "g_cases", "g_"),
}


def _general_users(t):
    return t.stored("test-members", lambda: protocol.split_users(t.model_ratings(), share=_TEST_SHARE))


def _general_train(t):
    return t.stored("train-ratings", lambda: protocol.train_ratings(t.model_ratings(), _general_users(t)))


def _one_size(t, n: int = 10):
    """Shown and held ratings of the test members, at one history size."""
    held = t.model_ratings().join(_general_users(t), "userId", "left_semi")
    cases = written(protocol.history_cases(held, (n,)), "cases")
    return cases.where("given").drop("given"), cases.where(~F.col("given")).drop("given")


def _scored(t, model):
    """One model on every test member's held films, ten ratings shown."""
    fitted = model.fit(_general_train(t))
    given, held = _one_size(t)
    scored = fitted.score(given, held, ["n_given", "userId"])
    return scored.select("userId", "movieId", "rating", *r6("score"))


def _ten_sql(score: str) -> str:
    return statement(
        f"select userId, movieId, rating, round({score}, 6) as score from g_base where n_given = 10",
        "g_base",
        extra=_GENERAL_SPLIT,
    )


@query("model_user_mean", _ten_sql("um"))
def model_user_mean(t):
    return _scored(t, models.UserMean())


@query("model_item_mean", _ten_sql("im"))
def model_item_mean(t):
    return _scored(t, models.ItemMean())


@query("model_bias", _ten_sql("im + bu10"))
def model_bias(t):
    return _scored(t, models.BiasModel(user_prior=10.0))


_RESIDUALS = {
    **_ITEM_BIAS,
    "after": (
        "select userId, movieId, rating - mu - bias as a from mr join ib using (movieId), mu where n >= 20",
        ("mr", "ib", "mu"),
    ),
}


@query(
    "mf_residuals",
    statement(
        """select userId, movieId, round(a - bu, 6) as residual from after
           join (select userId, sum(a) / (count(*) + 10.0::double) as bu from after group by 1) using (userId)""",
        "after",
        extra=_RESIDUALS,
    ),
)
def mf_residuals(t):
    return models.mf_residuals(t.model_ratings()).select("userId", "movieId", *r6("residual"))


@query("item_factors")
def item_factors(t):
    table = models.item_factors(t.model_ratings(), n_factors=64, iterations=4)
    return table.select(
        "movieId", "n_ratings", *r6("item_mean"), F.transform("factors", lambda x: F.round(x, 6)).alias("factors")
    )


@query(
    "item_factors_gram",
    "select i::integer as i, j::integer as j, (i = j)::integer::double as gram from range(64) a(i), range(64) b(j)",
)
def item_factors_gram(t):
    """Inner products of the latent dimensions over all films: they are orthonormal."""
    table = models.item_factors(t.model_ratings()).select(F.col("factors").alias("vec"))
    gram = linear.self_gram(table, dimension(table, "vec"))
    rows = [(i, j, round(float(x), 6) + 0.0) for i, line in enumerate(gram) for j, x in enumerate(line)]
    return t.spark.createDataFrame(rows, "i int, j int, gram double")


@query("model_biased_mf")
def model_biased_mf(t):
    return _scored(t, models.BiasedMF(n_factors=64, iterations=4))


@query(
    "mf_fold_gradient",
    statement(
        """select c.userId, round(any_value(bu10), 6) as bu, count(k.movieId) as known, count(k.movieId) >= 3 as folded,
                  case when count(k.movieId) >= 3 then 0.0::double end as gradient
           from g_cases c join g_hist h on h.n_given = c.n_given and h.userId = c.userId
           left join (select movieId from g_train group by 1 having count(*) >= 20) k on k.movieId = c.movieId
           where c.n_given = 10 and c.given group by 1""",
        "g_cases",
        "g_hist",
        "g_train",
        extra=_GENERAL_SPLIT,
    ),
)
def mf_fold_gradient(t):
    """Every history's latent vector solves its own ridge: no slope of the penalised error is left."""
    model = models.BiasedMF(n_factors=64, iterations=4).fit(_general_train(t))
    given, _ = _one_size(t)
    by = ["n_given", "userId"]
    history = given.join(model.fold_in(given, by), by).join(model.items, "movieId", "left")
    error = (
        F.col("rating") - model.mean - F.coalesce("bias", F.lit(0.0)) - F.col("bu")
        - dot("factor", "taste", model.width)
    )
    slopes = [
        F.abs(F.sum(F.col("error") * F.col("factor")[i]) - model.reg * F.any_value(F.col("taste")[i]))
        for i in range(model.width)
    ]
    return history.withColumn("error", error).groupBy("userId").agg(
        F.round(F.any_value("bu"), 6).alias("bu"),
        F.count("factor").alias("known"),
        F.any_value(F.col("taste").isNotNull()).alias("folded"),
        F.round(F.greatest(*slopes), 6).alias("gradient"),
    )


# -- the content tower -----------------------------------------------------------------

_D = 64


def _vec_sum(weight: str) -> str:
    """Weighted sum of unit vectors: the list of its 64 parts."""
    return "[" + ", ".join(f"sum({weight} * vec[{i + 1}])" for i in range(_D)) + "]"


def _tower_ctes(train: str, shown: str, held: str, candidate: str, history: str) -> dict:
    """Histories -> profiles -> scores. ``candidate`` / ``history``: bias of a film."""
    return {
        "t_mu": (f"select avg(rating) as mu from {train}", (train,)),
        "t_ib": (
            f"select movieId, count(*) as n, (sum(rating) - count(*) * any_value(mu)) / (count(*) + 20.0::double) as bias from {train}, t_mu group by 1",
            (train, "t_mu"),
        ),
        "t_res": (
            f"""select s.*, s.rating - mu - coalesce({history}, 0) as res, v.vec from {shown} s
                left join t_ib using (movieId) left join t_lent l using (movieId) left join unit_vecs v using (movieId), t_mu""",
            (shown, "t_ib", "t_lent", "unit_vecs", "t_mu"),
        ),
        "t_bu": (
            "select n_given, userId, sum(res) / (count(*) + 10.0::double) as bu, count(vec) as known from t_res group by 1, 2",
            ("t_res",),
        ),
        "t_profile": (
            f"""select r.n_given, r.userId, any_value(bu) as bu, {_vec_sum('(res - bu) / known')} as p
                from t_res r join t_bu using (n_given, userId) where vec is not null group by 1, 2""",
            ("t_res", "t_bu"),
        ),
        "t_score": (
            f"""select h.*, t_ib.bias is not null as known, mu + coalesce({candidate}, 0) + coalesce(b.bu, 0)
                       + coalesce(list_dot_product(p.p, v.vec), 0) as score
                from {held} h left join t_ib using (movieId) left join t_lent l using (movieId)
                left join unit_vecs v using (movieId)
                left join t_bu b on b.n_given = h.n_given and b.userId = h.userId
                left join t_profile p on p.n_given = h.n_given and p.userId = h.userId, t_mu""",
            (held, "t_ib", "t_lent", "unit_vecs", "t_bu", "t_profile", "t_mu"),
        ),
    }


_NO_LENDER = {"t_lent": ("select null::bigint as movieId, null::double as lent", ())}
_SHOWN_TEN = {
    **_GENERAL_SPLIT,
    "shown10": ("select n_given, userId, movieId, rating from g_cases where n_given = 10 and given", ("g_cases",)),
    "held10": ("select n_given, userId, movieId, rating from g_cases where n_given = 10 and not given", ("g_cases",)),
}
_TOWER = {**_SHOWN_TEN, **_NO_LENDER, **_tower_ctes("g_train", "shown10", "held10", "t_ib.bias", "t_ib.bias")}


def _tower(t, **options):
    settings = {"learn_weights": False, "learn_bias": False, **options}
    return models.ContentTower(t.vectors(), **settings)


@query(
    "unit_vectors",
    statement(
        f"""select movieId, dimension, round(vec[dimension + 1], 6) + 0.0::double as value, round(list_dot_product(vec, vec), 6) as length
           from unit_vecs, (select unnest(range({_D}))::integer as dimension)""",
        "unit_vecs",
    ),
)
def unit_vectors_query(t):
    unit = written(unit_vectors(t.vectors()), "unit-vectors")
    return unit.select(
        "movieId",
        F.round(dot("vec", "vec", dimension(unit, "vec")), 6).alias("length"),
        F.posexplode("vec").alias("dimension", "value"),
    ).select("movieId", "dimension", *r6("value"), "length")


@query(
    "content_profile",
    statement(
        f"""select b.userId, b.known as known_films, round(b.bu, 6) as bu, dimension, round(coalesce(p.p[dimension + 1], 0), 6) + 0.0::double as value,
                  round(coalesce(sqrt(list_dot_product(p.p, p.p)), 0), 6) as norm
           from t_bu b left join t_profile p on p.userId = b.userId and p.n_given = b.n_given,
                (select unnest(range({_D}))::integer as dimension)""",
        "t_bu",
        "t_profile",
        extra=_TOWER,
    ),
)
def content_profile(t):
    tower = _tower(t).fit(_general_train(t))
    given, _ = _one_size(t)
    profiles = tower.profiles(given, ["n_given", "userId"])
    return profiles.select(
        "userId",
        "known_films",
        *r6("bu"),
        F.round(F.sqrt(dot("profile", "profile", tower.d)), 6).alias("norm"),
        F.posexplode("profile").alias("dimension", "value"),
    ).select("userId", "known_films", "bu", "dimension", *r6("value"), "norm")


@query(
    "model_tower",
    statement("select userId, movieId, rating, round(score, 6) as score from t_score", "t_score", extra=_TOWER),
)
def model_tower(t):
    return _scored(t, _tower(t))


# strategies for missing biases: crowd A without a fifth of its films, crowd B lends

_COLD = {
    "cold": (
        """select movieId from (
             select movieId, row_number() over (order by md5(concat_ws(':', movieId, '0'))) as r, count(*) over () as n
             from (select movieId from mr_a group by 1 having count(*) >= 5)) where r <= round_even(0.2::double * n, 0)""",
        ("mr_a",),
    ),
    "warm_a": ("select * from mr_a where movieId not in (select movieId from cold)", ("mr_a", "cold")),
    "mu_a": ("select avg(rating) as mu from warm_a", ("warm_a",)),
    "ib_a": (
        "select movieId, count(*) as n, (sum(rating) - count(*) * any_value(mu)) / (count(*) + 20.0::double) as bias from warm_a, mu_a group by 1",
        ("warm_a", "mu_a"),
    ),
    "mu_b": ("select avg(rating) as mu from mr_b", ("mr_b",)),
    "ib_b": (
        "select movieId, (sum(rating) - count(*) * any_value(mu)) / (count(*) + 20.0::double) as lent from mr_b, mu_b group by 1",
        ("mr_b", "mu_b"),
    ),
    "line": (
        """select count(*) as films, corr(lent, bias) as corr, regr_slope(bias, lent) as slope, regr_intercept(bias, lent) as intercept
           from ib_a join ib_b using (movieId) where n >= 20""",
        ("ib_a", "ib_b"),
    ),
}


def _warm_a(t):
    ratings = t.crowd_a()
    cold = protocol.cold_items(ratings)
    return ratings.join(cold, "movieId", "left_anti")


def _lent(t, test_users=None):
    """The second crowd's biases. Both crowds hold the same members: test members lend nothing."""
    lender = t.crowd_b() if test_users is None else protocol.train_ratings(t.crowd_b(), test_users)
    return crowd.item_bias(lender).select("movieId", F.col("bias").alias("lent"))


def _biases(t, strategy, **options):
    tower = _tower(t, item_bias=strategy, **options).fit(_warm_a(t))
    wanted = t.raw("part").select(F.col("p_partkey").alias("movieId"))
    return wanted.join(tower.items, "movieId", "left").select(
        "movieId",
        F.round(F.coalesce("candidate_bias", F.lit(0.0)), 6).alias("candidate"),
        F.round(F.coalesce("history_bias", F.lit(0.0)), 6).alias("history"),
    )


@query(
    "bias_known",
    statement(
        "select p_partkey as movieId, round(coalesce(bias, 0), 6) as candidate, round(coalesce(bias, 0), 6) as history from part left join ib_a on movieId = p_partkey",
        "ib_a",
        extra=_COLD,
    ),
)
def bias_known(t):
    return _biases(t, models.KNOWN)


@query(
    "bias_none",
    statement(
        "select p_partkey as movieId, 0.0::double as candidate, round(coalesce(bias, 0), 6) as history from part left join ib_a on movieId = p_partkey",
        "ib_a",
        extra=_COLD,
    ),
)
def bias_none(t):
    return _biases(t, models.NONE)


@query(
    "bias_borrowed",
    statement(
        """select p_partkey as movieId, round(coalesce(bias, intercept + slope * lent, 0), 6) as candidate,
                  round(coalesce(bias, intercept + slope * lent, 0), 6) as history
           from part left join ib_a a on a.movieId = p_partkey left join ib_b b on b.movieId = p_partkey, line""",
        "ib_a",
        "ib_b",
        "line",
        extra=_COLD,
    ),
)
def bias_borrowed(t):
    return _biases(t, models.BORROWED, borrowed=_lent(t))


@query(
    "history_vs_candidate",
    statement(
        """select p_partkey as movieId, 0.0::double as candidate, round(coalesce(bias, intercept + slope * lent, 0), 6) as history
           from part left join ib_a a on a.movieId = p_partkey left join ib_b b on b.movieId = p_partkey, line""",
        "ib_a",
        "ib_b",
        "line",
        extra=_COLD,
    ),
)
def history_vs_candidate(t):
    """Ranking without any crowd bias still reads the history with the best there is."""
    return _biases(t, models.NONE, borrowed=_lent(t))


@query("bias_predicted")
def bias_predicted(t):
    return _biases(t, models.PREDICTED, learn_bias=True)


@query(
    "borrow_calibration",
    statement(
        "select films, round(corr, 6) as corr, round(slope, 6) as slope, round(intercept, 6) as intercept from line",
        "line",
        extra=_COLD,
    ),
)
def borrow_calibration(t):
    table = models.borrow_calibration(crowd.item_bias(_warm_a(t)), _lent(t))
    return table.select("films", *r6("corr", "slope", "intercept"))


@query(
    "knows_crowd",
    statement(
        "select p_partkey as movieId, p_partkey in (select movieId from ib_a) as known from part", "ib_a", extra=_COLD
    ),
)
def knows_crowd(t):
    tower = _tower(t).fit(_warm_a(t))
    wanted = t.raw("part").select(F.col("p_partkey").alias("movieId"))
    return wanted.join(tower.items, "movieId", "left").select(
        "movieId", F.coalesce("crowd_knows", F.lit(False)).alias("known")
    )


@query("taste_weights")
def taste_weights(t):
    """Learned weight of every content dimension."""
    tower = _tower(t, learn_weights=True).fit(t.model_ratings())
    weights = F.array(*[F.lit(float(w)) for w in tower.weights])
    one = t.model_ratings().agg(F.count(F.lit(1)).alias("ratings"))
    return one.select("ratings", F.posexplode(weights).alias("dimension", "weight")).select(
        "ratings", "dimension", *r6("weight")
    )


@query(
    "bias_sweep",
    statement(
        """select bias_weight, count(*) as n, round(sqrt(avg(power(rating - s, 2))), 6) as rmse, round(avg(s), 6) as mean_score
           from (select rating, w as bias_weight, score - coalesce(bias, 0) + w * coalesce(bias, 0) as s
                 from t_score left join t_ib using (movieId), (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as w))
           group by 1""",
        "t_score",
        "t_ib",
        extra=_TOWER,
    ),
)
def bias_sweep(t):
    tower = _tower(t, bias_weight=0.0).fit(_general_train(t))
    given, held = _one_size(t)
    scored = tower.score(given, held, ["n_given", "userId"]).withColumnRenamed("score", "without_bias")
    base = scored.join(tower.items.select("movieId", "candidate_bias"), "movieId", "left").na.fill(
        0.0, ["candidate_bias"]
    )
    swept = models.bias_sweep(base, (0.0, 0.25, 0.5, 0.75, 1.0))
    error = F.col("rating") - F.col("score")
    return swept.groupBy("bias_weight").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )


# -- ranking -------------------------------------------------------------------------

_SCORES = {
    "scored": (
        f"""select tmdb_id, title, vote_count, {band('vote_count')} as band,
                   round((vote_count * vote_average + 325.0::double) / (vote_count + 50), 9) as score from catalogue""",
        ("catalogue",),
    )
}
_PICK = "select tmdb_id, band, round(score, 6) as score from "


def _score_catalogue(t):
    shrunk = num.crowd_shrunk(F.col("vote_average"), F.col("vote_count"))
    return ranking.with_band(t.catalogue().withColumn("score", shrunk))


def _picked(frame):
    return frame.select("tmdb_id", "band", *r6("score"))


@query("rec_plain", statement(_PICK + "scored order by scored.score desc, tmdb_id limit 20", "scored", extra=_SCORES))
def rec_plain(t):
    return _picked(ranking.plain(_score_catalogue(t), 20))


@query(
    "rec_stratified",
    statement(
        _PICK
        + """(select *, row_number() over (order by late, score desc, tmdb_id) as r from (
               select *, row_number() over (partition by band order by score desc, tmdb_id) > 2 as late from scored)) s
             where r <= 20""",
        "scored",
        extra=_SCORES,
    ),
)
def rec_stratified(t):
    return _picked(ranking.stratified(_score_catalogue(t), 20))


_CALIBRATED = {
    **_SCORES,
    "sided": (
        """select *, band in ('0', '1-4', '5-19', '20-99') as tail,
                  row_number() over (partition by band in ('0', '1-4', '5-19', '20-99') order by score desc, tmdb_id) as r from scored""",
        ("scored",),
    ),
}


@query(
    "rec_calibrated",
    statement(
        _PICK + "sided where (tail and r <= 8) or (not tail and r <= 20 - least(8, (select count(*) from sided where tail)))",
        "sided",
        extra=_CALIBRATED,
    ),
)
def rec_calibrated(t):
    return _picked(ranking.calibrated(_score_catalogue(t), 20, 0.4))


@query(
    "rec_bands",
    statement(
        f"select {band_no('vote_count')} as band_no, band, count(*) as films from (select * from scored order by score desc, tmdb_id limit 100) group by all",
        "scored",
        extra=_SCORES,
    ),
)
def rec_bands(t):
    return ranking.bands_of(ranking.plain(_score_catalogue(t), 100))


_INTERLEAVE = {
    **_SHOWN_TEN,
    **_COLD,
    **_ITEM_BIAS,
    "ranked_in": (
        "select h.userId, h.movieId, h.rating, a.movieId is not null as known, h.rating + coalesce(a.bias, 0) as score "
        "from held10 h left join ib_a a on a.movieId = h.movieId",
        ("held10", "ib_a"),
    ),
}


@query(
    "interleave",
    statement(
        """select userId, movieId, known,
                  round(-(row_number() over (partition by userId, known order by round(score, 9) desc, md5(concat_ws(':', movieId, '0'))) - 0.5::double)
                        / count(*) over (partition by userId, known), 6) as rank_score
           from ranked_in""",
        "ranked_in",
        extra=_INTERLEAVE,
    ),
)
def interleave(t):
    _, held = _one_size(t)
    biases = crowd.item_bias(_warm_a(t)).select("movieId", "bias")
    scored = held.join(biases, "movieId", "left").select(
        "userId",
        "movieId",
        F.col("bias").isNotNull().alias("known"),
        (F.col("rating") + F.coalesce("bias", F.lit(0.0))).alias("score"),
    )
    return ranking.interleave(scored, ["userId"]).select("userId", "movieId", "known", *r6("rank_score"))


@query(
    "average_rank",
    statement(
        "select userId, movieId, rank() over (partition by userId order by rating) + (count(*) over (partition by userId, rating) - 1) / 2.0::double as place from mr",
        "mr",
    ),
)
def average_rank_query(t):
    spread = reports.star_ranges(F.col("rating"))
    return average_rank(t.model_ratings(), ["userId"], "rating", "place", spread).select("userId", "movieId", "place")


# -- protocols ---------------------------------------------------------------------------

_SPLIT = {
    "test_users": (_chosen("mr_a"), ("mr_a",)),
    "train": ("select * from mr_a where userId not in (select userId from test_users)", ("mr_a", "test_users")),
    "cold_train": (
        "select * from train where movieId not in (select movieId from cold)",
        ("train", "cold"),
    ),
    "c_placed": (
        f"""select *, row_number() over (partition by userId, cold order by {_seeded()}, movieId) as pos,
                   count(*) filter (where not cold) over (partition by userId) as warm, count(*) filter (where cold) over (partition by userId) as colds
            from (select *, movieId in (select movieId from cold) as cold from mr_a where userId in (select userId from test_users))""",
        ("mr_a", "test_users", "cold"),
    ),
    "c_cases": (
        f"select n_given, userId, movieId, rating, cold, not cold and pos <= n_given as given from c_placed, {_SIZES} where warm >= n_given + 5 and colds > 0",
        ("c_placed",),
    ),
    "c_shown": ("select * from c_cases where given", ("c_cases",)),
    "c_held": ("select * from c_cases where not given", ("c_cases",)),
}
_PROTOCOL = {**_COLD, **_SPLIT}


def _test_users(t):
    return protocol.split_users(t.crowd_a(), share=_TEST_SHARE)


@query(
    "split_users",
    statement(
        """select 'test' as part, count(*) as users, sum(userId)::bigint as ids from g_users
           union all select 'train', count(distinct userId), sum(distinct userId)::bigint from g_train""",
        "g_users",
        "g_train",
        extra=_GENERAL_SPLIT,
    ),
)
def split_users(t):
    test = _general_users(t)
    train = _general_train(t).select("userId").distinct()
    count = lambda frame, part: frame.agg(
        F.lit(part).alias("part"), F.count(F.lit(1)).alias("users"), F.sum("userId").alias("ids")
    )
    return count(test, "test").unionByName(count(train, "train"))


@query("cold_items", statement("select movieId from cold", "cold", extra=_COLD))
def cold_items(t):
    return protocol.cold_items(t.crowd_a())


def _clip(x: str) -> str:
    return f"greatest(0.5::double, least(5.0::double, {x}))"


def _four(base: str, columns: str) -> str:
    parts = (("user_mean", "um"), ("item_mean", "im"), ("bias", "im + bu"), ("bias_u10", "im + bu10"))
    return " union all ".join(
        f"select '{name}' as model, {columns}, {_clip(expr)} as predicted, round({_clip(expr)}, 9) as ranked from {base}"
        for name, expr in parts
    )


_GENERAL = {
    **_GENERAL_SPLIT,
    "g_pred": (_four("g_base", "n_given, userId, movieId, rating"), ("g_base",)),
    "g_metrics": (
        """select model, n_given, userId, count(*) as n, sqrt(avg(power(rating - predicted, 2))) as rmse, avg(abs(rating - predicted)) as mae
           from g_pred group by 1, 2, 3""",
        ("g_pred",),
    ),
}


def _baselines():
    return [models.UserMean(), models.ItemMean(), models.BiasModel(), models.BiasModel(user_prior=10.0)]


def _generalised(t):
    return protocol.evaluate_generalisation(_baselines(), t.model_ratings(), _general_users(t), HISTORY_SIZES)


@query(
    "eval_generalise",
    statement(
        "select model, n_given, userId, n, round(rmse, 6) as rmse, round(mae, 6) as mae from g_metrics",
        "g_metrics",
        extra=_GENERAL,
    ),
)
def eval_generalise(t):
    per_user = _generalised(t)
    return per_user.select("model", "n_given", "userId", "n", *r6("rmse", "mae"))


_BORROWED_TOWER = _tower_ctes(
    "cold_train", "c_shown", "c_held", "coalesce(t_ib.bias, t_line.intercept + t_line.slope * l.lent)",
    "coalesce(t_ib.bias, t_line.intercept + t_line.slope * l.lent)",
)


def _with_line(ctes: dict) -> dict:
    """Make the calibration line visible beside the global mean."""
    out = dict(ctes)
    out["t_line"] = (
        """select regr_slope(bias, lent) as slope, regr_intercept(bias, lent) as intercept from t_ib join t_lent using (movieId) where n >= 20""",
        ("t_ib", "t_lent"),
    )
    for name in ("t_res", "t_score"):
        sql, deps = out[name]
        out[name] = (sql.replace(", t_mu", ", t_mu, t_line"), (*deps, "t_line"))
    return out


_COLD_EVAL = {
    **_PROTOCOL,
    "mr_lent": ("select * from mr_b where userId not in (select userId from test_users)", ("mr_b", "test_users")),
    "mu_lent": ("select avg(rating) as mu from mr_lent", ("mr_lent",)),
    "t_lent": (
        "select movieId, (sum(rating) - count(*) * any_value(mu)) / (count(*) + 20.0::double) as lent from mr_lent, mu_lent group by 1",
        ("mr_lent", "mu_lent"),
    ),
    **_with_line(_BORROWED_TOWER),
    **_baseline_ctes("cold_train", "c_cases", "c_"),
    "c_pred": (
        _four("c_base", "n_given, userId, movieId, rating, cold")
        + f""" union all select 'tower_borrowed', n_given, userId, movieId, rating, cold, {_clip('score')}, round({_clip('score')}, 9) from t_score
               union all select 'stratified_tower_borrowed', n_given, userId, movieId, rating, cold, {_clip('score')},
                 round(-(row_number() over (partition by n_given, userId, known order by round(score, 9) desc, md5(concat_ws(':', movieId, '0'))) - 0.5::double)
                       / count(*) over (partition by n_given, userId, known), 9) from t_score""",
        ("c_base", "t_score"),
    ),
    "c_errors": (
        """select model, n_given, userId, avg(cold::int::double) as cold_share, count(*) as n, sqrt(avg(power(rating - predicted, 2))) as rmse,
                  avg(abs(rating - predicted)) as mae, sqrt(avg(power(rating - predicted, 2)) filter (where cold)) as rmse_cold,
                  sqrt(avg(power(rating - predicted, 2)) filter (where not cold)) as rmse_warm from c_pred group by 1, 2, 3""",
        ("c_pred",),
    ),
    "c_rho": (spearman("c_pred", "model, n_given, userId", "rating", "ranked", "spearman"), ("c_pred",)),
    "c_tail": (
        """select model, n_given, userId, avg(cold::int::double) filter (where r1 <= 10) as tail_share, avg(cold::int::double) filter (where r2 <= 10) as tail_share_actual
           from (select *, row_number() over (partition by model, n_given, userId order by ranked desc, md5(concat_ws(':', movieId, '0'))) as r1,
                        row_number() over (partition by model, n_given, userId order by rating desc, md5(concat_ws(':', movieId, '0'))) as r2 from c_pred)
           group by 1, 2, 3""",
        ("c_pred",),
    ),
    "c_metrics": (
        "select * from c_errors join c_rho using (model, n_given, userId) join c_tail using (model, n_given, userId)",
        ("c_errors", "c_rho", "c_tail"),
    ),
}
_METRIC_COLUMNS = ("cold_share", "rmse", "mae", "rmse_cold", "rmse_warm", "spearman", "tail_share", "tail_share_actual")


def _cold_models(t):
    """Baselines, the borrowing tower, and the same tower ranked in strata."""
    options = {"item_bias": models.BORROWED, "borrowed": _lent(t, _test_users(t))}
    tower = _tower(t, **options)
    return [*_baselines(), tower, models.StratifiedRanker(tower)]


def _cold_per_user(t):
    ratings = t.crowd_a()
    return protocol.evaluate_cold(
        _cold_models(t), ratings, _test_users(t), protocol.cold_items(ratings), HISTORY_SIZES
    )


@query(
    "eval_cold",
    statement(
        "select model, n_given, userId, n, "
        + ", ".join(f"round({c}, 6) as {c}" for c in _METRIC_COLUMNS)
        + " from c_metrics",
        "c_metrics",
        extra=_COLD_EVAL,
    ),
)
def eval_cold(t):
    return _cold_per_user(t).select("model", "n_given", "userId", "n", *r6(*_METRIC_COLUMNS))


@query(
    "stratified_rank",
    statement(
        """select n_given, userId, movieId, known, round(score, 6) as score,
                  round(-(row_number() over (partition by n_given, userId, known order by round(score, 9) desc, md5(concat_ws(':', movieId, '0'))) - 0.5::double)
                        / count(*) over (partition by n_given, userId, known), 6) as rank_score from t_score""",
        "t_score",
        extra=_COLD_EVAL,
    ),
)
def stratified_rank(t):
    ratings = t.crowd_a()
    cold, test = protocol.cold_items(ratings), _test_users(t)
    tower = _tower(t, item_bias=models.BORROWED, borrowed=_lent(t, test))
    tower.fit(written(protocol.train_ratings(ratings, test, cold), "train"))
    cases = written(
        protocol.cold_cases(ratings.join(test, "userId", "left_semi"), cold, HISTORY_SIZES), "cases"
    )
    by = ["n_given", "userId"]
    scored = tower.score_with_known(
        cases.where("given").drop("given"), cases.where(~F.col("given")).drop("given"), by
    )
    return ranking.interleave(written(scored, "scores"), by).select(*by, "movieId", "known", *r6("score", "rank_score"))


def _cold_targets(t):
    """Held films of the cold protocol ranked by their shrunk item mean."""
    ratings = t.crowd_a()
    cold, test = protocol.cold_items(ratings), _test_users(t)
    model = models.ItemMean().fit(protocol.train_ratings(ratings, test, cold))
    cases = protocol.cold_cases(ratings.join(test, "userId", "left_semi"), cold, HISTORY_SIZES)
    return protocol.score_cases([model], written(cases, "cases"))


@query(
    "cold_cases",
    statement("select n_given, userId, movieId, rating, cold, given from c_cases", "c_cases", extra=_PROTOCOL),
)
def cold_cases(t):
    ratings = t.crowd_a()
    held = ratings.join(_test_users(t), "userId", "left_semi")
    return protocol.cold_cases(held, protocol.cold_items(ratings), HISTORY_SIZES)


@query(
    "tail_share_topk",
    statement(
        """select model, n_given, userId, round(tail_share, 6) as tail_share, round(tail_share_actual, 6) as tail_share_actual
           from c_tail where model = 'item_mean'""",
        "c_tail",
        extra=_COLD_EVAL,
    ),
)
def tail_share_topk(t):
    shares = protocol.tail_shares(_cold_targets(t))
    return shares.select("model", "n_given", "userId", *r6("tail_share", "tail_share_actual"))


@query(
    "user_metrics",
    statement(
        "select model, n_given, userId, n, "
        + ", ".join(f"round({c}, 6) as {c}" for c in _METRIC_COLUMNS)
        + " from c_metrics where model = 'item_mean'",
        "c_metrics",
        extra=_COLD_EVAL,
    ),
)
def user_metrics(t):
    return protocol.user_metrics(_cold_targets(t)).select("model", "n_given", "userId", "n", *r6(*_METRIC_COLUMNS))


@query(
    "summarise",
    statement(
        """select model, n_given, count(distinct userId) as users, round(avg(rmse), 6) as rmse, round(stddev_samp(rmse), 6) as rmse_sd
           from g_metrics group by 1, 2""",
        "g_metrics",
        extra=_GENERAL,
    ),
)
def summarise(t):
    per_user = _generalised(t)
    return protocol.summarise(per_user).select("model", "n_given", "users", *r6("rmse", "rmse_sd"))


@query(
    "learning_curve_pivot",
    statement(
        """select model, round(avg(rmse) filter (where n_given = 5), 6) as n_5, round(avg(rmse) filter (where n_given = 10), 6) as n_10,
                  round(avg(rmse) filter (where n_given = 20), 6) as n_20 from g_metrics group by 1""",
        "g_metrics",
        extra=_GENERAL,
    ),
)
def learning_curve_pivot(t):
    per_user = _generalised(t)
    curve = protocol.learning_curve(protocol.summarise(per_user), sizes=HISTORY_SIZES)
    return curve.select("model", *r6("n_5", "n_10", "n_20"))


@query(
    "frontier",
    statement(
        """select model, n_given, users, round(rho, 6) as spearman, round(ts, 6) as tail_share, round(deserved, 6) as deserved,
                  round(ts / deserved, 6) as fairness, fair,
                  fair and row_number() over (partition by n_given, fair order by round(rho, 9) desc, model) = 1 as best
           from (select *, round(ts / deserved, 9) >= 0.9 as fair from (
             select model, n_given, count(distinct userId) as users, avg(spearman) as rho, avg(tail_share) as ts, avg(tail_share_actual) as deserved
             from c_metrics group by 1, 2))""",
        "c_metrics",
        extra=_COLD_EVAL,
    ),
)
def frontier(t):
    table = protocol.frontier(_cold_per_user(t))
    return table.select(
        "model", "n_given", "users", *r6("spearman", "tail_share", "deserved", "fairness"), "fair", "best"
    )


_SWEPT = (0.0, 0.25, 0.5, 0.75, 1.0)
_SWEPT_NAMES = ", ".join(f"({w}::double, 'tower_borrowed{'' if w == 1 else f'_b{w:g}'}')" for w in _SWEPT)
_SWEEP = {
    **_COLD_EVAL,
    "c_lent": (
        """select movieId, coalesce(t_ib.bias, t_line.intercept + t_line.slope * lent, 0.0::double) as c
           from t_ib full join t_lent using (movieId), t_line""",
        ("t_ib", "t_lent", "t_line"),
    ),
    "c_pred": (
        f"""select model, n_given, userId, movieId, rating, cold, {_clip('s')} as predicted, round({_clip('s')}, 9) as ranked
            from (select t_score.*, model, score + (w - 1) * coalesce(c, 0) as s
                  from t_score left join c_lent using (movieId), (values {_SWEPT_NAMES}) as sweep(w, model))""",
        ("t_score", "c_lent"),
    ),
}


@query(
    "frontier_sweep",
    statement(
        """select model, n_given, users, round(rmse, 6) as rmse, round(rho, 6) as spearman, round(ts, 6) as tail_share,
                  round(deserved, 6) as deserved, round(ts / deserved, 6) as fairness, fair,
                  fair and row_number() over (partition by n_given, fair order by round(rho, 9) desc, model) = 1 as best
           from (select *, round(ts / deserved, 9) >= 0.9 as fair from (
             select model, n_given, count(distinct userId) as users, avg(rmse) as rmse, avg(spearman) as rho, avg(tail_share) as ts,
                    avg(tail_share_actual) as deserved from c_metrics group by 1, 2))""",
        "c_metrics",
        extra=_SWEEP,
    ),
)
def frontier_sweep(t):
    """From ranking by the crowd to ranking by taste alone: accuracy against fairness on hidden films."""
    ratings, vectors = t.crowd_a(), t.vectors()
    # every tower reads them: written, they stay out of each tower's plan
    test = written(_test_users(t), "test-users")
    lent = written(_lent(t, test), "lent")
    towers = [
        models.ContentTower(
            vectors, item_bias=models.BORROWED, borrowed=lent, bias_weight=w, learn_weights=False, learn_bias=False
        )
        for w in _SWEPT
    ]
    per_user = written(
        protocol.evaluate_cold(towers, ratings, test, protocol.cold_items(ratings), HISTORY_SIZES), "per-user"
    )
    errors = protocol.summarise(per_user).select("model", "n_given", "rmse")
    return protocol.frontier(per_user).join(errors, ["model", "n_given"]).select(
        "model", "n_given", "users", *r6("rmse", "spearman", "tail_share", "deserved", "fairness"), "fair", "best"
    )


@query("eval_cold_models")
def eval_cold_models(t):
    """Every kind of model on hidden films, at its defaults, in one scoring pass."""
    ratings, vectors = t.crowd_a(), t.vectors()
    # every tower reads them: written, they stay out of each tower's plan
    test = written(_test_users(t), "test-users")
    lent = written(_lent(t, test), "lent")
    towers = {name: models.ContentTower(vectors, item_bias=name) for name in (models.KNOWN, models.NONE, models.PREDICTED)}
    towers[models.BORROWED] = models.ContentTower(vectors, item_bias=models.BORROWED, borrowed=lent)
    everyone = [
        models.BiasModel(),
        models.BiasedMF(),
        *towers.values(),
        models.StratifiedRanker(towers[models.PREDICTED]),
        models.StratifiedRanker(towers[models.BORROWED]),
    ]
    per_user = protocol.evaluate_cold(everyone, ratings, test, protocol.cold_items(ratings), HISTORY_SIZES)
    return per_user.select("model", "n_given", "userId", "n", *r6(*_METRIC_COLUMNS))


@query("eval_generalise_models")
def eval_generalise_models(t):
    """Baselines, factors and the content tower on whole held-out users."""
    everyone = [
        models.UserMean(), models.ItemMean(), models.BiasModel(), models.BiasedMF(), models.ContentTower(t.vectors())
    ]
    per_user = protocol.evaluate_generalisation(everyone, t.model_ratings(), _general_users(t), HISTORY_SIZES)
    return per_user.select("model", "n_given", "userId", "n", *r6("rmse", "mae"))


# -- features ------------------------------------------------------------------------------

_FEATURES = {
    "feats": (
        """select tmdb_id, ln(1 + vote_count::double) as log_votes, year::double as year, runtime::double as runtime,
                  (vote_count * vote_average + 325.0::double) / (vote_count + 50) as crowd_shrunk, original_language,
                  lower(trim(overview || ' ' || tagline)) as synopsis, len(keywords)::double as n_keywords, len("cast")::double as n_cast,
                  len(directors)::double as n_directors, len(genres)::double as n_genres, length(overview)::double as overview_length,
                  array_to_string(list_transform(keywords, lambda x: replace(lower(trim(x)), ' ', '_')), ' ') as keywords,
                  array_to_string(list_transform("cast", lambda x: replace(lower(trim(x)), ' ', '_')), ' ') as "cast",
                  array_to_string(list_transform(genres, lambda x: replace(lower(trim(x)), ' ', '_')), ' ') as genres
           from catalogue""",
        ("catalogue",),
    )
}


@query(
    "film_features",
    statement(
        """select tmdb_id, genres, keywords, "cast", synopsis, original_language, year, runtime, round(log_votes, 6) as log_votes,
                  round(crowd_shrunk, 6) as crowd_shrunk, n_keywords, n_cast, n_directors, n_genres, overview_length from feats""",
        "feats",
        extra=_FEATURES,
    ),
)
def film_features(t):
    return features.film_features(t.catalogue()).select(
        "tmdb_id", "genres", "keywords", "cast", "synopsis", "original_language", "year", "runtime",
        *r6("log_votes", "crowd_shrunk"), "n_keywords", "n_cast", "n_directors", "n_genres", "overview_length",
    )


_TFIDF = {
    "tf": (
        """select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all(lower(text), '[^ ]+')) as term from documents) group by all""",
        (),
    ),
    "vocab": (
        """select term, ln((1.0::double + (select count(*) from documents)) / (1 + df)) + 1 as idf from (
             select term, count(*) as df, sum(tf) as total from tf group by 1 having count(*) >= 2) order by total desc, term limit 5000""",
        ("tf",),
    ),
    "weights": ("select doc_id, term, (1 + ln(tf::double)) * idf as w from tf join vocab using (term)", ("tf", "vocab")),
}


@query(
    "tfidf_block",
    statement(
        """select doc_id, count(*) as terms, round(sum(v), 6) as total, round(max(v), 6) as top
           from (select doc_id, w / sqrt(sum(w * w) over (partition by doc_id)) as v from weights) group by 1""",
        "weights",
        extra=_TFIDF,
    ),
)
def tfidf_block(t):
    docs = t.documents()
    block = features.TfIdf(features.TextSettings(max_features=5000, sublinear=True)).fit(docs)
    return block.transform(docs).groupBy(F.col("row").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max("value"), 6).alias("top")
    )


@query(
    "tfidf_vocabulary",
    statement("select term, round(idf, 6) as idf from vocab", "vocab", extra=_TFIDF),
)
def tfidf_vocabulary(t):
    block = features.TfIdf(features.TextSettings(max_features=5000, sublinear=True)).fit(t.documents())
    return block.vocabulary.select("term", *r6("idf"))


_TFIDF_WHOLE = _TFIDF | {
    "vocab": (
        """select term, ln((1.0::double + (select count(*) from documents)) / (1 + count(*))) + 1 as idf from tf
           group by 1 having count(*) >= 2""",
        ("tf",),
    ),
}


@query(
    "tfidf_block_whole",
    statement(
        """select doc_id, count(*) as terms, round(sum(v), 6) as total, round(max(v), 6) as top
           from (select doc_id, w / sqrt(sum(w * w) over (partition by doc_id)) as v from weights) group by 1""",
        "weights",
        extra=_TFIDF_WHOLE,
    ),
)
def tfidf_block_whole(t):
    """Weights over the whole vocabulary, as the operator does by default."""
    docs = t.documents()
    block = features.TfIdf(features.TextSettings(sublinear=True)).fit(docs)
    return block.transform(docs).groupBy(F.col("row").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max("value"), 6).alias("top")
    )


@query("tfidf_vocabulary_whole", statement("select term, round(idf, 6) as idf from vocab", "vocab", extra=_TFIDF_WHOLE))
def tfidf_vocabulary_whole(t):
    block = features.TfIdf(features.TextSettings(sublinear=True)).fit(t.documents())
    return block.vocabulary.select("term", *r6("idf"))


@query("text_svd")
def text_svd(t):
    """Standardised components of the documents' words and word pairs."""
    docs = t.documents()
    block = features.ReducedText(features.synopsis_settings(), 64).fit(docs)
    return block.transform(docs, "synopsis:").select("row", "term", *r6("value"))


_NUMERIC = features.NUMERIC_COLUMNS


@query(
    "text_svd_moments",
    "select 'synopsis:' || i as term, (select count(*) from documents) as n, 0.0::double as mean, 1.0::double as sd from range(64) x(i)",
)
def text_svd_moments(t):
    """Every component has mean 0 and deviation 1 over all documents."""
    docs = t.documents()
    block = features.ReducedText(features.synopsis_settings(), 64).fit(docs)
    stats = block.transform(docs, "synopsis:").groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd")
    )
    return stats.select("term", "n", (F.round("mean", 6) + 0.0).alias("mean"), *r6("sd"))


def _numeric_sql() -> str:
    filled = ", ".join(f"coalesce({c}, (select median({c}) from feats)) as {c}" for c in _NUMERIC)
    scaled = ", ".join(
        f"round(({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1), 6) as {c}" for c in _NUMERIC
    )
    return f"select tmdb_id, {scaled} from (select tmdb_id, {filled} from feats)"


@query("numeric_block", statement(_numeric_sql(), "feats", extra=_FEATURES))
def numeric_block(t):
    feats = features.film_features(t.catalogue())
    block = features.NumericBlock().fit(feats)
    return block.transform_wide(feats).select("tmdb_id", *r6(*_NUMERIC))


@query(
    "language_block",
    statement(
        """select tmdb_id as row, case when n >= 5 then 'language:' || lang else 'language:other' end as term, 1.0::double as value
           from (select tmdb_id, lang, count(*) over (partition by lang) as n
                 from (select tmdb_id, original_language || directors[1] as lang from catalogue))""",
        "catalogue",
    ),
)
def language_block(t):
    feats = t.catalogue().select(
        "tmdb_id", F.concat("original_language", F.col("directors")[0]).alias("original_language")
    )
    return features.LanguageBlock().fit(feats).transform(feats)


@query(
    "neutralise",
    statement(
        "select tmdb_id, round((select median(log_votes) from feats), 6) as log_votes, round(crowd_shrunk, 6) as crowd_shrunk from feats",
        "feats",
        extra=_FEATURES,
    ),
)
def neutralise(t):
    feats = features.film_features(t.catalogue())
    return features.neutralise_popularity(feats, feats).select("tmdb_id", *r6("log_votes", "crowd_shrunk"))


@query("item_vectors")
def item_vectors(t):
    vectors = metadata.item_vectors(t.catalogue())
    return vectors.select("movieId", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query("archive_vectors")
def archive_vectors(t):
    """The same kind of vectors under the archive's film numbers, catalogue blocks only."""
    links = archive.bridge(t.links())
    rekeyed = metadata.archive_vectors(t.catalogue(), links, blocks=features.CATALOGUE_BLOCKS)
    return rekeyed.select("movieId", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


# -- personal models --------------------------------------------------------------------------

_REPEATS = 3
_HOUSE = {
    "h": (
        """select tmdb_id as row, rating, (vote_count * vote_average + 325.0::double) / (vote_count + 50) as crowd_shrunk,
                  ln(1 + vote_count::double) as log_votes from house""",
        ("house",),
    ),
    "placed_h": (
        f"""select *, (row_number() over (partition by repeat order by md5(concat_ws(':', row, repeat)), row) - 1) % 5 as fold
            from h, (select unnest(range({_REPEATS})) as repeat)""",
        ("h",),
    ),
    "floor_pred": (
        """select 'global_mean' as model, repeat, fold::integer as fold, row, rating as actual, log_votes,
                  (sum(rating) over (partition by repeat) - sum(rating) over (partition by repeat, fold))
                  / (count(*) over (partition by repeat) - count(*) over (partition by repeat, fold)) as predicted
           from placed_h""",
        ("placed_h",),
    ),
    "crowd_lines": (
        """select f.repeat, f.fold, regr_slope(rating, crowd_shrunk) as s, regr_intercept(rating, crowd_shrunk) as i
           from placed_h h join (select distinct repeat, fold from placed_h) f on f.repeat = h.repeat and f.fold <> h.fold group by 1, 2""",
        ("placed_h",),
    ),
    "cv": (
        """select model, repeat, row, actual, round(predicted, 9) as predicted, log_votes from floor_pred
           union all select 'crowd_score', repeat, row, rating, round(s * crowd_shrunk + i, 9), log_votes
           from placed_h join crowd_lines using (repeat, fold)""",
        ("floor_pred", "placed_h", "crowd_lines"),
    ),
    "cv_rho": (spearman("cv", "model, repeat", "actual", "predicted", "spearman"), ("cv",)),
    "cv_bands": (
        f"select *, {band_no('(exp(log_votes) - 1)')} as band_no, {band('(exp(log_votes) - 1)')} as band from cv",
        ("cv",),
    ),
    "cv_band_rho": (spearman("cv_bands", "model, band_no, band", "actual", "predicted", "spearman"), ("cv_bands",)),
    "cv_by_band": (
        """select model, band_no, band, count(*) as n, sqrt(avg(power(actual - predicted, 2))) as rmse, avg(abs(actual - predicted)) as mae
           from cv_bands group by 1, 2, 3""",
        ("cv_bands",),
    ),
}


def _house(t):
    shrunk = num.crowd_shrunk(F.col("vote_average"), F.col("vote_count"))
    return t.house().select(
        F.col("tmdb_id").alias("row"),
        "tmdb_id",
        "rating",
        shrunk.alias("crowd_shrunk"),
        F.log1p(F.col("vote_count").cast("double")).alias("log_votes"),
    )


@query(
    "model_crowd_score",
    statement(
        """select row, round(rating, 6) as rating, round(regr_slope(rating, crowd_shrunk) over () * crowd_shrunk + regr_intercept(rating, crowd_shrunk) over (), 6) as predicted from h""",
        "h",
        extra=_HOUSE,
    ),
)
def model_crowd_score(t):
    rated = _house(t)
    return personal.CrowdScore().fit(rated).predict(rated).select("row", *r6("rating", "predicted"))


@query("kfold_assignment", statement("select row, fold::integer as fold from placed_h where repeat = 0", "placed_h", extra=_HOUSE))
def kfold_assignment(t):
    return personal.folds(_house(t).select("row"), 5)


@query(
    "cv_global_mean",
    statement(
        "select model, fold, row, round(actual, 6) as actual, round(predicted, 6) as predicted from floor_pred where repeat = 0",
        "floor_pred",
        extra=_HOUSE,
    ),
)
def cv_global_mean(t):
    return crossval.cv_global_mean(_house(t)).select("model", "fold", "row", *r6("actual", "predicted"))


def _cv(t):
    return crossval.cross_validate([personal.GlobalMean(), personal.CrowdScore()], _house(t), k=5, repeats=_REPEATS)


@query(
    "cv_summary",
    statement(
        """select model, max(n) as n, round(avg(rmse), 6) as rmse, round(stddev_samp(rmse), 6) as rmse_sd, round(avg(mae), 6) as mae,
                  round(avg(spearman), 6) as spearman
           from (select model, repeat, count(*) as n, sqrt(avg(power(actual - predicted, 2))) as rmse, avg(abs(actual - predicted)) as mae
                 from cv group by 1, 2) join cv_rho using (model, repeat) group by 1""",
        "cv",
        "cv_rho",
        extra=_HOUSE,
    ),
)
def cv_summary(t):
    return crossval.cv_summary(_cv(t)).select("model", "n", *r6("rmse", "rmse_sd", "mae", "spearman"))


@query(
    "cv_by_band",
    statement(
        """select model, band_no, band, n, round(rmse, 6) as rmse, round(mae, 6) as mae, round(spearman, 6) as spearman
           from cv_by_band join cv_band_rho using (model, band_no, band)""",
        "cv_by_band",
        "cv_band_rho",
        extra=_HOUSE,
    ),
)
def cv_by_band(t):
    banded = crossval.with_bands(_cv(t), _house(t))
    return crossval.cv_by_band(banded).select("model", "band_no", "band", "n", *r6("rmse", "mae", "spearman"))


@query(
    "tail_summary",
    statement(
        """select model, round(avg(rmse) filter (where band_no > 4), 3) as rmse_head, round(avg(rmse) filter (where band_no <= 4), 3) as rmse_tail,
                  round(avg(rmse) filter (where band_no <= 4) - avg(rmse) filter (where band_no > 4), 3) as gap from cv_by_band group by 1""",
        "cv_by_band",
        extra=_HOUSE,
    ),
)
def tail_summary(t):
    banded = crossval.with_bands(_cv(t), _house(t))
    return crossval.tail_summary(crossval.cv_by_band(banded)).select("model", "rmse_head", "rmse_tail", "gap")


@query(
    "largest_misses",
    statement(
        """select p.row, f.title, f.year, f.vote_count, round(p.actual, 6) as actual, round(p.predicted, 6) as predicted, round(abs(actual - predicted), 6) as abs_error
           from floor_pred p join films f on f.tmdb_id = p.row where p.repeat = 0 order by round(abs(actual - predicted), 9) desc, row limit 25""",
        "floor_pred",
        "films",
        extra=_HOUSE,
    ),
)
def largest_misses(t):
    worst = reports.largest_misses(crossval.cv_global_mean(_house(t)), t.films())
    return worst.select("row", "title", "year", "vote_count", *r6("actual", "predicted", "abs_error"))


_KNN = {
    "kn": (
        """select row, rating, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-8)) as vec,
                  (row_number() over (order by md5(concat_ws(':', row, '0')), row) - 1) % 4 as fold from labelled""",
        ("labelled",),
    ),
    "near": (
        """select a.row, a.rating as actual, b.rating, round(list_dot_product(a.vec, b.vec), 12) as sim, b.row as other
           from kn a join kn b on a.fold <> b.fold
           qualify row_number() over (partition by a.row order by round(list_dot_product(a.vec, b.vec), 12) desc, b.row) <= 25""",
        ("kn",),
    ),
}


def _out_of_fold(t, model):
    """Every labelled film predicted once, by a model fitted on the other three folds."""
    held = crossval.cross_validate([model], t.labelled_vectors(), k=4)
    return held.select("row", F.col("actual").alias("rating"), *r6("predicted"))


@query(
    "model_knn",
    statement(
        """select row, any_value(actual) as rating, round(case when bool_or(1 - sim <= 1e-12) then avg(rating) filter (where 1 - sim <= 1e-12)
                  else sum(rating / greatest(1 - sim, 1e-12)) / sum(1 / greatest(1 - sim, 1e-12)) end, 6) as predicted from near group by row""",
        "near",
        extra=_KNN,
    ),
)
def model_knn(t):
    return _out_of_fold(t, personal.ContentKNN())


@query("model_ridge")
def model_ridge(t):
    return _out_of_fold(t, personal.ContentRidge())


@query("ridge_gradient", "select i::integer as dim, 0.0::double as gradient from range(-1, 64) x(i)")
def ridge_gradient(t):
    """Slope of the penalised squared error at the fitted weights; -1 is the intercept."""
    rated = t.labelled_vectors()
    model = personal.ContentRidge().fit(rated)
    s = model.solution
    error = F.col("rating") - F.col("predicted")
    sums = model.predict(rated).agg(
        F.sum(error).alias("g-1"), *[F.sum(F.col("vec")[i] * error).alias(f"g{i}") for i in range(len(s.weights))]
    )
    slopes = [F.struct(F.lit(-1).alias("dim"), F.col("g-1").alias("gradient"))] + [
        F.struct(F.lit(i).alias("dim"), (F.col(f"g{i}") - float(s.alpha * w)).alias("gradient"))
        for i, w in enumerate(s.weights)
    ]
    return sums.select(F.inline(F.array(*slopes))).select("dim", (F.round("gradient", 6) + 0.0).alias("gradient"))


@query("model_gbt")
def model_gbt(t):
    return _out_of_fold(t, personal.GradientBoosted())


_STUMP = {
    "st_rows": (
        """select row, rating, vec::double[] as vec, (row_number() over (order by md5(concat_ws(':', row, '0')), row) - 1) % 4 as fold
           from labelled""",
        ("labelled",),
    ),
    "st_mean": (
        "select m, avg(rating) as mu, count(*) as n from st_rows, range(4) t(m) where fold <> m group by m",
        ("st_rows",),
    ),
    "st_long": (
        f"select m, row, mu - rating as g, n, dim, vec[dim + 1] as v from st_rows join st_mean on fold <> m, range({_D}) d(dim)",
        ("st_rows", "st_mean"),
    ),
    "st_edges": (
        """select distinct m, dim, v from (
             select *, row_number() over (partition by m, dim order by v) as r, max(v) over (partition by m, dim) as top from st_long)
           where v < top and list_contains(list_transform(range(1, 64), lambda i: ceil(i / 64.0::double * n)::bigint), r)""",
        ("st_long",),
    ),
    "st_sums": (
        """select m, dim, v, n, sum(g) over upto as gl, sum(c) over upto as hl
           from (select m, dim, v, n, sum(g) as g, count(*) as c from st_long group by all) window upto as (partition by m, dim order by v)""",
        ("st_long",),
    ),
    "st_best": (
        """select *, -gl / (hl + 2) as below, gl / (n - hl + 2) as above from st_sums join st_edges using (m, dim, v)
           where hl >= 5 and n - hl >= 5
           qualify row_number() over (partition by m order by gl * gl / (hl + 2) + gl * gl / (n - hl + 2) desc, dim, v) = 1""",
        ("st_sums", "st_edges"),
    ),
}


@query(
    "model_stump",
    statement(
        """select row, rating, round(mu + case when vec[dim + 1] <= v then below else above end, 4) as predicted
           from st_rows join st_mean on fold = m join st_best using (m)""",
        "st_rows",
        "st_mean",
        "st_best",
        extra=_STUMP,
    ),
)
def model_stump(t):
    """The first cut of boosted trees, on all rows and columns, with its two leaves in full."""
    model = personal.GradientBoosted(trees=1, depth=1, step=1.0, subsample=1.0, columns=1.0)
    held = crossval.cross_validate([model], t.labelled_vectors(), k=4)
    return held.select("row", F.col("actual").alias("rating"), F.round("predicted", 4).alias("predicted"))


def _factor_table(t):
    """What all ratings say of the labelled films; every fold's fit and prediction joins it."""
    factors = models.item_factors(t.model_ratings()).select(F.col("movieId").alias("row"), "item_mean", "factors")
    return written(factors.join(t.labelled_vectors().select("row"), "row", "left_semi"), "film-factors")


@query(
    "collab_coverage",
    statement(
        """select vec_id as row, vec_id in (select movieId from mr group by 1 having count(*) >= 30) as covered from embeddings""",
        "mr",
    ),
)
def collab_coverage(t):
    """Which labelled films the collaborative leg can speak about, at a floor of 30 ratings."""
    support = protocol.supported(t.model_ratings(), "movieId", 30)
    factors = support.select(
        F.col("movieId").alias("row"),
        F.lit(0.0).alias("item_mean"),
        F.array(F.lit(0.0)).alias("factors"),
    )
    return personal.CollaborativeFold(factors).coverage(t.labelled_vectors()).select("row", "covered")


@query("model_collab")
def model_collab(t):
    return _out_of_fold(t, personal.CollaborativeFold(_factor_table(t)))


@query(
    "blend_weight",
    statement(
        """select count(*) as n, round(greatest(0.0::double, least(1.0::double, wb / (wa + wb))), 6) as weight from (
             select *, (ay * bb - bye * ab) / (aa * bb - ab * ab) as wa, (bye * aa - ay * ab) / (aa * bb - ab * ab) as wb from (
               select sum(um * um) as aa, sum(um * im) as ab, sum(im * im) as bb, sum(um * rating) as ay, sum(im * rating) as bye, count(*) as n from g_base)), g_base
           group by wa, wb""",
        "g_base",
        extra=_GENERAL,
    ),
)
def blend_weight(t):
    """Two legs - user mean and item mean - over every held case of the protocol."""
    members = t.model_ratings().join(_general_users(t), "userId", "left_semi")
    cases = written(protocol.history_cases(members, HISTORY_SIZES), "cases")
    given, held = cases.where("given").drop("given"), cases.where(~F.col("given")).drop("given")
    train, by = _general_train(t), ["n_given", "userId"]
    first = models.UserMean().fit(train).score(given, held, by).withColumnRenamed("score", "p0")
    both = models.ItemMean().fit(train).score(given, first, by).withColumnRenamed("score", "p1")
    return personal.blend_weight(both).select("n", *r6("weight"))


@query("model_hybrid")
def model_hybrid(t):
    return _out_of_fold(
        t, personal.SupportGatedBlend(personal.ContentRidge(), personal.CollaborativeFold(_factor_table(t)))
    )


@query("stack_weights")
def stack_weights(t):
    return _out_of_fold(
        t, personal.StackedEnsemble([personal.GlobalMean(), personal.ContentRidge(), personal.ContentKNN()])
    )


@query(
    "hybrid_mix",
    statement(
        """select vec_id as row, vec_id in (select movieId from mr group by 1 having count(*) >= 20) as covered, 0.0::double as gap from embeddings""",
        "mr",
    ),
)
def hybrid_mix(t):
    """Distance of every blended prediction from its two legs mixed by the fitted weight."""
    rated = t.labelled_vectors()
    blend = personal.SupportGatedBlend(personal.ContentRidge(), personal.CollaborativeFold(_factor_table(t))).fit(rated)
    legs = blend.content.predict(rated).select("row", F.col("predicted").alias("content"))
    legs = legs.join(blend.collaborative.predict(rated).select("row", F.col("predicted").alias("collab")), "row")
    both = blend.predict(rated).join(legs, "row").join(
        blend.collaborative.coverage(rated).select("row", "covered"), "row"
    )
    w = F.when(F.col("covered"), F.lit(blend.weight)).otherwise(0.0)
    gap = F.abs(F.col("predicted") - (1.0 - w) * F.col("content") - w * F.col("collab"))
    return both.select("row", "covered", F.round(gap, 6).alias("gap"))


@query(
    "stack_optimality",
    """select unnest(['global_mean', 'crowd_score', 'intercept']) as member, true as allowed, true as stationary""",
)
def stack_optimality(t):
    """Non-negative least squares: no weight below 0, no slope at a positive one, none that asks for more at 0."""
    rated = _house(t)
    members = [personal.GlobalMean(), personal.CrowdScore()]
    stack = personal.StackedEnsemble(members).fit(rated)
    weights = [float(w) for w in stack.weights]
    held = personal.out_of_fold(members, rated, stack.inner_folds).where("rating is not null")
    error = F.col("rating") - stack.intercept
    for i, w in enumerate(weights):
        error = error - w * F.col(f"p{i}")
    slopes = [F.avg(error * F.col(f"p{i}")) for i in range(len(members))] + [F.avg(error)]
    names = [m.name for m in members] + ["intercept"]
    lines = [
        F.struct(
            F.lit(name).alias("member"),
            F.lit(name == "intercept" or w >= 0).alias("allowed"),
            ((slope < 1e-6) & ((slope > -1e-6) | F.lit(name != "intercept" and w == 0))).alias("stationary"),
        )
        for name, w, slope in zip(names, [*weights, 0.0], slopes, strict=True)
    ]
    return held.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


# -- personal models on film metadata, fitted inside the fold ---------------------------------

#: Blocks whose columns SQL can name: all but the two that are reduced by an SVD.
_NAMED_BLOCKS = ("genres", "directors", "cast", "countries", "numeric", "language")
_LISTS = {"genres": "genres", "directors": "directors", "cast": '"cast"', "countries": "production_countries"}
_TOKENS = " union all ".join(
    f"""select row, fold, '{block}' as block, unnest(list_transform(list_filter({column}, lambda x: trim(x) <> ''),
        lambda x: replace(lower(trim(x)), ' ', '_'))) as term from film_folds""" for block, column in _LISTS.items()
)
_NUMBERS = {
    "year": "year::double", "runtime": "runtime::double", "log_votes": "ln(1 + vote_count::double)",
    "crowd_shrunk": "(vote_count * vote_average + 325.0::double) / (vote_count + 50)", "n_keywords": "len(keywords)::double",
    "n_cast": 'len("cast")::double', "n_directors": "len(directors)::double", "n_genres": "len(genres)::double",
    "overview_length": "length(overview)::double",
}
#: The film matrix of every fold, fitted on the other folds; ``fits`` says on which folds.
_FILM_MATRIX = {
    "film_folds": (
        "select *, tmdb_id as row, (row_number() over (order by md5(concat_ws(':', tmdb_id, 0)), tmdb_id) - 1) % 5 as fold from house",
        ("house",),
    ),
    "fits": ("select f, fold as used from range(5) x(f), range(5) y(fold) where f <> fold", ()),
    "fit_sizes": ("select f, count(*) as n from fits join film_folds on used = fold group by f", ("fits", "film_folds")),
    "tokens": (f"select row, fold, block, term, count(*) as tf from ({_TOKENS}) group by all", ("film_folds",)),
    "film_terms": (
        """select f, block, term, ln((1.0::double + any_value(n)) / (1 + count(*))) + 1 as idf
           from tokens join fits on used = fold join fit_sizes using (f) group by all having count(*) >= 2""",
        ("tokens", "fits", "fit_sizes"),
    ),
    "weighted": (
        """select f, row, fold, block || ':' || term as term, tf * idf / sqrt(sum(tf * idf * tf * idf) over (partition by f, row, block)) as v
           from tokens join film_terms using (block, term)""",
        ("tokens", "film_terms"),
    ),
    "numbers": (
        "select row, fold, unnest([" + ", ".join(f"'{n}'" for n in _NUMBERS) + "]) as name, unnest([" + ", ".join(_NUMBERS.values())
        + "]) as x from film_folds",
        ("film_folds",),
    ),
    "middles": ("select f, name, median(x) as middle from numbers join fits on used = fold group by all", ("numbers", "fits")),
    "scales": (
        """select f, name, any_value(middle) as middle, avg(coalesce(x, middle)) as mean, coalesce(nullif(stddev_pop(coalesce(x, middle)), 0), 1) as sd
           from numbers join fits on used = fold join middles using (f, name) group by f, name""",
        ("numbers", "fits", "middles"),
    ),
    "tongues": (
        """select f, original_language as lang, count(*) >= 5 as often from film_folds join fits on used = fold group by all""",
        ("film_folds", "fits"),
    ),
    "film_cells": (
    """select f, row, fold, term, v from weighted
       union all select f, row, fold, 'numeric:' || name, (coalesce(x, middle) - mean) / sd from numbers join scales using (name)
       union all select * from (
         select r.f, row, fold, case when often then 'language:' || original_language when rare then 'language:other' end as term, 1.0::double as v
         from film_folds cross join (select f, bool_or(not often) as rare from tongues group by f) r
         left join tongues g on g.f = r.f and g.lang = original_language) where term is not null""",
    ("weighted", "numbers", "scales", "tongues", "film_folds"),
    ),
}
_FILM_KNN = _FILM_MATRIX | {
    "film_units": ("select f, row, fold, term, v / sqrt(sum(v * v) over (partition by f, row)) as v from film_cells", ("film_cells",)),
    "film_near": (
        """select *, row_number() over (partition by row order by sim desc, other) as place from (
             select a.row, b.row as other, round(sum(a.v * b.v), 12) as sim from film_units a join film_units b on a.f = b.f and a.term = b.term
             where a.fold = a.f and b.fold <> b.f group by 1, 2) qualify place <= 25""",
        ("film_units",),
    ),
}


def _film_ratings(t):
    """One person's rated films with their metadata."""
    return t.house().withColumn("row", F.col("tmdb_id"))


def _film_out_of_fold(t, model, vectors=None):
    held = crossval.cross_validate([metadata.OnMetadata(model, vectors)], _film_ratings(t), k=5)
    return held.select("row", *r6("actual", "predicted"))


@query(
    "film_knn",
    statement(
        """select h.row, round(h.rating, 6) as actual, round(case when bool_or(1 - sim <= 1e-12) then avg(o.rating) filter (where 1 - sim <= 1e-12)
                  else sum(o.rating / greatest(1 - sim, 1e-12)) / sum(1 / greatest(1 - sim, 1e-12)) end, 6) as predicted
           from film_near n join film_folds h on h.row = n.row join film_folds o on o.row = n.other group by h.row, h.rating""",
        "film_near", "film_folds",
        extra=_FILM_KNN,
    ),
)
def film_knn(t):
    """Nearest films by metadata: vocabularies, scales and neighbours come from the other folds alone."""
    return _film_out_of_fold(t, personal.ContentKNN(), metadata.FilmVectors(_NAMED_BLOCKS))


@query("film_ridge")
def film_ridge(t):
    """Ridge over all eight blocks at full width, everything fitted inside the fold."""
    return _film_out_of_fold(t, personal.ContentRidge())


@query(
    "film_ridge_slopes",
    statement(
        """select distinct term, 0.0::double as gradient from film_cells where f = 0 and fold <> 0
           union all select 'intercept', 0.0::double""",
        "film_cells",
        extra=_FILM_MATRIX,
    ),
)
def film_ridge_slopes(t):
    """One fold's fit: the columns that its training films have, and the slope of the penalised error at each weight."""
    train = personal.folds(_film_ratings(t), 5).where("fold <> 0").drop("fold")
    fitted = metadata.OnMetadata(personal.ContentRidge(), metadata.FilmVectors(_NAMED_BLOCKS)).fit(train)
    s, terms = fitted.model.solution, fitted.vectors.terms
    vectors = written(fitted.vectors.transform(train), "film-vectors")
    error = fitted.model.predict(vectors).select("vec", (F.col("rating") - F.col("predicted")).alias("error"))
    sums = error.select(F.posexplode("vec").alias("at", "x"), "error").groupBy("at").agg(F.sum(F.col("x") * F.col("error")).alias("g"))
    pulls = t.spark.createDataFrame([(i, term, float(s.alpha * w)) for i, (term, w) in enumerate(zip(terms, s.weights, strict=True))],
                                    "at int, term string, pull double")
    slopes = sums.join(pulls, "at").select("term", (F.col("g") - F.col("pull")).alias("gradient"))
    whole = slopes.unionByName(error.agg(F.sum("error").alias("gradient")).select(F.lit("intercept").alias("term"), "gradient"))
    return whole.select("term", (F.round("gradient", 6) + 0.0).alias("gradient"))


@query("film_ridge_wide")
def film_ridge_wide(t):
    """Every film of the catalogue by ridge on all words of all eight blocks, popularity held."""
    fitted = metadata.WideFilmRidge(debias=True).fit(_film_ratings(t))
    films = t.catalogue().withColumn("row", F.col("tmdb_id"))
    return fitted.predict(films).select("tmdb_id", *r6("predicted"))


@query(
    "film_ridge_wide_slopes",
    statement(
        """select distinct term, 0.0::double as gradient from film_cells where f = 0 and fold <> 0
           union all select 'intercept', 0.0::double""",
        "film_cells",
        extra=_FILM_MATRIX,
    ),
)
def film_ridge_wide_slopes(t):
    """The slope of the penalised error at each weight of one fold's wide fit, from the films' cells."""
    train = written(personal.folds(_film_ratings(t), 5).where("fold <> 0").drop("fold"), "train")
    model = metadata.WideFilmRidge(_NAMED_BLOCKS).fit(train)
    s = model.solution
    errors = model.predict(train).select("tmdb_id", (F.col("rating") - F.col("predicted")).alias("error"))
    pulls = s.weights.select("col", (F.col("weight") * s.alpha).alias("pull"))
    cells = model.cells(train).withColumnRenamed("row", "tmdb_id")
    sums = cells.join(errors, "tmdb_id").groupBy("col").agg(F.sum(F.col("value") * F.col("error")).alias("g"))
    slopes = sums.join(pulls, "col").select(F.col("col").alias("term"), (F.col("g") - F.col("pull")).alias("gradient"))
    whole = slopes.unionByName(errors.select(F.lit("intercept").alias("term"), "error").groupBy("term").agg(F.sum("error").alias("gradient")))
    return whole.select("term", (F.round("gradient", 6) + 0.0).alias("gradient"))


@query("film_recommend")
def film_recommend(t):
    """Unseen films by debiased ridge on their metadata, ranked in all three ways."""
    seen = inter.film_status(t.interactions(), KEYS).where("seen").select(F.col("film_key").cast("long").alias("tmdb_id"))
    candidates = t.catalogue().join(seen, "tmdb_id", "left_anti").withColumn("row", F.col("tmdb_id"))
    fitted = metadata.OnMetadata(personal.ContentRidge(debias=True)).fit(_film_ratings(t))
    scored = written(fitted.predict(candidates), "scored")

    class Scored:
        def predict(self, films):
            return films

    lists = [ranking.recommend(Scored(), None, scored, k=20, mode=mode).withColumn("mode", F.lit(mode)) for mode in ranking.MODES]
    return reduce(DataFrame.unionByName, lists)


_RECOMMEND = {
    **_HOUSE,
    "line_h": ("select regr_slope(rating, crowd_shrunk) as s, regr_intercept(rating, crowd_shrunk) as i from h", ("h",)),
    "unseen": (
        f"""select c.*, {band('vote_count')} as band,
                   s * ((vote_count * vote_average + 325.0::double) / (vote_count + 50)) + i as score
            from catalogue c, line_h where c.tmdb_id::varchar not in (select film_key from status where seen)""",
        ("catalogue", "status", "line_h"),
    ),
}


@query(
    "recommend",
    statement(
        """select row_number() over (order by round(score, 9) desc, tmdb_id) as rank, title, year, vote_count, band, vote_average,
                  original_language, tmdb_id, round(score, 3) as score
           from (select *, row_number() over (order by late, round(score, 9) desc, tmdb_id) as place from (
             select *, row_number() over (partition by band order by round(score, 9) desc, tmdb_id) > 2 as late from unseen))
           where place <= 20""",
        "unseen",
        extra=_RECOMMEND,
    ),
)
def recommend(t):
    """Fit the crowd-score line on the house ratings, list unseen films in strata."""
    seen = inter.film_status(t.interactions(), KEYS).where("seen").select(F.col("film_key").cast("long").alias("tmdb_id"))
    candidates = t.catalogue().join(seen, "tmdb_id", "left_anti")
    scored = candidates.withColumn(
        "crowd_shrunk", num.crowd_shrunk(F.col("vote_average"), F.col("vote_count"))
    )
    return ranking.recommend(personal.CrowdScore(), _house(t), scored, k=20, mode=ranking.STRATIFIED)

