from pyspark.sql import functions as F

from evenreel.functions import numeric as num
from evenreel.functions import text as tx


def column(spark, values, build, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in frame.orderBy("i").select(build(F.col("v"))).collect()]


def test_normalize_title(spark):
    got = column(spark, ["Amélie!", "  WALL·E ", "Straße", None, "Ｆｕｌｌ", "a_b -  c"], tx.normalize_title)
    assert got == ["amelie", "wall e", "strasse", "", "full", "a_b c"]


def test_slug_year_and_key(spark):
    assert column(spark, ["https://x.example/film/2aHi/", "", "/", None], tx.film_slug) == ["2aHi", None, None, None]
    assert column(spark, [" 1994 ", "n/a", "", None], tx.parse_year) == [1994, None, None, None]
    keys = column(spark, ["Amélie!"], lambda c: tx.title_year_key(c, F.lit(None).cast("int")))
    assert keys == ["ty:amelie:?"]
    assert column(spark, ["ty:a:1", "2aHi"], lambda c: tx.film_url(c, "https://x.example")) == ["", "https://x.example/2aHi"]


def test_variants_only_drop_articles_of_longer_titles(spark):
    got = column(spark, ["the fisher king", "fisher king the", "the", "i am cuba"], tx.title_variants)
    assert got == [["the fisher king", "fisher king"], ["fisher king the", "fisher king"], ["the"], ["i am cuba"]]


def test_sequel_marks(spark):
    got = column(spark, ["drunken master ii", "blade runner 2049", "x", "ran", "se7en"], tx.sequel_marker)
    assert got == ["ii", "2049", None, None, None]
    conflict = lambda q, forms: spark.range(1).select(
        tx.sequel_conflict(F.lit(q), F.array(*map(F.lit, forms)))
    ).first()[0]
    assert conflict("drunken master ii", ["drunken master iii"])
    assert conflict("blade runner", ["blade runner 2049"])
    assert not conflict("blade runner 2049", ["blade runner", "blade runner 2049"])


def test_indel_ratio_matches_table():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return 200.0 * t[-1][-1] / (len(a) + len(b))

    words = ["the fisher king", "fisher king", "drunken master ii", "drunken master iii", "a", "été 85", "aaab", "abab"]
    for a in words:
        for b in words:
            assert abs(tx.indel_ratio(a, b) - slow(a, b)) < 1e-9
    assert round(tx.indel_ratio("the fisher king", "fisher king"), 1) == 84.6
    assert round(tx.indel_ratio("drunken master ii", "drunken master iii"), 1) == 97.1


def test_similarity_sorts_words(spark):
    frame = spark.createDataFrame([(["king fisher"], ["fisher king"])], "a array<string>, b array<string>")
    assert frame.select(tx.title_similarity("a", "b")).first()[0] == 100.0


def test_imdb_ids_are_padded_not_cut(spark):
    assert column(spark, [114709, 12345678, None], tx.imdb_tt, "long") == ["tt0114709", "tt12345678", None]


def test_bands_are_absolute_and_null_counts_as_zero(spark):
    votes = [None, 0, 1, 4, 5, 19, 20, 99, 100, 499, 500, 1999, 2000, 9999, 10000]
    assert column(spark, votes, num.popularity_band, "long") == [
        "0", "0", "1-4", "1-4", "5-19", "5-19", "20-99", "20-99", "100-499", "100-499",
        "500-2k", "500-2k", "2k-10k", "2k-10k", "10k+",
    ]


def test_crowd_score_shrinks(spark):
    frame = spark.createDataFrame([(10.0, 1), (0.0, 0), (None, 0), (8.0, 100_000)], "a double, v long")
    got = [r[0] for r in frame.select(num.crowd_shrunk(F.col("a"), F.col("v"))).collect()]
    assert abs(got[0] - (10 + 325) / 51) < 1e-12
    assert got[1] == got[2] == 6.5
    assert abs(got[3] - 8.0) < 0.01


def test_ten_point_refuses_values_off_the_scale(spark):
    import pytest

    ok = spark.createDataFrame([("0.5",), ("5",), ("3.5",)], "rating string")
    assert [r[0] for r in num.ten_point(ok, "rating", doubled=True).collect()] == [1, 10, 7]
    for bad in ("11", "0", "2.5", "x"):
        frame = spark.createDataFrame([(bad,)], "rating string")
        with pytest.raises(Exception, match="1-10 scale"):
            num.ten_point(frame, "rating").collect()


def test_json_and_numbers(spark):
    assert column(spark, ['["a","b"]', "", "[x", None], tx.json_list) == [["a", "b"], [], [], []]
    assert column(spark, ["1.5", "nan", "inf", "-inf", "x", ""], tx.finite_number) == [1.5, None, None, None, None, None]
