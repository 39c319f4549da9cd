"""Matching films to a whole catalogue although titles are spelt differently.

Two texts of n and m code points score 85 or more exactly if some t = 0.15 (n + m)
insertions and deletions, of the parity of n + m, turn one into the other. Cut one
into t + 1 pieces: at least one of them then stands in the other, and among those one
that has at most as many edits before it as pieces before it, and likewise behind.
So each pair of lengths has an index of pieces, which a text asks for at the few
places where they may stand. Nothing is lost and no two titles are paired that share
no piece. Years are compared in the same join, by blocks of five, and to the year
once the texts are scored: a pair of texts is scored once, whatever its years.

A piece that many titles of a length and block share is asked for no more: those
titles are cut into t + 2 pieces, of which two must stand, and are joined by pairs
of pieces.

Rows without a title or year match nothing. Repeated titles are compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenreel.functions.text import indel_ratio, normalize_title, title_variants
from evenreel.operators.resolution import (
    MEDIUM_SCORE,
    MEDIUM_YEARS,
    MOVIE,
    resolve_candidates,
)
from evenreel.session import written

#: Titles per piece, pair of lengths and block of years beyond which pairs of pieces are asked for.
CROWD = 256

_SCORE = int(MEDIUM_SCORE)
_SPAN = 2 * MEDIUM_YEARS + 1  # the years around one year lie in two blocks at most
_TEXT = ("way", "text", "year")
#: Texts of one pair of lengths that a task cuts into pieces: a few hundred each.
CELLS_PER_TASK = 1 << 12


@F.pandas_udf(T.DoubleType())
def _ratio(left, right):
    return left.combine(right, indel_ratio).astype("float64")


def _in_both_orders(forms: DataFrame) -> DataFrame:
    """Each form as written and with its words sorted: columns way and text."""
    by_word = F.array_join(F.array_sort(F.split("form", " ")), " ")
    ways = F.explode(F.create_map(F.lit("written"), F.col("form"), F.lit("sorted"), by_word))
    rest = [c for c in forms.columns if c != "form"]
    return forms.where(F.col("form") != "").select(*rest, ways.alias("way", "text"))


def _lengths(texts: DataFrame, own: str, other: str) -> DataFrame:
    """One row per length that a text similar enough can have, with the edits allowed."""
    size = F.length("text")
    fewest = F.ceil(size * _SCORE / (200 - _SCORE)).cast("int")
    most = F.floor(size * (200 - _SCORE) / _SCORE).cast("int")
    total = F.col(own) + F.col(other)
    whole = F.floor(total * (100 - _SCORE) / 100).cast("int")
    return (
        texts.withColumn(own, size)
        .withColumn(other, F.explode(F.sequence(fewest, most)))
        .withColumn("edits", whole - (whole + total) % 2)
    )


def _piece(place: str, pieces: Column) -> tuple[Column, Column]:
    """Start and length of a numbered piece of an indexed text."""
    start = lambda i: F.floor(i * F.col("n") / pieces).cast("int")
    return start(F.col(place)), start(F.col(place) + 1) - start(F.col(place))


def _cut(start: Column, length: Column) -> Column:
    return F.substring(F.col("text"), start + 1, length)


def _key(*parts: str) -> Column:
    """Equal keys of unequal parts only cost a comparison."""
    return F.xxhash64("way", "block", "n", "m", *parts).alias("key")


def _spread(rows: DataFrame, label: str) -> DataFrame:
    """Few rows of which each becomes hundreds, dealt to tasks by their number and not their bytes."""
    rows = written(rows, label)
    own = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(own, -(-rows.count() // CELLS_PER_TASK)))


def _indexed(texts: DataFrame) -> DataFrame:
    """A text counts once per block of years, however many of its years lie there."""
    block = F.floor(F.col("year") / _SPAN).alias("block")
    return _lengths(_spread(texts.select("way", "text", block).distinct(), "indexed-texts"), "n", "m")


def _asked(texts: DataFrame) -> DataFrame:
    around = [F.floor((F.col("year") + d) / _SPAN) for d in (-MEDIUM_YEARS, MEDIUM_YEARS)]
    blocks = texts.select("way", "text", F.explode(F.array_distinct(F.array(*around))).alias("block"))
    return _lengths(_spread(blocks.distinct(), "asked-texts"), "m", "n")


_CELL = ("way", "text", "block", "n", "m", "edits")


def _indexed_pieces(cells: DataFrame) -> DataFrame:
    start, length = _piece("i", F.col("edits") + 1)
    return (
        cells.withColumn("i", F.explode(F.sequence(F.lit(0), "edits")))
        .withColumn("piece", _cut(start, length))
        .select(*_CELL, _key("i", "piece"))
    )


def _asked_pieces(cells: DataFrame) -> DataFrame:
    """Where a piece may stand: as few edits before it as pieces, and behind it alike."""
    start, length = _piece("i", F.col("edits") + 1)
    longer, behind = F.col("m") - F.col("n"), F.col("edits") - F.col("i")
    first = F.greatest(F.lit(0), F.col("start") - F.col("i"), F.col("start") + longer - behind)
    last = F.least(
        F.col("m") - F.col("length"), F.col("start") + F.col("i"), F.col("start") + longer + behind
    )
    return (
        cells.withColumn("i", F.explode(F.sequence(F.lit(0), "edits")))
        .withColumns({"start": start, "length": length})
        .withColumns({"first": first, "last": last})
        .where(F.col("first") <= F.col("last"))
        .withColumn("at", F.explode(F.sequence("first", "last")))
        .withColumn("piece", _cut(F.col("at"), F.col("length")))
        .select(*_CELL, _key("i", "piece"))
    )


def _piece_pairs(cells: DataFrame) -> DataFrame:
    """Every two pieces of a text cut once more."""
    pieces = F.col("edits") + 2
    after = F.sequence(F.col("i") + 1, F.col("edits") + 1)
    pairs = cells.withColumn("i", F.explode(F.sequence(F.lit(0), "edits"))).withColumn(
        "j", F.explode(after)
    )
    starts = dict(zip(("start_i", "length_i"), _piece("i", pieces)))
    return pairs.withColumns(starts | dict(zip(("start_j", "length_j"), _piece("j", pieces))))


def _indexed_pairs(cells: DataFrame) -> DataFrame:
    return (
        _piece_pairs(cells)
        .withColumn("left", _cut(F.col("start_i"), F.col("length_i")))
        .withColumn("right", _cut(F.col("start_j"), F.col("length_j")))
        .select("way", "text", _key("i", "j", "left", "right"))
    )


def _asked_pairs(cells: DataFrame) -> DataFrame:
    """Two pieces at all places that the edits allow before, between and behind them."""
    longer = F.col("m") - F.col("n")
    # a shift s costs |s| edits before it and |longer - s| behind it
    shifts = F.sequence(
        F.floor((longer - F.col("edits")) / 2).cast("int"),
        F.floor((longer + F.col("edits")) / 2).cast("int"),
    )
    spent = F.abs("s") + F.abs(F.col("r") - F.col("s")) + F.abs(longer - F.col("r"))
    at_i, at_j = F.col("start_i") + F.col("s"), F.col("start_j") + F.col("r")
    return (
        _piece_pairs(cells)
        .withColumn("s", F.explode(shifts))
        .withColumn("r", F.explode(shifts))
        .where(
            (spent <= F.col("edits"))
            & (at_i >= 0)
            & (at_i + F.col("length_i") <= at_j)
            & (at_j + F.col("length_j") <= F.col("m"))
        )
        .withColumn("left", _cut(at_i, F.col("length_i")))
        .withColumn("right", _cut(at_j, F.col("length_j")))
        .select("way", "text", _key("i", "j", "left", "right"))
    )


def _edits(text: str, found: str) -> Column:
    """Insertions and deletions that two texts of a score of 85 or more are apart at most."""
    return F.floor((F.length(text) + F.length(found)) * (100 - _SCORE) / 100).cast("int")


def _meet(asked: DataFrame, indexed: DataFrame) -> DataFrame:
    """(way, text, found): texts that share a key and, by edits of any kind, may be near enough."""
    other = indexed.select("key", "way", F.col("text").alias("found"))
    apart = F.call_function("levenshtein", F.col("text"), F.col("found"))
    return (
        asked.select("key", "way", "text")
        .join(other, ["key", "way"])
        .where(apart <= _edits("text", "found"))
        .select("way", "text", "found")
        .distinct()
    )


def _with_years(pairs: DataFrame, asked: DataFrame, indexed: DataFrame) -> DataFrame:
    """The pairs in all years within two of each other that their texts have."""
    within = F.array(*[F.col("year") + d for d in range(-MEDIUM_YEARS, MEDIUM_YEARS + 1)])
    around = asked.select(*_TEXT, F.explode(within).alias("found_year"))
    other = indexed.select("way", F.col("text").alias("found"), F.col("year").alias("found_year"))
    return pairs.join(around, ["way", "text"]).join(other, ["way", "found", "found_year"])


def similar_texts(asked: DataFrame, indexed: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """All pairs of texts of one way at a score of 85 or more, years within two.

    Both inputs: way, text, year, distinct. Output: the asked row, found,
    found_year and score.
    """
    index = written(_indexed_pieces(_indexed(indexed)), "title-pieces")
    probes = written(_asked_pieces(_asked(asked)), "title-probes")
    crowded = written(
        index.groupBy("key").count().where(F.col("count") > crowd).select("key"), "crowded-pieces"
    )
    single = _meet(probes, index.join(crowded, "key", "left_anti"))
    in_crowd = lambda rows: _spread(
        rows.join(crowded, "key", "left_semi").select(*_CELL).distinct(), "crowded-texts"
    )
    double = _meet(_asked_pairs(in_crowd(probes)), _indexed_pairs(in_crowd(index)))
    pairs = single.union(double).distinct()
    equal = F.col("text") == F.col("found")
    # Python is handed two empty texts in place of an equal pair
    blank = lambda c: F.when(equal, F.lit("")).otherwise(F.col(c))
    score = F.when(equal, 100.0).otherwise(_ratio(blank("text"), blank("found")))
    scored = written(pairs.withColumn("score", score), "scored-texts").where(F.col("score") >= MEDIUM_SCORE)
    return _with_years(scored, asked, indexed).select(*_TEXT, "found", "found_year", "score")


def _entries(catalogue: DataFrame) -> DataFrame:
    """The catalogue's most popular record per pair of titles, year and medium.

    No other record of the same spelling can be chosen, so no other is compared.
    """
    media = F.col("media_type") if "media_type" in catalogue.columns else F.lit(MOVIE)
    original = F.col("original_title") if "original_title" in catalogue.columns else F.lit("")
    records = catalogue.where(F.col("tmdb_id").isNotNull() & F.col("year").isNotNull()).select(
        F.col("tmdb_id").alias("id"),
        F.coalesce("title", F.lit("")).alias("candidate_title"),
        F.coalesce(original, F.lit("")).alias("candidate_original"),
        F.col("year").cast("int").alias("year"),
        "popularity",
        F.coalesce(media, F.lit(MOVIE)).alias("media_type"),
    )
    spelling = {"_title": normalize_title(F.col("candidate_title")),
                "_original": normalize_title(F.col("candidate_original"))}
    best = F.max_by(
        F.struct("id", "candidate_title", "candidate_original", "popularity"),
        F.struct("popularity", -F.col("id")),
    )
    return (
        records.withColumns(spelling)
        .groupBy("_title", "_original", "year", "media_type")
        .agg(best.alias("best"))
        .select("_title", "_original", "year", "media_type", "best.*")
    )


def find_candidates(films: DataFrame, catalogue: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """Every catalogue record that could be accepted for a film, with its score.

    ``films``: film_key, title, year, one row per key. ``catalogue``: tmdb_id, title,
    year, popularity and, where there are any, original_title and media_type. The
    result is a candidate table for ``resolve_candidates``.
    """
    known = films.where(F.col("year").isNotNull())
    asked = written(
        _in_both_orders(
            known.select(
                "film_key",
                F.col("year").cast("int").alias("year"),
                F.explode(title_variants(normalize_title(F.col("title")))).alias("form"),
            )
        ),
        "asked-titles",
    )
    entries = written(_entries(catalogue), "catalogue-spellings")
    literals = F.array_distinct(F.array("_title", "_original"))
    forms = F.array_distinct(F.flatten(F.transform(literals, title_variants)))
    filed = _in_both_orders(
        entries.select("id", "media_type", "year", F.explode(forms).alias("form"))
    )
    texts = lambda rows: rows.select(*_TEXT).distinct()
    similar = similar_texts(texts(asked), texts(filed), crowd=crowd)
    hits = (
        similar.join(asked, list(_TEXT))
        .drop("year", "text")
        .withColumnsRenamed({"found": "text", "found_year": "year"})
        .join(filed, list(_TEXT))
        .groupBy("film_key", "id", "media_type")
        .agg(F.max("score").alias("score"))
    )
    return hits.join(
        entries.select(
            "id", "media_type", "candidate_title", "candidate_original", "popularity",
            F.col("year").cast("string").alias("release_date"),
        ),
        ["id", "media_type"],
    ).join(known.select("film_key", "title", "year"), "film_key")


def resolve_catalogue(films: DataFrame, catalogue: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """The best acceptable record per film over the whole catalogue, all three tiers.

    Films of one normalised title and year are asked for once, however many there are.
    """
    spelt = films.where(F.col("year").isNotNull()).select(
        "film_key", "title", "year", normalize_title(F.col("title")).alias("_query")
    )
    asked = (
        spelt.where(F.col("_query") != "")
        .groupBy("_query", "year")
        .agg(F.min("title").alias("title"))
        .withColumn("film_key", F.concat_ws(":", F.col("year").cast("string"), "_query"))
    )
    asked = written(asked, "asked-films")
    matches = resolve_candidates(find_candidates(asked.drop("_query"), catalogue, crowd=crowd))
    found = asked.select("film_key", "_query", "year").join(matches, "film_key").drop("film_key")
    return spelt.select("film_key", "_query", "year").join(found, ["_query", "year"]).drop(
        "_query", "year"
    )
