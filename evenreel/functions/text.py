"""Column functions over titles, keys and metadata text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Articles that come and go at either end of a title, and the
# roman numerals read as sequel marks.
ARTICLES = (
    "the a an "
    "le la les un une l "
    "el los las una "
    "il lo uno "
    "der die das ein eine "
    "o os as um uma"
).split()
ROMAN_NUMERALS = "i ii iii iv v vi vii viii ix x xi xii xiii".split()


@F.pandas_udf(T.StringType())
def _fold_accents(titles: pd.Series) -> pd.Series:
    """Compatibility-decompose, drop combining marks, casefold."""

    def fold(text):
        if text is None:
            return None
        marks_apart = unicodedata.normalize("NFKD", text)
        return "".join(c for c in marks_apart if unicodedata.combining(c) == 0).casefold()

    return titles.map(fold, na_action="ignore")


def normalize_title(title: Column) -> Column:
    """Accent-free, punctuation-free, single-spaced, casefolded title.

    ASCII titles never leave the JVM: the Arrow function is handed a null for
    them, so only titles that need Unicode decomposition are shipped to Python.
    """
    text = F.coalesce(title, F.lit(""))
    is_ascii = text.rlike(r"^\p{ASCII}*$")
    folded = F.when(is_ascii, F.lower(text)).otherwise(
        _fold_accents(F.when(~is_ascii, text))
    )
    no_punctuation = F.regexp_replace(folded, r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(no_punctuation, r"(?U)\s+", " "))


def film_slug(uri: Column) -> Column:
    """The last path segment of a film address, null when there is none."""
    bare = F.regexp_replace(uri, "/+$", "")
    last = F.trim(F.element_at(F.split(bare, "/"), -1))
    return F.when(last != "", last)


def parse_year(raw: Column) -> Column:
    return F.trim(raw).try_cast("int")


def release_year(release_date: Column) -> Column:
    return F.substring(release_date, 1, 4).try_cast("int")


def title_year_key(title: Column, year: Column) -> Column:
    """Stand-in film key for rows without an address."""
    return F.concat(
        F.lit("ty:"), normalize_title(title), F.lit(":"), F.coalesce(year.cast("string"), F.lit("?"))
    )


def film_url(film_key: Column, base: str) -> Column:
    """Address of a film page below ``base``; empty for stand-in keys."""
    return F.when(film_key.startswith("ty:"), F.lit("")).otherwise(
        F.concat(F.lit(base.rstrip("/") + "/"), film_key)
    )


def title_variants(normalized: Column) -> Column:
    """The title itself and its forms without a leading or trailing article."""
    words = F.split(normalized, " ")
    several = F.size(words) > 1
    no_head = F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")
    no_tail = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), " ")
    forms = F.array(
        normalized,
        F.when(several & F.element_at(words, 1).isin(ARTICLES), no_head),
        F.when(several & F.element_at(words, -1).isin(ARTICLES), no_tail),
    )
    return F.array_distinct(F.array_compact(forms))


def sequel_marker(normalized: Column) -> Column:
    """Trailing number or roman numeral of a title with more than one word."""
    words = F.split(normalized, " ")
    last = F.element_at(words, -1)
    marks = last.rlike(r"^\d+$") | last.isin(ROMAN_NUMERALS)
    return F.when((F.size(words) > 1) & marks, last)


def sequel_conflict(query: Column, forms: Column) -> Column:
    """True when no candidate form carries the sequel mark of the query."""
    unmarked = F.lit("")
    marks = F.transform(forms, lambda form: F.coalesce(sequel_marker(form), unmarked))
    return ~F.array_contains(marks, F.coalesce(sequel_marker(query), unmarked))


def imdb_tt(number: Column) -> Column:
    return F.when(number.isNotNull(), F.format_string("tt%07d", number.cast("long")))


def list_document(values: Column) -> Column:
    """List column -> one document whose names are single tokens."""
    kept = F.filter(values, lambda v: F.trim(v) != "")
    tokens = F.transform(kept, lambda v: F.replace(F.lower(F.trim(v)), F.lit(" "), F.lit("_")))
    return F.coalesce(F.array_join(tokens, " "), F.lit(""))


def json_list(cell: Column) -> Column:
    """JSON array cell -> array of strings, empty when blank or malformed."""
    return F.coalesce(F.from_json(cell, "array<string>"), F.array().cast("array<string>"))


def finite_number(raw: Column) -> Column:
    """Number of a text cell; null when unreadable, NaN or infinite."""
    value = F.trim(raw).try_cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def _common_subsequence(left: str, right: str) -> int:
    """Longest common subsequence length, a whole table row per integer operation."""
    full = (1 << len(left)) - 1
    places: dict[str, int] = {}
    for i, ch in enumerate(left):
        places[ch] = places.get(ch, 0) | (1 << i)
    open_bits = full  # a cleared bit is one matched character of ``left``
    for ch in right:
        hit = open_bits & places.get(ch, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(left) - open_bits.bit_count()


def indel_ratio(left: str, right: str) -> float:
    """Similarity 0-100 from insertions and deletions alone."""
    total = len(left) + len(right)
    if total == 0:
        return 100.0
    return 200.0 * _common_subsequence(left, right) / total


@F.pandas_udf(T.DoubleType())
def title_similarity(queries: pd.Series, candidates: pd.Series) -> pd.Series:
    """Best similarity over all pairs of query and candidate forms.

    Every pair is compared as written and with its words sorted. Equal pairs
    recur often in candidate lists, so each distinct pair is scored once per
    Arrow batch.
    """
    seen: dict[tuple, float] = {}

    def sorted_words(text: str) -> str:
        return " ".join(sorted(text.split()))

    def score(left_forms, right_forms) -> float:
        best = 0.0
        for left in left_forms:
            for right in right_forms:
                if (left, right) not in seen:
                    seen[left, right] = max(
                        indel_ratio(left, right),
                        indel_ratio(sorted_words(left), sorted_words(right)),
                    )
                best = max(best, seen[left, right])
        return best

    return pd.Series(
        [
            score([] if q is None else q, [] if c is None else c)
            for q, c in zip(queries, candidates)
        ],
        dtype="float64",
    )
