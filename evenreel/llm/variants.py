"""Spelling variants by pairs of trie nodes (operator 13).

The words are read into two tries, one from the front and one from the back.
Every node gets a number: a prefix of any word is one integer, and so is a
suffix. A word is then, at every place, a pair (prefix node, suffix node), and

* the pair that skips one letter equals a pair of the word without the letter:
  one joined row per neighbour by insertion or deletion. In a run of equal
  letters only the first is skipped, so no neighbour is met twice;
* words with the same skipping pair differ in the skipped letter alone. There
  are no more of them than letters, so a pair keeps their number and its two
  best words instead of all pairs.

The numbers stand for whole strings, so the neighbours are exact. They are given
to the distinct 128-bit digests of the prefixes and suffixes, which a task
derives letter by letter: a very long word costs as many digests as it has
letters, not the square.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenreel.llm.common import arrow_types
from evenreel.session import written

#: Letters of a run, once A-Z are lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
LETTERS = 26 + 64
#: Every so many pairs of document and run, one loses a letter.
NOISE = 97
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
#: Distinct words that a task counts before it hands them on.
HELD = 200_000


def document_words(doc_id: object, text: str | None) -> Counter[str]:
    """Occurrences of the words of a text, some of them misspelt."""
    # bytes.lower knows A-Z only
    runs = Counter(RUN.findall((text or "").encode().lower().decode()))
    name = "" if doc_id is None else str(doc_id)
    words: Counter[str] = Counter()
    for run, n in runs.items():
        h = zlib.crc32(f"{name}:{run}".encode())
        at = h % len(run)
        words[run if h % NOISE else run[:at] + run[at + 1 :]] += n
    return words


def _count(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], schema=types)

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            for word, n in document_words(doc_id, text.as_py()).items():
                if len(word) >= LEAST_LETTERS:
                    counts[word] += n
            if len(counts) >= HELD:
                yield out()
                counts.clear()
    if counts:
        yield out()


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of enough letters and occurrences."""
    types = arrow_types("word string, n long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(lambda b: _count(b, types), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


_NODES = "word string, at int, f1 long, f2 long, b1 long, b2 long"


def _digests(word: str) -> list[bytes]:
    """Digest of each prefix, the empty one first."""
    state = xxhash.xxh3_128()
    out = [state.digest()]
    for letter in word:
        state.update(letter.encode())
        out.append(state.digest())
    return out


def _spell(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per word and place: digests of the prefix before it and of the suffix behind it."""
    for batch in batches:
        words, places, front, back = [], [], [], []
        for word in batch["word"].to_pylist():
            words += [word] * (len(word) + 1)
            places += range(len(word) + 1)
            front += _digests(word)
            back += reversed(_digests(word[::-1]))
            if len(words) >= HELD:
                yield _spelt(words, places, front, back, types)
                words, places, front, back = [], [], [], []
        if words:
            yield _spelt(words, places, front, back, types)


def _spelt(words: list, places: list, front: list[bytes], back: list[bytes], types: pa.Schema) -> pa.RecordBatch:
    f, b = (np.frombuffer(b"".join(x), dtype=np.int64).reshape(-1, 2) for x in (front, back))
    columns = [pa.array(words, pa.string()), pa.array(places, pa.int32()), *map(pa.array, (f[:, 0], f[:, 1], b[:, 0], b[:, 1]))]
    return pa.RecordBatch.from_arrays(columns, schema=types)


def numbered(spelt: DataFrame, one: str, two: str, node: str) -> DataFrame:
    """Numbers of the nodes of one trie: 1, 2, 3 ... with gaps."""
    nodes = spelt.select(one, two).distinct().withColumn(node, F.monotonically_increasing_id())
    return written(nodes, node)


def node_pairs(words: DataFrame) -> DataFrame:
    """``word, n, prefixes, suffixes``: node numbers before and behind every place of each word."""
    types = arrow_types(_NODES)
    spelt = written(words.select("word").mapInArrow(lambda b: _spell(b, types), _NODES), "spelt")
    rows = spelt.join(numbered(spelt, "f1", "f2", "prefix"), ["f1", "f2"]).select("word", "at", "prefix", "b1", "b2")
    rows = rows.join(numbered(spelt, "b1", "b2", "suffix"), ["b1", "b2"]).select("word", "at", "prefix", "suffix")
    places = F.sort_array(F.collect_list(F.struct("at", "prefix", "suffix")))  # of one word
    spread = rows.groupBy("word").agg(places.alias("_places"))
    return spread.join(words, "word").select(
        "word", "n", F.col("_places.prefix").alias("prefixes"), F.col("_places.suffix").alias("suffixes")
    )


def _better(n: Column | str, word: Column | str) -> Column:
    """Orders words by occurrences, then by code points: the least is the best."""
    return F.struct((-F.col(n)).alias("minus_n"), F.col(word).alias("word"))


def neighbours(pairs: DataFrame) -> DataFrame:
    """``word, n_near, best``: number and best of the words one edit away."""
    at = F.posexplode("suffixes").alias("_at", "_suffix")
    whole = pairs.select("word", "n", "prefixes", at).select(
        "word", "n", F.get("prefixes", F.col("_at")).alias("p"), F.col("_suffix").alias("s")
    )
    # a pair skips the letter between place _at - 1 and place _at
    skip = pairs.select("word", "n", "prefixes", at).where(F.col("_at") > 0)
    letter = F.substring(F.col("word"), F.col("_at"), F.lit(1))
    skip = skip.select(
        "word", "n", F.get("prefixes", F.col("_at") - 1).alias("p"), F.col("_suffix").alias("s"),
        ((F.col("_at") == 1) | (letter != F.substring(F.col("word"), F.col("_at") - 1, F.lit(1)))).alias("first"),
    )
    skip = written(skip, "skips")
    # replaced: the words of a pair differ in one letter, of which there are LETTERS at most
    two = F.slice(F.sort_array(F.collect_list(_better("n", "word"))), 1, 2)
    shared = skip.groupBy("p", "s").agg(F.count(F.lit(1)).alias("m"), two.alias("two")).where(F.col("m") > 1)
    other = F.when(F.col("two")[0]["word"] == F.col("word"), F.col("two")[1]).otherwise(F.col("two")[0])
    replaced = skip.join(shared, ["p", "s"]).select("word", (F.col("m") - 1).alias("near"), other.alias("best"))
    # one letter less, one letter more
    shorter = whole.select("p", "s", F.col("word").alias("short"), F.col("n").alias("short_n"))
    links = skip.where("first").join(shorter, ["p", "s"]).select("word", "n", "short", "short_n")
    both = F.array(
        F.struct(F.col("word").alias("word"), _better("short_n", "short").alias("best")),
        F.struct(F.col("short").alias("word"), _better("n", "word").alias("best")),
    )
    edited = links.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")
    return replaced.unionByName(edited).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form: the last form when forms are followed.

    A form has twice its word's occurrences at least, so chains are short, and a
    round doubles the steps taken.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        now = written(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), "_next"), "roots")
        if now.where(F.col("_next").isNotNull()).isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of enough letters and occurrences.

    Null and empty texts have no words; a null id counts as an empty one where
    letters are dropped; repeated rows count again; ties go to the word that is
    smaller by code points; an empty table gives an empty one; other columns are
    not read.
    """
    words = written(vocabulary(docs, doc_id=doc_id, text=text), "vocabulary")
    near = neighbours(written(node_pairs(words), "pairs"))  # read by both kinds of pairs
    best_n = -F.col("best.minus_n")
    is_form = best_n >= RATIO * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, best_n).alias("form_n"),
    )
    joined = written(joined, "variants")
    last = roots(joined.where(F.col("form").isNotNull()))
    return joined.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
