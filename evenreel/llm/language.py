"""Language identification with error-correcting output codes (operator 6).

Each language has a binary codeword. For every bit a binary classifier over
hashed byte trigrams says on which side of the code a text lies; decoding adds
up the bits' losses against each codeword, weighted by the bits' reliability,
and takes the nearest codeword. A text whose two nearest codewords are about as
near is flagged as ambiguous.

The classifiers are log-odds of the trigram shares of the two sides of a bit, so
training is one distributed count over all labelled rows: no sample is drawn,
and what reaches the driver is ``FEATURES`` counts per language, however many
documents there are.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenreel.llm.common import filter_rows, map_rows

FEATURES = 1 << 12
#: Exhaustive codes up to so many languages, pseudo-random ones beyond.
EXHAUSTIVE = 6
#: Trigrams of evidence at which a bit's margin counts in full.
EVIDENCE = 64
#: Below this lead in score over the second language a text is ambiguous.
AMBIGUOUS = 0.05
UNDETERMINED = "und"

_BLANK = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def has_letter(text: str | None) -> bool:
    # signs such as ², ½ and ① are no letters
    return bool(text) and any(map(str.isalpha, text))


def trigram_counts(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text, all but letters as blanks."""
    body = b" ".join(text.lower().encode().translate(_BLANK).split())
    codes = np.frombuffer(b" " + body + b" ", dtype=np.uint8).astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(FEATURES, dtype=np.int64)
    mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    return np.bincount(mixed >> np.uint32(20), minlength=FEATURES)


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 per language; no two rows are equal."""
    if n < 2:
        return np.ones((n, 0), dtype=np.int8)
    if n <= EXHAUSTIVE:
        columns = [(1, *bits) for bits in itertools.product((1, -1), repeat=n - 1)][1:]
        return np.array(columns, dtype=np.int8).T
    bits = max(15, 10 * math.ceil(math.log2(n)))
    seed = 0
    while True:  # a first draw with equal rows is as good as impossible
        code = np.random.default_rng([n, seed]).choice(np.array([-1, 1], dtype=np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        if len(np.unique(code, axis=0)) == n:
            return code
        seed += 1


class Codebook:
    """The fitted classifiers and their decoding."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        self.code = codewords(len(languages))
        shares = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True) if len(languages) else counts
        weights, trust = [], []
        for bit in self.code.T:
            odds = np.log(shares[bit > 0].mean(0)) - np.log(shares[bit < 0].mean(0))
            mean = shares @ odds
            spread = np.sqrt(np.maximum(shares @ odds**2 - mean**2, 1e-12))
            # share of texts of EVIDENCE trigrams that the bit gets right
            z = bit * mean * math.sqrt(EVIDENCE) / spread
            trust.append(np.mean([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in z]))
            weights.append(odds)
        self.weights = np.array(weights).T.reshape(FEATURES, -1)
        self.trust = np.array(trust)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score in [0, 1], ambiguous - for each row of counts."""
        n = counts.sum(1, keepdims=True)
        margins = counts @ self.weights / np.maximum(n, 1) * np.minimum(n, EVIDENCE)
        # logistic loss of every bit against every codeword
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust
        chance = np.exp(loss.min(1, keepdims=True) - loss)
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        score = chance[np.arange(len(best)), best]
        ordered = np.sort(chance, 1)
        second = ordered[:, -2] if chance.shape[1] > 1 else np.zeros(len(best))
        return best, score, score - second < AMBIGUOUS


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Codebook:
    """Count trigrams per language over all rows with a language and a letter.

    The languages are a small set: each costs ``FEATURES`` counts on the driver.
    """

    def start():
        return lambda rows: _counted(rows)

    rows = docs.where(F.col(lang).isNotNull()).selectExpr(f"`{lang}` AS lang", f"`{text}` AS text")
    parts = map_rows(rows, start, "lang string, feature int, n long")
    counted = parts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    table = np.zeros((len(languages), FEATURES))
    places = pd.Categorical(counted["lang"], categories=languages).codes
    table[places, counted["feature"]] = counted["n"]
    return Codebook(languages, table)


def _counted(rows: list[dict]) -> list[dict]:
    sums: dict[str, np.ndarray] = {}
    for row in rows:
        if has_letter(row["text"]):
            counts = trigram_counts(row["text"])
            if row["lang"] in sums:
                sums[row["lang"]] += counts
            else:
                sums[row["lang"]] = counts
    return [
        {"lang": lang, "feature": int(f), "n": int(counts[f])}
        for lang, counts in sums.items()
        for f in np.flatnonzero(counts)
    ]


def predict(docs: DataFrame, book: Codebook, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and lang_pred, score, ambiguous for every row.

    A null text, and one without a letter, is ``und`` with score 0 and counts as
    ambiguous, and so is every text if no row had a language. Empty tables,
    repeated rows and null ids need no care: rows are judged one by one, on
    their whole text alone.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast(book)  # FEATURES x bits numbers
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def start():
        model = broadcast.value

        def work(rows):
            out = [{c: r[c] for c in keep} | {"lang_pred": UNDETERMINED, "score": 0.0, "ambiguous": True} for r in rows]
            known = [i for i, r in enumerate(rows) if model.languages and has_letter(r["_text"])]
            if known:
                counts = np.stack([trigram_counts(rows[i]["_text"]) for i in known])
                for i, best, score, doubt in zip(known, *model.decode(counts), strict=True):
                    out[i] |= {
                        "lang_pred": model.languages[best], "score": float(score), "ambiguous": bool(doubt),
                    }
            return out

        return work

    rows = docs.select(*keep, F.col(text).alias("_text"))
    return map_rows(rows, start, f"{kinds}, lang_pred string, score double, ambiguous boolean")


def fold(doc_id: Column) -> Column:
    """The document's fold, 0 to 3; fold 2 is held out. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def identify(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the folds 0, 1 and 3 and predict every row; adds ``held_out``."""
    held = fold(F.col("doc_id")) == 2
    book = fit(docs.where(~held))
    # ``keep`` may hold the labels for the output; the prediction sees _text only
    return predict(docs, book, keep=keep).withColumn("held_out", held)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is clear, with all their columns.

    Rows without a letter go, and so do ambiguous ones. Where no row has a
    language to learn from, nothing can be rejected for being ambiguous, and
    only rows without a letter go.
    """
    book = fit(docs.where(fold(F.col("doc_id")) != 2))
    broadcast = docs.sparkSession.sparkContext.broadcast(book)

    def start():
        model = broadcast.value

        def work(rows):
            keep = [has_letter(r["text"]) for r in rows]
            known = [i for i, k in enumerate(keep) if k and model.languages]
            if known:
                counts = np.stack([trigram_counts(rows[i]["text"]) for i in known])
                for i, doubt in zip(known, model.decode(counts)[2], strict=True):
                    keep[i] = not doubt
            return keep

        return work

    return filter_rows(docs, ["text"], start)
