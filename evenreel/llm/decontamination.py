"""Benchmark decontamination by BM25 with block-max pruning (operator 8).

The benchmark is the index, the corpus asks: every document is cut into
passages, each overlapping the next by half, so that any stretch as long as the
longest item lies in one passage. An item's threshold is what its words are
worth if as many of the best ones are missing as a 0.8 share of its five-word
shingles still allows; weights are divided by it, so that every item is to be
retrieved at score 1, and none with enough shingles can be missed. Items of
similar words lie in blocks; a passage whose words cannot add up to 1 even with
the block's best weights skips the block. Retrieved items are verified by the
share of their shingles that stands in the passage. Question and answer are only
guessed from one text, so their shares are reported and decide nothing: an answer
of one word has one shingle, which one changed word takes away.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenreel.llm.common import filter_rows, map_rows
from evenreel.operators.ordering import hash_rank

SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
BLOCK = 8
#: Items of one index; a larger benchmark takes several passes over the corpus.
INDEX_ITEMS = 1024
#: Bytes of text that are searched in one sweep.
SLAB = 1 << 20

_BLANK = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_POWERS = np.random.default_rng(7).integers(1, 1 << 63, 1024, dtype=np.uint64) * 2 + np.uint64(1)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def plain(text: str | None) -> bytes:
    """Lower case, with blanks for ASCII white space, punctuation and control characters."""
    return (text or "").lower().encode().translate(_BLANK)


def words_of(text: str | None) -> list[bytes]:
    return plain(text).split()


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at ``starts``, in one sweep."""
    letters = np.flatnonzero(data != 0x20)
    place = letters - np.repeat(starts, sizes)
    values = (data[letters].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023]
    h = np.add.reduceat(values, np.cumsum(sizes) - sizes)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def question_words(text: str) -> int:
    """Words before the answer: the last sentence, or the last third of a single one."""
    sentences = [s for s in _SENTENCE.split(text) if words_of(s)]
    n = len(words_of(text))
    if len(sentences) > 1:
        return n - len(words_of(sentences[-1]))
    return max(1, n - n // 3)


def shingles(ids: list[int], n: int = SHINGLE) -> list[tuple[int, ...]]:
    n = min(n, len(ids))
    return [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)] if n else []


class Index:
    """Impact-ordered blocks of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        texts = [(item, text, words_of(text)) for item, text in items]
        # similar items side by side: by their most frequent rare words
        seen = Counter(w for _, _, words in texts for w in set(words))
        texts = sorted((t for t in texts if t[2]), key=lambda t: (sorted(t[2], key=lambda w: -seen[w])[:3], len(t[2])))
        self.items = [item for item, _, _ in texts]
        self.vocabulary = {w: i for i, w in enumerate(seen)}
        packed = np.frombuffer(b" " + b" ".join(self.vocabulary) + b" ", dtype=np.uint8)
        sizes = np.array([len(w) for w in self.vocabulary], dtype=np.int64)
        hashes = word_hashes(packed, np.cumsum(sizes + 1) - sizes, sizes) if len(sizes) else np.zeros(0, np.uint64)
        self.numbers = np.argsort(hashes)
        self.hashes = hashes[self.numbers]
        self.longest = max((len(w) for _, _, w in texts), default=1)
        n, mean = len(texts), np.mean([len(w) for _, _, w in texts]) if texts else 1.0
        # per block the best weight of each word; the last row: other words
        self.bounds = np.zeros((len(self.vocabulary) + 1, -(-n // BLOCK)), dtype=np.float32)
        postings: list[tuple[np.ndarray, np.ndarray]] = []
        self.question: list[set] = []
        self.answer: list[set] = []
        for i, (_, text, words) in enumerate(texts):
            ids = [self.vocabulary[w] for w in words]
            every = shingles(ids)
            first = question_words(text)
            width = min(SHINGLE, len(ids))
            inside = max(1, first - width + 1)
            self.question.append(set(every[:inside]))
            self.answer.append(set(every[inside:]))
            worth = {}
            for word, tf in Counter(words).items():
                idf = math.log(1 + (n - seen[word] + 0.5) / (seen[word] + 0.5))
                worth[self.vocabulary[word]] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
            # a missing word takes at least one shingle with it
            missing = int((1 - OVERLAP) * len(set(every)) + 1e-9)
            least = sum(sorted(worth.values())[: max(1, len(worth) - missing)])
            terms = np.array(sorted(worth))
            weights = np.array([worth[t] / least for t in terms.tolist()], dtype=np.float32)
            postings.append((terms, weights))
            self.bounds[terms, i // BLOCK] = np.maximum(self.bounds[terms, i // BLOCK], weights)
        # the items' words and weights, item after item, and where each item begins
        self.terms = np.concatenate([t for t, _ in postings]) if n else np.zeros(0, np.int64)
        self.weights = np.concatenate([w for _, w in postings]) if n else np.zeros(0, np.float32)
        self.begins = np.cumsum([0, *(len(t) for t, _ in postings)])

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """Per text: item -> shares of its shingles, of its question's and of its answer's, best passage."""
        found: list[dict] = [{} for _ in texts]
        if not self.items:
            return found
        held, size = [], 0
        for i, text in enumerate(texts):
            for piece in self._pieces(plain(text)):
                held.append((i, piece))
                size += len(piece)
                if size >= SLAB:
                    self._search(held, found)
                    held, size = [], 0
        self._search(held, found)
        return found

    def _pieces(self, body: bytes):
        """Cut a very long text into stretches that share a passage of words."""
        at = 0
        while len(body) - at > SLAB:
            end = body.rfind(b" ", at, at + SLAB)
            end = end if end > at else body.find(b" ", at + SLAB)
            if end < 0:
                break
            piece = body[at:end]
            yield piece
            head = piece.rsplit(None, 2 * self.longest)[0] if len(piece) > SLAB // 2 else b""
            at = at + len(head) if head and head.strip() else end
        yield body[at:]

    def _numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word."""
        h = word_hashes(data, starts, sizes)
        place = np.searchsorted(self.hashes, h)
        place[place == len(self.hashes)] = 0
        return np.where(self.hashes[place] == h, self.numbers[place], len(self.vocabulary))

    def _search(self, held: list[tuple[int, bytes]], found: list[dict]) -> None:
        if not held:
            return
        data = np.frombuffer(b" " + b" ".join(p for _, p in held) + b" ", dtype=np.uint8)
        edge = np.diff((data != 0x20).view(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        if not len(starts):
            return
        step, other = self.longest, len(self.vocabulary)
        ids = self._numbers(data, starts, ends - starts)
        # words and half passages of each piece; a number is left out between pieces
        begins = np.cumsum([1, *(len(p) + 1 for _, p in held)])
        first_word = np.searchsorted(starts, begins)
        n_words = np.diff(first_word)
        base = np.concatenate([[0], np.cumsum(-(-n_words // step) + 1)])
        hits = np.flatnonzero(ids != other)
        if not len(hits):
            return
        piece = np.searchsorted(first_word, hits, side="right") - 1
        half = base[piece] + (hits - first_word[piece]) // step
        # each half passage's distinct known words
        keys = np.sort(half * other + ids[hits])
        keys = keys[np.diff(keys, prepend=-1) != 0]
        halves, terms = np.divmod(keys, other)
        first = np.flatnonzero(np.diff(halves, prepend=-1))
        bound = np.add.reduceat(self.bounds[terms], first, axis=0)
        number, last = halves[first], np.append(first[1:], len(terms))
        # a passage is a half and the next one; words of both count twice, so this only overrates
        after = np.flatnonzero(np.diff(number) == 1)
        bound[after] += bound[after + 1]
        likely = bound >= 1 - 1e-3
        there = np.zeros(other, dtype=bool)
        for h in np.flatnonzero(likely.any(1)).tolist():
            two = h + 1 < len(number) and number[h + 1] == number[h] + 1
            known = terms[first[h] : last[h + two]]
            there[known] = True
            good = [i for b in np.flatnonzero(likely[h]).tolist() for i in self._retrieved(b, there)]
            there[known] = False
            if good:
                k = int(np.searchsorted(base, number[h], side="right")) - 1
                begin = int(first_word[k] + (number[h] - base[k]) * step)
                passage = ids[begin : min(begin + 2 * step, int(first_word[k + 1]))].tolist()
                for i in good:
                    self._verify(i, passage, found[held[k][0]])

    def _retrieved(self, block: int, there: np.ndarray) -> list[int]:
        """Items of a block whose words ``there`` are worth their threshold."""
        begins = self.begins[block * BLOCK : (block + 1) * BLOCK + 1]
        part = slice(begins[0], begins[-1])
        scores = np.add.reduceat(self.weights[part] * there[self.terms[part]], begins[:-1] - begins[0])
        return (np.flatnonzero(scores >= 1 - 1e-3) + block * BLOCK).tolist()

    def _verify(self, i: int, passage: list[int], found: dict) -> None:
        question, answer = self.question[i], self.answer[i]
        width = len(next(iter(question)))
        there = set(shingles(passage, width)) if len(passage) >= width else set()  # unknown words match nothing
        in_question, in_answer = len(question & there), len(answer & there)
        share = len((question | answer) & there) / len(question | answer)
        parts = in_question / len(question), in_answer / len(answer) if answer else 1.0
        if share >= OVERLAP:
            found[self.items[i]] = max(found.get(self.items[i], (0.0, 0.0, 0.0)), (share, *parts))


def indexes(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text") -> list:
    """Broadcast indexes of at most ``INDEX_ITEMS`` items each.

    One is built at a time, so the driver holds so many items and no more. Items
    without a word are left out: nothing can contain them.
    """
    items = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("body"))
    ranked = hash_rank(items, F.md5(F.concat_ws(":", F.col("item").cast("string"), "body")), "_place", order=("item", "body"))
    n = benchmark.count()
    context = benchmark.sparkSession.sparkContext
    built = []
    for low in range(0, n, INDEX_ITEMS):
        part = ranked.where(F.col("_place").between(low + 1, low + INDEX_ITEMS)) if n > INDEX_ITEMS else items
        built.append(context.broadcast(Index([(r["item"], r["body"]) for r in part.orderBy("item", "body").collect()])))
    return built


def leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, overlap, question_overlap, answer_overlap of every leak.

    One row per row of ``docs`` and item that stands in it. Null and empty texts
    hold no leak, null and empty items leak nowhere, repeated rows and items
    with one id report their best passage each; an empty corpus or benchmark
    gives no rows; other columns are not read.
    """
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, overlap double, question_overlap double, answer_overlap double"
    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text")
    names = ("overlap", "question_overlap", "answer_overlap")
    parts = []
    for shared in indexes(benchmark):

        def start(shared=shared):
            index = shared.value
            return lambda rows: [
                {"doc_id": r["doc_id"], "item_id": item, **dict(zip(names, shares, strict=True))}
                for r, hits in zip(rows, index.search([r["text"] for r in rows]), strict=True)
                for item, shares in hits.items()
            ]

        parts.append(map_rows(rows, start, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item stands, with all their columns."""
    for shared in indexes(benchmark):

        def start(shared=shared):
            index = shared.value
            return lambda rows: [not hits for hits in index.search([r["text"] for r in rows])]

        docs = filter_rows(docs, ["text"], start)
    return docs
