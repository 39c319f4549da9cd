"""Removal of repeated passages of words by level-wise doubling (operator 12).

A word goes if a window of ``LENGTH`` words that covers it also starts in a
document with a smaller id. Windows are looked for at a short length first;
only those that repeat there are extended to twice that length:

1. Shortest level. Every window picks one of the short windows in it, its seed:
   the leftmost minimum of their hashes. Equal windows pick equal seeds at equal
   places, so a window whose seed stands nowhere else repeats nowhere.
   Consecutive windows with one seed form a run; the stretch that they cover is
   its context. Equal contexts are one row from here on, with their smallest id;
   contexts whose seed has no other context are settled by that id.
2. Each further level takes, in every window left, the window of that level
   around the one before it, pushed inside where it would stick out. Those that
   stand in documents with different ids survive.
3. At full length the smallest id of each surviving window decides.

With ``LENGTH`` 50 the levels are 13, 25 and 50 words. Shorter levels are known
by hashes of 64 bits, where a chance collision costs work, not results; contexts
and windows of full length by 128 bits of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenreel.llm.common import arrow_types, bucketed_bodies
from evenreel.llm.suffixes import window_minima
from evenreel.session import written

LENGTH = 50
#: The shortest level is at most so long.
SHORTEST = 16
#: Words whose seeds are found in one sweep.
SWEEP = 1 << 17
#: Of the tables written between the steps, which lie on disk all at once.
COMPRESSION = "zstd"
#: Distinct words whose hashes a task remembers.
REMEMBERED = 1 << 20


def levels(length: int) -> list[int]:
    """Window lengths, each at most twice the one before; two at least."""
    if length < 2:
        raise ValueError("a passage has two words at least")
    out = [length]
    while out[0] > SHORTEST or len(out) == 1:
        out.insert(0, -(-out[0] // 2))
    return out


class WordHashes(dict):
    """Hash of each word; the table starts anew when it has become too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each ``length`` consecutive words, by doubling."""
    out, have = words, 1
    while have < length:
        step = min(have, length - have)
        out = _mixed(out[: len(out) - step], out[step:])
        have += step
    return out


class Words:
    """A document's words, and where they stand once joined by single blanks."""

    def __init__(self, body: bytes):
        self.words = body.split()  # of bytes: blank, tab to carriage return
        self.joined = b" ".join(self.words)
        self.ends = np.cumsum(np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words)) + 1) - 1

    def __len__(self) -> int:
        return len(self.words)

    def digests(self, first: np.ndarray, last: np.ndarray) -> bytes:
        """128 bits of each stretch from word ``first`` to word ``last``."""
        starts = np.where(first > 0, self.ends[first - 1] + 1, 0).tolist()
        digest, joined = xxhash.xxh3_128_digest, self.joined
        return b"".join([digest(joined[a:b]) for a, b in zip(starts, self.ends[last].tolist(), strict=True)])


def seeds(hashes: np.ndarray, piece: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First window, last window, seed place, seed hash of the runs in consecutive pieces.

    ``hashes`` are those of the words, ``piece`` the number of the piece that each stands in.
    """
    short = levels(length)[0]
    if len(hashes) < length:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    of = window_hashes(hashes, short)
    low = np.uint64(2 * SWEEP - 1)
    ranked = (of & ~low) | np.arange(len(of), dtype=np.uint64)
    at = (window_minima(ranked, length - short + 1) & low).astype(np.int64)
    # windows that cross into the next piece are none
    valid = np.flatnonzero(piece[: len(at)] == piece[length - 1 :])
    at, of_piece = at[valid], piece[valid]
    if not len(valid):
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (of_piece[1:] != of_piece[:-1])]))
    last = np.append(first[1:], len(valid)) - 1
    return valid[first], valid[last], at[first], of[at[first]]


def _sweeps(documents: list[Words], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (document, first word, last word + 1) that together fill a sweep.

    Long documents are cut; the cuts overlap by one window less a word.
    """
    held, size = [], 0
    for d, words in enumerate(documents):
        for at in range(0, max(0, len(words) - length + 1), SWEEP):
            end = min(len(words), at + SWEEP + length - 1)
            if held and size + end - at > SWEEP:
                yield held
                held, size = [], 0
            held.append((d, at, end))
            size += end - at
    if held:
        yield held


_RUN = "first int, last int, place int, seed long, c1 long, c2 long"


def _scan(batches: Iterator[pa.RecordBatch], types: pa.Schema, length: int) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for whole in batches:
        for begin in range(0, whole.num_rows, 256):
            batch = whole.slice(begin, 256)
            documents = [Words(b) for b in batch.column("body").to_pylist()]
            for pieces in _sweeps(documents, length):
                parts = [documents[d].words[a:b] for d, a, b in pieces]
                sizes = np.array([len(p) for p in parts])
                hashes = np.concatenate([np.fromiter(map(known.__getitem__, p), dtype=np.uint64, count=len(p)) for p in parts])
                piece = np.repeat(np.arange(len(parts)), sizes)
                first, last, place, seed = seeds(hashes, piece, length)
                if not len(first):
                    continue
                of = piece[first]
                shift = np.array([a for _, a, _ in pieces])[of] - (np.cumsum(sizes) - sizes)[of]
                first, last, place = first + shift, last + shift, place + shift
                document = np.array([d for d, _, _ in pieces])[of]
                cuts = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
                contexts = b"".join(
                    documents[document[a]].digests(first[a:b], last[a:b] + length - 1)
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(document)], strict=True)
                )
                digest = np.frombuffer(contexts, dtype=np.int64).reshape(-1, 2)
                rows = pa.array(document)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("uid").take(rows), batch.column("doc_id").take(rows),
                        *[pa.array(x.astype(np.int32)) for x in (first, last, place)],
                        pa.array(seed.view(np.int64)), pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                    ],
                    schema=types,
                )


def level_starts(low: int, high: int, place: int, lengths: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    """(low, high, start): windows ``low`` to ``high`` whose window of this level begins at ``start``.

    ``lengths``: of the seed, of this level, in full. A window's part of this
    level holds the seed; it stands around it, but never outside the window.
    """
    short, length, full = lengths
    middle = place - (length - short) // 2
    if length == full:
        return [(s, s, s) for s in range(low, high + 1)]
    out = [(s, s, s + full - length) for s in range(low, min(high, middle - (full - length) - 1) + 1)]
    a, b = max(low, middle - (full - length)), min(high, middle)
    if a <= b:
        out.append((a, b, middle))
    out += [(s, s, s) for s in range(max(low, middle + 1), high + 1)]
    return out


_CANDIDATE = "c1 long, c2 long, first int, place int, low int, high int, w1 long, w2 long"


def _extend(batches: Iterator[pa.RecordBatch], types: pa.Schema, lengths: tuple[int, int, int]) -> Iterator[pa.RecordBatch]:
    """Windows of one level of each document's candidates."""
    for whole in batches:
        for begin in range(0, whole.num_rows, 64):
            batch = whole.slice(begin, 64)
            made: list[list] = [[] for _ in range(7)]
            hashes = []
            for d, row in enumerate(batch.select(["body", "open"]).to_pylist()):
                words = Words(row["body"])
                starts = []
                for c in row["open"]:
                    for low, high, start in level_starts(c["low"], c["high"], c["place"], lengths):
                        starts.append(start)
                        for column, value in zip(made, (d, c["c1"], c["c2"], c["first"], c["place"], low, high), strict=True):
                            column.append(value)
                at = np.array(starts, dtype=np.int64)
                hashes.append(words.digests(at, at + lengths[1] - 1))
            digest = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
            rows = pa.array(made[0], pa.int64())
            columns = [pa.array(c, f.type) for c, f in zip(made[1:], list(types)[2:8], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid").take(rows), batch.column("doc_id").take(rows), *columns, pa.array(digest[:, 0]), pa.array(digest[:, 1])],
                schema=types,
            )


def _earlier(doc, least):
    """Is ``least`` a smaller id than ``doc``? Null stands behind all ids."""
    return F.coalesce(least < doc, least.isNotNull() & doc.isNull())


def repeated_windows(bodies: DataFrame, length: int = LENGTH) -> DataFrame:
    """``uid, ranges``: per document, lists of (first, last) windows that also start under a smaller id."""
    kind = bodies.schema["doc_id"].dataType.simpleString()
    short, *further = levels(length)
    schema = f"uid long, doc_id {kind}, {_RUN}"
    types = arrow_types(schema)
    runs = written(bodies.select("uid", "doc_id", "body").mapInArrow(lambda b: _scan(b, types, length), schema), "runs", COMPRESSION)
    context = ["c1", "c2"]
    # the smallest id, null last, of each context; counted before it is shuffled
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid", "first", "last", "place")).alias("one")
    distinct = written(runs.groupBy("seed", *context).agg(F.count(F.lit(1)).alias("n"), one), "contexts", COMPRESSION)
    shared = distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1).select("seed")
    left = distinct.join(shared, "seed", "left_semi").select(
        *context, "one.uid", "one.first", "one.place", F.col("one.first").alias("low"), F.col("one.last").alias("high")
    )
    made = arrow_types(schema := f"uid long, doc_id {kind}, {_CANDIDATE}")
    for level in further:
        lengths = (short, level, length)
        asked = left.groupBy("uid").agg(  # of one document: no more than its words
            F.collect_list(F.struct("c1", "c2", "first", "place", "low", "high")).alias("open")
        )
        texts = asked.join(bodies, "uid").select("uid", "doc_id", "body", "open")
        rows = written(texts.mapInArrow(lambda b, n=lengths: _extend(b, made, n), schema), "level", COMPRESSION)
        ids = F.col("doc_id")
        seen = rows.groupBy("w1", "w2").agg(
            F.min(ids).alias("least"), F.max(ids).alias("most"), F.count_if(ids.isNull()).alias("nameless")
        )
        seen = seen.where((F.col("least") < F.col("most")) | (F.col("least").isNotNull() & (F.col("nameless") > 0)))
        left = rows.join(seen.select("w1", "w2", "least"), ["w1", "w2"])
    late = left.where(_earlier(F.col("doc_id"), F.col("least")))
    found = late.groupBy(*context).agg(  # of one context: shorter than two windows
        F.sort_array(F.collect_list(F.col("low") - F.col("first"))).alias("offsets")
    )
    settled = distinct.select(*context, "n", F.col("one.doc_id").alias("least")).join(found, context, "left")
    settled = settled.where((F.col("n") > 1) | F.col("offsets").isNotNull())
    alone = F.transform(
        F.coalesce("offsets", F.array().cast("array<int>")),
        lambda o: F.struct((F.col("first") + o).alias("first"), (F.col("first") + o).alias("last")),
    )
    ranges = F.when(_earlier(F.col("doc_id"), F.col("least")), F.array(F.struct("first", "last"))).otherwise(alone)
    return runs.join(settled, context).select("uid", ranges.alias("r")).where(F.size("r") > 0).groupBy("uid").agg(
        F.flatten(F.collect_list("r")).alias("ranges")
    )


def kept_words(body: bytes, ranges: list[dict] | None, length: int = LENGTH) -> dict:
    """What is left of a text without its windows from ``first`` to ``last``."""
    words = body.split()
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for r in ranges or ():
        gone[r["first"]] += 1
        gone[r["last"] + length] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    kept = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
    return {
        "n_words": len(words), "n_removed": len(words) - len(kept),
        "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest(), "n_kept": len(kept), "kept": b" ".join(kept),
    }


def drop_passages(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_kept of every row, and the text ``kept`` if asked for.

    Words are the stretches between blanks, tabs, line and page breaks; all
    windows are judged on the input. A null text has no words; shorter texts
    lose nothing; rows that share an id don't remove each other's words; a null
    id stands behind all others; an empty table gives an empty one; other
    columns are not read.
    """
    bodies = bucketed_bodies(docs, doc_id, text, COMPRESSION)
    kind = bodies.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, n_kept long" + ", kept string" * keep_text
    types = arrow_types(schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = whole.slice(at, 256).to_pylist()
                out = [{"doc_id": r["doc_id"]} | kept_words(r["body"], r["ranges"], length) for r in rows]
                yield pa.RecordBatch.from_pylist(out, schema=types)

    found = repeated_windows(bodies, length)
    return bodies.join(found, "uid", "left").select("doc_id", "body", "ranges").mapInArrow(remove, schema)
