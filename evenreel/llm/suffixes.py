"""Removal of long repeated byte strings (operator 5).

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else in the corpus. Suffixes of the whole corpus need not be sorted for that:

1. Every window of ``LENGTH`` bytes picks an anchor, the leftmost minimum of the
   hashes of its ``GRAM``-byte strings. Equal windows pick equal anchors at equal
   offsets. Consecutive windows with one anchor form a run; its context is the
   stretch that its windows cover.
2. Runs with equal contexts repeat as a whole; counting 128-bit context hashes
   finds them. An anchor seen with one context only repeats nothing.
3. What is left - an anchor with several contexts, some of them unique - is
   where repeats begin and end. A window's anchor lies in one of nine bands of
   offsets, and all windows of a band hold the same ``LENGTH`` - 40 bytes around
   the anchor, the band's core. Contexts that share no core with another one
   repeat nothing. The others of an anchor meet in a task, which sorts their suffixes, takes the Burrows-Wheeler transform and
   derives common prefixes by increasing value: intervals of suffixes are
   extended backwards, breadth first, and the search stops at ``LENGTH``. Ranks
   without a value by then share ``LENGTH`` bytes with a neighbour.
4. An anchor with more than ``CROWDED`` contexts is not gathered. Its windows
   are counted by their own 128-bit hashes instead, with the same result.
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
from evenreel.session import written

LENGTH = 400
GRAM = 32
CROWDED = 2048
#: Offsets of a band; the cores are shorter than a window by one less.
BAND = 41
#: Bytes whose anchors are found in one sweep; positions in a sweep take 20 bits.
SWEEP = 1 << 20
#: Bytes of contexts that are sorted together, at least.
SORTED = 1 << 18


# -- anchors -------------------------------------------------------------------
def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes from each position on."""
    n = len(data) - GRAM + 1
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.empty(len(data), dtype=np.uint64)
    for shift in range(8):  # eight bytes from each position on
        part = padded[shift : shift + (len(data) + 7 - shift) // 8 * 8].view(np.uint64)
        words[shift::8] = part[: len(words[shift::8])]
    h = np.zeros(n, dtype=np.uint64)
    for i in range(0, GRAM, 8):
        h = (h ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xC2B2AE3D27D4EB4F)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def runs_of(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(document, first window, last window, anchor hash, anchor place) of the runs in pieces.

    A piece is (document, offset in it, bytes); together they fill one sweep.
    """
    data = np.frombuffer(b"".join(p for _, _, p in pieces), dtype=np.uint8)
    sizes = np.array([len(p) for _, _, p in pieces])
    hashes = gram_hashes(data)
    low = np.uint64(SWEEP - 1)
    ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    anchors = (window_minima(ranked, LENGTH - GRAM + 1) & low).astype(np.int64)
    # windows that cross into the next piece are none
    ends = np.cumsum(sizes)
    piece = np.repeat(np.arange(len(pieces)), sizes)[: len(anchors)]
    valid = np.flatnonzero(np.arange(len(anchors)) + LENGTH <= ends[piece])
    if not len(valid):
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    at, of = anchors[valid], piece[valid]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (of[1:] != of[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    of = of[first]
    shift = np.array([offset for _, offset, _ in pieces])[of] - (ends - sizes)[of]
    docs = np.array([d for d, _, _ in pieces])[of]
    return docs, valid[first] + shift, valid[last] + shift, hashes[at[first]], at[first] + shift


def document_runs(bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of all bodies: document, first, last, anchor hash."""
    parts, held, size = [], [], 0
    half = SWEEP // 2
    for d, body in enumerate(bodies):
        for offset in range(0, max(0, len(body) - LENGTH + 1), half):
            piece = body[offset : offset + half + LENGTH - 1]
            if size + len(piece) > SWEEP:
                parts.append(runs_of(held))
                held, size = [], 0
            held.append((d, offset, piece))
            size += len(piece)
    if held:
        parts.append(runs_of(held))
    if not parts:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    doc, first, last, anchor, place = (np.concatenate(c) for c in zip(*parts, strict=True))
    # a run cut between two pieces of a document is one
    joined = np.zeros(len(doc), dtype=bool)
    joined[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]) & (first[1:] == last[:-1] + 1)
    begin = np.flatnonzero(~joined)
    return doc[begin], first[begin], last[np.append(begin[1:], len(doc)) - 1], anchor[begin], place[begin]


_RUNS = "uid long, first int, last int, place int, anchor long, c1 long, c2 long"


def _scan(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            uids = batch.column(0).to_numpy()
            bodies = batch.column(1).to_pylist()
            doc, first, last, anchor, place = document_runs(bodies)
            if not len(doc):
                continue
            digest = xxhash.xxh3_128_digest
            spans = zip(doc.tolist(), first.tolist(), (last + LENGTH).tolist(), strict=True)
            contexts = np.frombuffer(b"".join([digest(bodies[d][a:b]) for d, a, b in spans]), dtype=np.int64).reshape(-1, 2)
            narrow = [x.astype(np.int32) for x in (first, last, place)]
            columns = [uids[doc], *narrow, anchor.view(np.int64), contexts[:, 0], contexts[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=types)


_CORES = "anchor long, uid long, first int, last int, unique boolean, core long"


def _core_hashes(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per context and band that its windows reach, with the hash of the core."""
    digest = xxhash.xxh3_64_digest
    for whole in batches:
        for at in range(0, whole.num_rows, 2048):
            batch = whole.slice(at, 2048)
            first, last, place = (batch[c].to_numpy() for c in ("first", "last", "place"))
            low, high = (place - last) // BAND, (place - first) // BAND
            row = np.repeat(np.arange(len(first)), high - low + 1)
            band = np.arange(len(row)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[row]
            begin = (place - first)[row] - band * BAND  # in the context; a core may begin before it
            texts = batch["context"].to_pylist()
            hashes = [
                digest(b"%d " % b + texts[r][max(0, i) : i + LENGTH - BAND + 1])
                for r, b, i in zip(row.tolist(), band.tolist(), begin.tolist(), strict=True)
            ]
            columns = [batch[c].take(pa.array(row)) for c in ("anchor", "uid", "first", "last", "unique")]
            core = pa.array(np.frombuffer(b"".join(hashes), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*columns, core], schema=types)


# -- contexts of one anchor ------------------------------------------------------
def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` symbols at least (prefix doubling)."""
    n = len(symbols)
    # the first key holds as many symbols as fit into a long
    width = max(1, int(symbols.max(initial=0) + 1).bit_length())
    covered = 62 // width
    padded = np.concatenate([symbols + 1, np.zeros(covered, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for i in range(covered):
        key = (key << width) | padded[i : i + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        if covered >= depth or rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: max(0, n - covered)] = rank[covered:] + 1
        key = rank * (n + 1) + ahead
        covered *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it; -1 where it is ``limit`` or more.

    Breadth-first backward extension: all intervals of suffixes that begin with
    some string of length l are extended by the symbols before them. An interval
    that ends where no value stands yet gives that rank the value l and goes on;
    any other is dropped.
    """
    n = len(symbols)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    before = symbols[order - 1].astype(np.int32)  # the transform
    back = rank[order - 1]  # rank of the suffix one symbol longer
    prefix = np.full(n + 1, -1, dtype=np.int32)
    prefix[0] = prefix[n] = 0
    heads = symbols[order]
    low = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))
    high = np.append(low[1:], n)
    prefix[high] = 0
    low, high = low[:-1], high[:-1]
    for value in range(1, limit):
        if not len(low):
            break
        width = high - low
        rows = np.repeat(high - np.cumsum(width), width) + np.arange(width.sum())
        if len(rows) == len(low):
            low, high = back[rows], back[rows] + 1
        else:
            interval = np.repeat(np.arange(len(low)), width)
            by = np.lexsort((back[rows], before[rows], interval))
            rows, interval = rows[by], interval[by]
            new = np.concatenate([[True], (interval[1:] != interval[:-1]) | (before[rows[1:]] != before[rows[:-1]])])
            first = np.flatnonzero(new)
            low, high = back[rows[first]], back[rows[np.append(first[1:], len(rows)) - 1]] + 1
        fresh = prefix[high] == -1
        low, high = low[fresh], high[fresh]
        prefix[high] = value
    return prefix


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per context, the starts of ``length`` bytes that also start elsewhere in the contexts."""
    n = len(contexts)
    sizes = np.array([len(c) + 1 for c in contexts])
    ends = np.cumsum(sizes)
    symbols = np.empty(int(ends[-1]), dtype=np.int64)
    text = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8)
    symbols[:] = text.astype(np.int64) + n
    symbols[ends - 1] = np.arange(n)  # each end is a symbol of its own
    order = suffix_order(symbols, length + 1)
    prefix = common_prefixes(symbols, order, length)
    shared = (prefix[:-1] == -1) | (prefix[1:] == -1)
    places = np.sort(order[shared])
    cuts = np.searchsorted(places, np.concatenate([[0], ends]))
    return [places[cuts[i] : cuts[i + 1]] - (ends[i] - sizes[i]) for i in range(n)]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Consecutive starts as (first, last)."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True))


_SPANS = "uid long, first int, last int"


def _compare(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Contexts come sorted by anchor; whole anchors are sorted together."""
    held: list[tuple] = []
    size = 0

    def work(rows):
        starts = repeated_starts([r[4] for r in rows])
        spans = [
            (r[1], r[2] + a, r[2] + b) for r, found in zip(rows, starts, strict=True) if r[3] and len(found) for a, b in _ranges(found)
        ]
        columns = list(zip(*spans, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "uid", "first", "unique", "context")]
        for row in zip(*columns, strict=True):
            if size >= SORTED and held[-1][0] != row[0]:
                yield work(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield work(held)


def _window_hashes(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            out = [[], [], [], [], []]
            for row in whole.slice(at, 256).to_pylist():
                context = row["context"]
                starts = range(len(context) - LENGTH + 1)
                digests = b"".join([xxhash.xxh3_128_digest(context[i : i + LENGTH]) for i in starts])
                out[0].extend([row["uid"]] * len(starts))
                out[1].extend(range(row["first"], row["first"] + len(starts)))
                out[2].extend([row["unique"]] * len(starts))
                pair = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
                out[3].append(pair[:, 0])
                out[4].append(pair[:, 1])
            columns = out[:3] + [np.concatenate(c) for c in out[3:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types, strict=True)], schema=types)


# -- the operator ----------------------------------------------------------------
def _kept(body: bytes, spans: list[dict] | None) -> dict:
    """What is left of a body without its windows from ``first`` to ``last``."""
    pieces, at, removed, n = [], 0, 0, 0
    end = None
    for span in sorted((s["first"], s["last"] + LENGTH) for s in spans or ()):
        if end is None or span[0] > end:
            if end is not None:
                at = end
            pieces.append(body[at : span[0]])
            removed -= span[0]
            n += 1
            end = span[1]
            removed += end
        elif span[1] > end:
            removed += span[1] - end
            end = span[1]
    pieces.append(body[end:] if end is not None else body)
    return {
        "n_bytes": len(body), "n_removed": removed, "n_spans": n, "kept_sha256": hashlib.sha256(b"".join(pieces)).hexdigest(),
        "n_kept": len(body) - removed,
    }


def repeated_spans(bodies: DataFrame) -> DataFrame:
    """uid, first, last: ranges of starts of ``LENGTH`` bytes that also start elsewhere."""
    types = arrow_types(_RUNS)
    runs = written(bodies.select("uid", "body").mapInArrow(lambda b: _scan(b, types), _RUNS), "runs")
    context = ["anchor", "c1", "c2"]
    # one row per distinct context; copies are counted before they are shuffled
    distinct = written(
        runs.groupBy(*context).agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "first", "last", "place")).alias("one")
        ),
        "contexts",
    )
    whole = runs.join(distinct.where(F.col("n") > 1).select(*context), context, "left_semi").select("uid", "first", "last")
    open_ = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("n") == 1).alias("unique"))
    open_ = open_.where((F.col("m") > 1) & (F.col("unique") > 0)).select("anchor")
    mixed = distinct.join(open_, "anchor").select("anchor", "one.*", (F.col("n") == 1).alias("unique"))
    cut = F.substring("body", F.col("first") + 1, F.col("last") - F.col("first") + LENGTH).alias("context")
    text = bodies.select("uid", "body")
    core_types = arrow_types(_CORES)
    cores = mixed.join(text, "uid").select("anchor", "uid", "first", "last", "place", "unique", cut)
    cores = written(cores.mapInArrow(lambda b: _core_hashes(b, core_types), _CORES), "cores")
    shared = cores.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.count_if("unique").alias("n"))
    shared = shared.where((F.col("m") > 1) & (F.col("n") > 0)).select("core")
    left = cores.join(shared, "core", "left_semi").select("anchor", "uid", "first", "last", "unique").distinct()
    left = written(left, "open-contexts")
    crowds = left.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1)
    texts = left.join(crowds, "anchor").join(text, "uid").select("anchor", "m", "uid", "first", "unique", cut)
    texts = written(texts, "mixed-contexts")
    span_types = arrow_types(_SPANS)
    few = texts.where(F.col("m") <= CROWDED).select("anchor", "uid", "first", "unique", "context")
    few = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda b: _compare(b, span_types), _SPANS)
    schema = "uid long, first int, unique boolean, w1 long, w2 long"
    hash_types = arrow_types(schema)
    many = texts.where(F.col("m") > CROWDED).select("uid", "first", "unique", "context")
    many = many.mapInArrow(lambda b: _window_hashes(b, hash_types), schema)
    seen = many.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    many = many.where("unique").join(seen, ["w1", "w2"], "left_semi").select("uid", "first", F.col("first").alias("last"))
    return whole.unionByName(few).unionByName(many)


def drop_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept of every row.

    All strings are judged on the input. A null text is an empty one; texts
    shorter than ``LENGTH`` bytes lose nothing; repeated rows are documents of
    their own, so longer ones lose everything; an empty table gives an empty
    one; other columns are not read.
    """
    bodies = bucketed_bodies(docs, doc_id, text)
    per_document = repeated_spans(bodies).groupBy("uid").agg(
        F.collect_list(F.struct("first", "last")).alias("spans")  # of one text: no longer than it
    )
    kind = bodies.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long"
    types = arrow_types(schema)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                rows = whole.slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"]} | _kept(r["body"], r["spans"]) for r in rows], schema=types)

    return bodies.join(per_document, "uid", "left").select("doc_id", "body", "spans").mapInArrow(remove, schema)
