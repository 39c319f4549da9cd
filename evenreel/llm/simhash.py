"""SimHash near-duplicates with pivot distance tables (operator 7).

Distinct fingerprints are looked up, never documents: copies meet in one row.
Two fingerprints that differ in at most 3 of 64 bits agree in at least 2 of 5
blocks of bits, so each is dealt to ten buckets, one per pair of blocks. In a
bucket, a table of Hamming distances to reference fingerprints (the pivots)
discards pairs: by the triangle inequality, fingerprints whose distances to any
pivot differ by more than 3 cannot link. The survivors are verified bit by bit.
A bucket reports one link per fingerprint, to the smallest one it is connected
with there, never all pairs. Crowded buckets are cut again by blocks of the
bits that their members need not share, which loses no pair either.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenreel.llm.common import arrow_types, map_rows, row_ids, unpacked, whole_row
from evenreel.session import written

SEED = 42
WORDS = 3
DISTANCE = 3
BLOCKS = 5
#: Members from which on a bucket is cut again.
CROWDED = 1024
#: Reference fingerprints; their eight distances fill one long.
PIVOTS = tuple(xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(8))


def fingerprint(text: str | None) -> int:
    """64 bits over the words' shingles; 0 for a text without words."""
    # bytes.lower and bytes.split know ASCII only: A-Z, and blank, tab to carriage return
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    body = b" ".join(words)
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(body, SEED)
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: -WORDS])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(body[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :], strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int]) -> list[int]:
    """Masks of the pairs of ``BLOCKS`` even blocks of these bits."""
    blocks = [sum(1 << b for b in part) for part in np.array_split(np.array(bits, dtype=object), BLOCKS)]
    return [a | b for a, b in combinations(blocks, 2)]


MASKS = _cut(list(range(64)))
FINER = [_cut([b for b in range(64) if not mask >> b & 1]) for mask in MASKS]


def fingerprints(docs: DataFrame, *, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep``, a row id ``_row`` and the fingerprint ``_fp`` of each row, as signed long."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def start():
        ids = row_ids()
        return lambda rows: [
            {c: r[c] for c in keep} | {"_row": next(ids), "_fp": signed(fingerprint(r["_text"]))} for r in rows
        ]

    rows = docs.select(*keep, F.col(text).alias("_text"))
    return map_rows(rows, start, f"{kinds}, _row long, _fp long")


def pivot_table(fp: Column) -> Column:
    """Distances to the pivots, a byte each."""
    packed = F.lit(0).cast("long")
    for i, pivot in enumerate(PIVOTS):
        packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(signed(pivot)))).cast("long"), 8 * i))
    return packed


def _pairs(fps: np.ndarray, tables: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the pivots don't discard and that the bits confirm."""
    apart = np.abs(tables[i] - tables[j]).max(1)
    i, j = i[apart <= DISTANCE], j[apart <= DISTANCE]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= DISTANCE
    return i[near], j[near]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row number that each row is connected with."""
    root = np.arange(n)
    a = np.concatenate([p[0] for p in pairs]) if pairs else root[:0]
    b = np.concatenate([p[1] for p in pairs]) if pairs else root[:0]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(fps: np.ndarray, packed: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, smaller fingerprint) inside consecutive buckets that end at ``ends``."""
    tables = packed.view(np.uint8).reshape(-1, 8).astype(np.int16)
    sizes = np.diff(np.concatenate([[0], ends]))
    last = np.repeat(ends, sizes)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # partners at distance 1, 2, 3 ... in the bucket, for all small buckets at once
    small = np.repeat(sizes <= 64, sizes)
    i = np.flatnonzero(small)
    step = 1
    while len(i):
        i = i[i + step < last[i]]
        found.append(_pairs(fps, tables, i, i + step))
        step += 1
    for end, size in zip(ends[sizes > 64], sizes[sizes > 64], strict=True):
        # sorted by the first pivot's distance, a row meets only the rows up to 3 further
        rows = np.arange(end - size, end)
        rows = rows[np.argsort(tables[rows, 0], kind="stable")]
        first = tables[rows, 0]
        reach = np.searchsorted(first, first + DISTANCE, side="right")
        for at in range(size):
            j = rows[at + 1 : reach[at]]
            if len(j):
                found.append(_pairs(fps, tables, np.full(len(j), rows[at]), j))
    root = _roots(len(fps), found)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def _link(batches: Iterator[pa.RecordBatch], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Buckets come sorted; a bucket cut by the end of a batch waits for the next one."""
    held: pa.Table | None = None
    key = ("_table", "_value", "_table2", "_value2")

    def work(table: pa.Table) -> pa.RecordBatch:
        columns = {c: table[c].to_numpy() for c in (*key, "_fp", "_pivots")}
        change = np.zeros(len(table), dtype=bool)
        for c in key:
            change[:-1] |= columns[c][1:] != columns[c][:-1]
        change[-1:] = True
        a, b = bucket_links(
            columns["_fp"].astype(np.int64).view(np.uint64), columns["_pivots"].astype(np.int64), np.flatnonzero(change) + 1
        )
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=types)

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        last = [table[c][-1].as_py() for c in key]
        same = np.ones(len(table), dtype=bool)
        for c, v in zip(key, last, strict=True):
            same &= table[c].to_numpy() == v
        cut = len(table) - int(same.sum())  # sorted: the last bucket is the end of the table
        held = table.slice(cut)
        if cut:
            yield work(table.slice(0, cut))
    if held is not None and len(held):
        yield work(held)


def _keyed(fp: Column, masks: list[int]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(signed(m))).alias("v")) for i, m in enumerate(masks)
    ])


def links(distinct: DataFrame) -> DataFrame:
    """Links between distinct fingerprints ``_fp``: ``a`` and a smaller ``b`` it is connected with.

    ``b`` may be connected with ``a`` through others; the links join exactly the
    components of "at most 3 bits apart".
    """
    fp = F.col("_fp")
    rows = distinct.select(fp, pivot_table(fp).alias("_pivots"), F.explode(_keyed(fp, MASKS)).alias("_k"))
    rows = rows.select("_fp", "_pivots", F.col("_k.t").alias("_table"), F.col("_k.v").alias("_value"))
    sizes = rows.groupBy("_table", "_value").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    shared = rows.join(sizes, ["_table", "_value"])
    finer = F.element_at(F.array(*[_keyed(fp, m) for m in FINER]), F.col("_table") + 1)
    whole = F.array(F.struct(F.lit(-1).alias("t"), F.lit(0).cast("long").alias("v")))
    cut = F.when(F.col("_n") > CROWDED, finer).otherwise(whole)
    dealt = shared.select("_fp", "_pivots", "_table", "_value", F.explode(cut).alias("_k2")).select(
        "_fp", "_pivots", "_table", "_value", F.col("_k2.t").alias("_table2"), F.col("_k2.v").alias("_value2")
    )
    key = ["_table", "_value", "_table2", "_value2"]
    types = arrow_types("a long, b long")
    sorted_ = dealt.repartition(*key).sortWithinPartitions(*key, "_fp")
    return sorted_.mapInArrow(lambda b: _link(b, types), "a long, b long").distinct()


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One half of a round: hang neighbours on the smallest node around.

    Only minima are grouped; a node with very many neighbours is a skewed join,
    which Spark splits.
    """
    if not small:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = edges.join(least, "a")
    if small:
        moved = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
    return joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest node ``b`` of the component of each node ``a`` that isn't it.

    Alternating large and small stars over edges a > b, until nothing changes.
    Every round is a written table, so a lost executor costs one round.
    """
    edges = written(edges, "links")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        edges = written(_star(_star(edges, False), True), "links")
        before, now = now, state(edges)
        if before == now:
            break
    return edges


def near_duplicates(prints: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """Per distinct fingerprint: ``_fp``, component_id, and the row that represents the component.

    The representative is the row with the smallest id (null ids last).
    """
    first = F.struct(F.col(doc_id).isNull().alias("_null"), F.col(doc_id).alias("_id"), F.col("_row"))
    nodes = written(prints.groupBy("_fp").agg(F.min(first).alias("_first")), "fingerprints")
    roots = components(links(nodes.select("_fp")))
    rooted = nodes.join(roots.select(F.col("a").alias("_fp"), "b"), "_fp", "left")
    rooted = rooted.select("_fp", "_first", F.coalesce("b", "_fp").alias("_root"))
    best = rooted.groupBy("_root").agg(F.min("_first").alias("_best"))
    return rooted.join(best, "_root").select(
        "_fp", F.col("_best._id").alias("component_id"), F.col("_best._row").alias("_representative")
    )


def near_duplicate_ids(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for each row.

    Null and empty texts have the fingerprint zero and are near duplicates of
    each other; repeated rows share a component; a null id never names a
    component unless no member has another; an empty table gives an empty one;
    other columns are not read.
    """
    prints = written(fingerprints(docs, keep=("doc_id",)), "simhash")
    classes = near_duplicates(prints)
    shown = F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint")
    return prints.join(classes, "_fp").select("doc_id", shown, "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The row with the smallest id of every component, with all its columns.

    Texts without words are near duplicates of each other; a null id stands
    last; of repeated rows one stays; an empty table gives an empty one; columns
    of any name stay.
    """
    packed = docs.select("doc_id", "text", whole_row(docs).alias("_doc"))
    prints = written(fingerprints(packed, keep=("doc_id", "_doc")), "simhash")
    slim = prints.select("doc_id", "_row", "_fp")
    kept = near_duplicates(slim).select(F.col("_representative").alias("_row")).distinct()
    # most rows stay: the few that go are looked up
    gone = written(slim.select("_row").join(kept, "_row", "left_anti"), "copies")
    return unpacked(prints.join(gone, "_row", "left_anti"), "_doc", docs.columns)
