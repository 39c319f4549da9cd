"""Minimax contiguous sharding (operator 3), with DataFrame functions only.

Rows with equal texts form one atomic group. Groups stand in the order of a
60-bit prefix of the text's MD5; the smallest capacity for which a greedy walk
needs no more than ``n_shards`` contiguous ranges is found by binary search.

The walk needs prefix sums near its cuts only. So the driver works on totals of
key ranges (at most ``RANGES`` at a time), finds between which positions every
cut must lie, and asks for finer totals of just those ranges, until each range
that may hold a cut is one single group. The answer is exact, and no pass sends
more than ``RANGES`` rows to the driver, however many groups there are.

A group that alone is at least the mean of what is left gets a shard of its own
first; otherwise its size would be everybody's capacity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenreel.session import written

KEY_BITS = 60
RANGES = 1 << 15
#: Rows that one numbering task is meant to hold.
SLOT_ROWS = 100_000


@dataclass
class Ranges:
    """Totals of consecutive key ranges, in key order."""

    low: np.ndarray
    high: np.ndarray
    total: np.ndarray
    largest: np.ndarray
    groups: np.ndarray

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.total)])


FIELDS = tuple(Ranges.__dataclass_fields__)


def _any(conditions: list[Column]) -> Column:
    """Disjunction as a balanced tree: a long chain is too deep for the analyser."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def group_key(text: Column) -> Column:
    """Order of the groups: the first 60 bits of the text's MD5 (null: empty)."""
    digits = F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, KEY_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _walk(starts: np.ndarray, capacity: int, n: int) -> list[int] | None:
    """Range numbers behind the greedy cuts; None if ``n`` shards don't suffice."""
    at, cuts, end = 0, [], len(starts) - 1
    for _ in range(n):
        at = int(np.searchsorted(starts, starts[at] + capacity, side="right")) - 1
        cuts.append(at)
        if at == end:
            return cuts
    return None


def smallest_capacity(starts: np.ndarray, low: int, high: int, n: int) -> int:
    """Binary search for the least capacity that ``n`` contiguous shards can keep."""
    while low < high:
        middle = (low + high) // 2
        if _walk(starts, middle, n) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _positions(r: Ranges, n: int) -> tuple[int, list[tuple[int, int]]]:
    """An upper bound of the capacity and, per cut, the positions it may take."""
    starts = r.starts()
    end = int(starts[-1])
    least = max(int(r.largest.max()), -(-end // n))
    most = smallest_capacity(starts, max(int(r.total.max()), -(-end // n)), end, n)

    def at(x: int) -> int:
        return min(int(np.searchsorted(starts, x, side="right")) - 1, len(r.total) - 1)

    def below(x: int) -> int:  # no later than the last group boundary up to x
        if x >= end:
            return end
        j = at(x)
        return max(int(starts[j]), x - int(r.largest[j]))

    def above(x: int) -> int:  # no sooner than the first group boundary from x on
        if x <= 0:
            return 0
        j = at(x)
        return min(int(starts[j + 1]), x + int(r.largest[j]))

    spans, early, late = [], 0, 0
    for _ in range(n):
        early, late = below(early + least), min(end, late + most)
        spans.append((early, late))
    back, low, high = [(end, end)], end, end
    for _ in range(n - 1):
        low, high = max(0, low - most), above(high - least)
        back.append((low, high))
    back.reverse()
    early = late = 0
    for k in range(n - 1):
        left = n - k
        early = max(back[k][0], below(early + (end - early) // left))
        late = max(back[k][1], late + (end - late) // left)
        spans.append((early, late))
    return most, spans + back


def _cuts(r: Ranges, capacity: int, n: int) -> list[int]:
    """Cut evenly: as near the mean of what is left as the capacity allows."""
    starts = r.starts()
    end, last = int(starts[-1]), len(r.total)
    must = [last]
    for _ in range(n - 1):
        must.append(int(np.searchsorted(starts, starts[must[-1]] - capacity, side="left")))
    must.reverse()
    cuts, at = [], 0
    for k in range(n):
        mean = int(starts[at]) + (end - int(starts[at])) // (n - k)
        fair = int(np.searchsorted(starts, mean, side="right")) - 1
        most = int(np.searchsorted(starts, starts[at] + capacity, side="right")) - 1
        at = min(max(must[k], fair), most)
        cuts.append(at)
    return cuts


def _totals(groups: DataFrame, bits: int) -> Ranges:
    prefix = F.shiftright("_key", KEY_BITS - bits)
    rows = (
        groups.groupBy(prefix.alias("_p"))
        .agg(F.min("_key"), F.max("_key"), F.sum("_size"), F.max("_size"), F.count(F.lit(1)))
        .orderBy("_p")
        .collect()  # at most RANGES rows
    )
    columns = np.array([tuple(x)[1:] for x in rows], dtype=np.int64).reshape(-1, 5).T
    return Ranges(*columns)


def _joined(parts: list[Ranges]) -> Ranges:
    columns = {x: np.concatenate([getattr(p, x) for p in parts]) for x in FIELDS}
    order = np.argsort(columns["low"], kind="stable")
    return Ranges(**{x: c[order] for x, c in columns.items()})


def partition_keys(groups: DataFrame, n_shards: int) -> tuple[list[int], list[int]]:
    """Keys with a shard of their own, and the last key of each further shard.

    ``groups`` has one row per atomic group: ``_key`` and ``_size`` above 0.
    """
    top = groups.orderBy(F.desc("_size"), "_key").limit(n_shards).collect()
    left = groups.agg(F.sum("_size")).first()[0] or 0
    alone: list[int] = []
    for row in top:
        free = n_shards - len(alone)
        if free == 1 or row["_size"] * free < left:
            break
        alone.append(row["_key"])
        left -= row["_size"]
    rest = groups.where(~F.col("_key").isin(alone)) if alone else groups
    n = n_shards - len(alone)
    bits = RANGES.bit_length() - 1
    r = _totals(rest, bits)
    if not len(r.total):
        return alone, []
    while True:
        most, spans = _positions(r, n)
        starts = r.starts()
        near = np.zeros(len(r.total), dtype=bool)
        for low, high in spans:
            first = max(0, int(np.searchsorted(starts, low, side="left")) - 1)
            near[first : int(np.searchsorted(starts, high, side="right"))] = True
        if not (near & (r.groups > 1)).any():
            break
        finer = max(1, (RANGES // int(near.sum())).bit_length() - 1)
        bits = min(KEY_BITS, bits + finer)
        places = np.flatnonzero(near)
        # no more stretches than spans
        stretches = np.split(places, np.flatnonzero(np.diff(places) > 1) + 1)
        wanted = _any([F.col("_key").between(int(r.low[x[0]]), int(r.high[x[-1]])) for x in stretches])
        far = Ranges(*(getattr(r, x)[~near] for x in FIELDS))
        r = _joined([far, _totals(rest.where(wanted), bits)])
    least = max(int(r.largest.max()), -(-int(r.total.sum()) // n))
    capacity = smallest_capacity(r.starts(), least, most, n)
    return alone, [int(r.high[c - 1]) if c else -1 for c in _cuts(r, capacity, n)]


def table_order(table: DataFrame) -> tuple[Column, Column] | None:
    """The order in which a Parquet table was written: part number and place in the part.

    None for a table that isn't read from files named by part. A column of the
    table may be called ``_metadata`` too.
    """
    try:
        hidden = table.metadataColumn("_metadata")
        table.select(hidden["file_name"], hidden["row_index"])
    except AnalysisException:
        return None
    if not all(re.match(r"part-\d", f.rsplit("/", 1)[-1]) for f in table.inputFiles()):
        return None
    # a part is one file unless the writer limits its rows: then its files are numbered on
    name = hidden["file_name"]
    number, following = (
        F.concat(F.lit("0"), F.regexp_extract(name, pattern, 1)).cast("long") for pattern in (r"^part-(\d+)", r"-c(\d+)\.")
    )
    return number * (1 << 20) + following, hidden["row_index"]


def shard(
    docs: DataFrame, n_shards: int, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", fixed: int = 16,
    order: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Deal rows into ``n_shards`` contiguous key ranges of nearly equal bytes.

    Returns ``keep`` and size, text_crc32, law (``bytes``), shard, slot (0, 1,
    2 ... in every shard) and grown_shard (null). A null text counts as an empty
    one; equal texts, so also repeated rows, share a shard; an empty table gives
    an empty one; other columns of any name are not read. Slots follow ``order``,
    a number of a stretch of rows and a place in it, or else a hash.
    """
    body = F.col(text)
    rows = docs.select(
        *keep,
        (text_bytes(body) + fixed).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        group_key(body).alias("_key"),
        *([order[0].alias("_stretch"), order[1].alias("_place")] if order else []),
    )
    rows = written(rows, "shard-rows")
    groups = written(rows.groupBy("_key").agg(F.sum("size").alias("_size")), "shard-groups")
    alone, ends = partition_keys(groups, n_shards)
    number = F.lit(len(alone))
    for end in ends[:-1]:
        number = number + (F.col("_key") > F.lit(end)).cast("int")
    for place, key in enumerate(alone):
        number = F.when(F.col("_key") == F.lit(key), F.lit(place)).otherwise(number)
    # slots: shards are cut into cells by stretch or row hash, so no task numbers a whole shard
    cells = max(1, rows.count() // (SLOT_ROWS * n_shards) + 1) * 8
    cell = F.col("_stretch") if order else F.pmod(F.xxhash64(*keep, "_key"), F.lit(cells)).cast("int")
    placed = rows.withColumn("shard", number.cast("int")).withColumn("_cell", cell)
    counts = placed.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("shard", "_cell").orderBy(*(["_place"] if order else []), "_key", *keep))
    return (
        placed.withColumn("_inside", inside)
        .join(offsets, ["shard", "_cell"])
        .select(
            *keep,
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("_before") + F.col("_inside") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
