"""Exact top-k inner products by MaxScore (operator 2).

Dimensions are the terms of a query. A term adds at least ``min(q * low, q *
high)`` and at most the other end, with ``low`` and ``high`` the dimension's
extremes in a shard. Terms are sorted by how much they can vary; the smallest
ones are non-essential as long as together they cannot lift a vector from the
floor above the k-th best score so far. The essential postings are summed for
all vectors of the shard; a vector is probed in the other terms only while its
partial score plus what is still to come reaches the k-th best.

Vectors are packed into shards by the tasks that read them, queries into blocks.
Every (shard, block) pair is one unit of work, reached by an equi-join, and
sends k rows per query; the units' winners are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenreel.session import written

#: Vectors in a shard and queries in a block, at most.
SHARD_ROWS = 8_192
BLOCK_ROWS = 2_048
#: Terms that are probed at once.
STEP = 8

_PACK = pa.schema([
    ("pack", pa.int64()), ("dims", pa.int32()), ("uids", pa.binary()), ("ids", pa.binary()), ("null_ids", pa.binary()),
    ("values", pa.binary()),
])
_PACK_DDL = "pack long, dims int, uids binary, ids binary, null_ids binary, values binary"


def _stored(values: np.ndarray) -> bytes:
    return values.astype(np.int32).tobytes() if np.abs(values).max(initial=0) < 2**31 else values.tobytes()


def _packs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Pack rows (uid, id, list of whole numbers) into blocks of ``limit`` rows."""
    task, n = TaskContext.get().partitionId(), 0
    held: list[tuple] = []

    def pack(rows):
        dims = max(len(v) for _, _, v in rows)
        values = np.zeros((len(rows), dims))  # a shorter vector is zero in the rest
        for i, (_, _, v) in enumerate(rows):
            values[i, : len(v)] = v
        uids = np.array([u for u, _, _ in rows], dtype=np.int64)
        ids = np.array([0 if x is None else x for _, x, _ in rows], dtype=np.int64)
        null = np.array([x is None for _, x, _ in rows])
        one = [[(task << 33) + n], [dims], [uids.tobytes()], [ids.tobytes()], [null.tobytes()], [_stored(values)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, _PACK, strict=True)], schema=_PACK)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        held.extend(zip(*columns, strict=True))
        while len(held) >= limit:
            yield pack(held[:limit])
            held, n = held[limit:], n + 1
    if held:
        yield pack(held)


def max_score(
    values: np.ndarray, ids: np.ndarray, uids: np.ndarray, query: np.ndarray, own: int, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best rows: highest score, then smallest id.

    ``values`` are sorted by id. All numbers are whole and exact in doubles.
    """
    low, high = values.min(0), values.max(0)
    least = np.minimum(query * low, query * high)
    bound = np.maximum(query * low, query * high) - least  # at least 0: a term's score above its floor
    order = np.argsort(-bound, kind="stable")
    ahead = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0.0]])  # still to come after i terms
    base = least.sum()
    # a first threshold: k exact scores of the rows that are best in the heaviest terms
    head = order[:STEP]
    partial = values[:, head] @ query[head]
    partial[uids == own] = -np.inf
    if len(partial) > 4 * k:
        some = np.argpartition(-partial, 4 * k)[: 4 * k]
        exact = np.where(np.isfinite(partial[some]), values[some] @ query, -np.inf)
        floor = np.partition(exact, -k)[-k]
    else:
        floor = -np.inf
    # non-essential: terms that together can't lift the floor score above the threshold
    essential = max(int(np.searchsorted(-(base + ahead), -floor, side="right")), len(head))
    essential = min(essential, len(order))
    rest = order[len(head) : essential]
    partial = partial + values[:, rest] @ query[rest]
    alive = np.flatnonzero(np.isfinite(partial))
    partial = partial[alive]
    done = essential
    while True:
        # what the terms still to come add: their floors, and up to ``ahead`` more
        to_come = least[order[done:]].sum() + ahead[done]
        keep = partial + to_come >= floor
        alive, partial = alive[keep], partial[keep]
        if done >= len(order):
            break
        terms = order[done : done + STEP]
        partial = partial + values[np.ix_(alive, terms)] @ query[terms]
        done += len(terms)
    best = np.lexsort((alive, -partial))[:k]
    return alive[best], partial[best]


def _unpack(row: dict, prefix: str):
    dims = row[prefix + "dims"]
    uids = np.frombuffer(row[prefix + "uids"], dtype=np.int64)
    ids = np.frombuffer(row[prefix + "ids"], dtype=np.int64)
    null = np.frombuffer(row[prefix + "null_ids"], dtype=bool)
    raw = row[prefix + "values"]
    kind = np.int32 if len(raw) == 4 * dims * len(uids) else np.float64
    return uids, ids, null, np.frombuffer(raw, dtype=kind).reshape(len(uids), dims).astype(np.float64)


_FOUND = pa.schema([
    ("query_row", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()),
])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            uids, ids, null, values = _unpack(row, "s_")
            q_uids, q_ids, _, queries = _unpack(row, "q_")
            dims = max(values.shape[1], queries.shape[1])
            values = np.pad(values, ((0, 0), (0, dims - values.shape[1])))
            queries = np.pad(queries, ((0, 0), (0, dims - queries.shape[1])))
            sort = np.lexsort((uids, ids, null))
            uids, ids, null, values = uids[sort], ids[sort], null[sort], values[sort]
            limit = float(np.abs(values).max(initial=0)) * float(np.abs(queries).max(initial=0)) * dims
            if limit >= 2.0**52:  # beyond exact doubles: Python integers
                values = values.astype(object)
                values = np.frompyfunc(int, 1, 1)(values)
                queries = np.frompyfunc(int, 1, 1)(queries.astype(object))
            out = [[] for _ in _FOUND]
            for uid, qid, query in zip(q_uids, q_ids, queries, strict=True):
                if limit < 2.0**52:
                    at, scores = max_score(values, ids, uids, query, uid, k)
                else:
                    every = [(-(v @ query), j) for j, v in enumerate(values) if uids[j] != uid]
                    every = sorted(every)[:k]
                    at = np.array([j for _, j in every], dtype=int)
                    scores = [min(max(-s, -(2**63)), 2**63 - 1) for s, _ in every]
                out[0].extend([uid] * len(at))
                out[1].extend([qid] * len(at))
                out[2].extend(uids[at])
                out[3].extend(None if null[j] else ids[j] for j in at)
                out[4].extend(int(s) for s in scores)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)


def top_k(
    vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by ``every``.

    Vectors that are null, or hold a null or a non-finite component, take no
    part. Rows without an id are searched but ask nothing; they lose ties. Rows
    with one id are rows of their own: each asks, and each finds the others. A
    shorter vector counts as zero in the dimensions it lacks, an empty one
    scores 0. Whole numbers and scores beyond the range of a long are cut to it.
    An empty table
    gives an empty one; other columns are not read.
    """
    components = F.col(vector).cast("array<double>")
    bad = F.exists(components, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.where(components.isNotNull() & ~bad).select(
        F.col(vec_id).cast("long").alias("id"), F.transform(components, lambda x: F.floor(x * scale).cast("double")).alias("v")
    )
    rows = written(rows.select(F.monotonically_increasing_id().alias("uid"), "id", "v"), "vectors")
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    shards = written(rows.mapInArrow(lambda b: _packs(b, SHARD_ROWS), _PACK_DDL), "vector-shards")
    # few tasks, so that blocks are full: a query costs 1 / every of a vector
    n_blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    dealt = asked.repartition(n_blocks).select("uid", "id", "v")
    blocks = written(dealt.mapInArrow(lambda b: _packs(b, BLOCK_ROWS), _PACK_DDL), "query-blocks")
    numbers = shards.select("pack"), blocks.select("pack")
    shard_ids, block_ids = ([r[0] for r in x.orderBy("pack").collect()] for x in numbers)  # one per thousands of rows
    if not shard_ids or not block_ids:
        shard_ids = block_ids = [-1]
    left = shards.select(
        *[F.col(c).alias("s_" + c) for c in shards.columns], F.explode(F.array(*map(F.lit, block_ids))).alias("_block")
    )
    right = blocks.select(
        *[F.col(c).alias("q_" + c) for c in blocks.columns], F.explode(F.array(*map(F.lit, shard_ids))).alias("_shard")
    )
    units = left.join(right, (F.col("s_pack") == F.col("_shard")) & (F.col("q_pack") == F.col("_block")))
    columns = [p + c for p in ("s_", "q_") for c in ("dims", "uids", "ids", "null_ids", "values")]
    found = units.select(*columns).mapInArrow(
        lambda b: _search(b, k), "query_row long, query_id long, row long, vec_id long, score long"
    )
    order = W.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
