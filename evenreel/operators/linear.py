"""Least squares and truncated SVD over distributed rows.

Rows never travel to the driver. Tasks fold their rows into d x d sums, the
sums are folded again in as many slots as the square root of the cores, and the driver solves one
small system. ``MAX_DIM`` keeps that system small; `operators.wide` fits wider rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenreel.operators.vectors import dimension
from evenreel.session import dropped, laid_out, written

MAX_DIM = 1024
# cells of a block of a sparse matrix: twelve bytes each, in the memory of one task
BLOCK_CELLS = 1 << 25
# a matrix of more cells than this is worked on in several groups of dimensions, or in several blocks
GROUP_CELLS = 1 << 18
# cells of a block where the vectors of a pass are small beside the cells
THIN_CELLS = 1 << 22
# cells of a record, and of the records that a task takes at once
PACK_CELLS, RUN_CELLS = 1 << 16, 1 << 21
# column numbers of a chunk of vectors
CHUNK_COLS = 1 << 12


def _fold(frame: DataFrame, columns: Sequence[str], partial, width: int) -> np.ndarray:
    """Sum ``partial(batch) -> float array`` over every batch of a table."""
    schema = "slot int, sums array<double>"
    # a task of the second step takes about as many sums as the driver does at the end
    slots = max(4, math.isqrt(frame.sparkSession.sparkContext.defaultParallelism))

    def per_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(width), 0
        for batch in batches:
            if len(batch):
                total += partial(batch)
                rows += len(batch)
        if rows:
            slot = zlib.crc32(total.tobytes()) % slots
            yield pd.DataFrame({"slot": [slot], "sums": [total]})

    def per_slot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(width), 0
        for batch in batches:
            for sums in batch["sums"]:
                total += sums
                rows += 1
        if rows:
            yield pd.DataFrame({"slot": [0], "sums": [total]})

    folded = (
        frame.select(*columns)
        .mapInPandas(per_task, schema)
        .repartition(slots, "slot")
        .mapInPandas(per_slot, schema)
    )
    rows = folded.select("sums").collect()  # one row per slot
    return sum((np.asarray(r[0]) for r in rows), np.zeros(width))


@dataclass
class Moments:
    """Sums a linear model needs: rows, x, y, x'x, x'y, y'y."""

    n: float
    x: np.ndarray
    y: float
    xx: np.ndarray
    xy: np.ndarray

    def centred(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        mean_x, mean_y = self.x / self.n, self.y / self.n
        gram = self.xx - self.n * np.outer(mean_x, mean_x)
        cross = self.xy - self.n * mean_x * mean_y
        return gram, cross, mean_x, mean_y


def moments(frame: DataFrame, vector: str, target: str, d: int) -> Moments:
    if d > MAX_DIM:
        raise ValueError(f"{d} dimensions; above {MAX_DIM} fit sparse cells with operators.wide")

    def partial(batch: pd.DataFrame) -> np.ndarray:
        x = np.vstack(batch[vector].to_numpy()).astype("float64")
        y = batch[target].to_numpy(dtype="float64")
        return np.concatenate([[len(y), y.sum()], x.sum(0), (x.T @ x).ravel(), x.T @ y])

    usable = frame.where(F.col(vector).isNotNull() & F.col(target).isNotNull())
    sums = _fold(usable, [vector, target], partial, 2 + 2 * d + d * d)
    x, rest = sums[2 : 2 + d], sums[2 + d :]
    return Moments(sums[0], x, sums[1], rest[: d * d].reshape(d, d), rest[d * d :])


def ridge(m: Moments, reg: float) -> np.ndarray:
    """Ridge weights without an intercept."""
    return np.linalg.solve(m.xx + reg * np.eye(len(m.x)), m.xy)


@dataclass
class LinearFit:
    weights: np.ndarray
    intercept: float
    alpha: float


def alpha_grid(n: int = 24, low: float = -1.0, high: float = 3.5) -> np.ndarray:
    return 10.0 ** np.linspace(low, high, n)


def ridge_leave_one_out(
    frame: DataFrame, vector: str, target: str, alphas: np.ndarray | None = None
) -> LinearFit:
    """Ridge with an intercept, its strength chosen by leave-one-out error.

    Two passes: the centred moments, then the leave-one-out error of every
    strength at once from the leverages, e / (1 - h).
    """
    grid = alpha_grid() if alphas is None else np.asarray(alphas, dtype=float)
    d = dimension(frame, vector)
    m = moments(frame, vector, target, d)
    gram, cross, mean_x, mean_y = m.centred()
    values, basis = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    rotated = basis.T @ cross
    solutions = rotated[:, None] / (values[:, None] + grid[None, :])  # d x alphas
    inverse = 1.0 / (values[:, None] + grid[None, :])
    n = m.n

    def partial(batch: pd.DataFrame) -> np.ndarray:
        x = np.vstack(batch[vector].to_numpy()).astype("float64") - mean_x
        y = batch[target].to_numpy(dtype="float64") - mean_y
        z = x @ basis
        leverage = (z**2) @ inverse + 1.0 / n
        error = (y[:, None] - z @ solutions) / np.maximum(1.0 - leverage, 1e-12)
        return (error**2).sum(0)

    usable = frame.where(F.col(vector).isNotNull() & F.col(target).isNotNull())
    losses = _fold(usable, [vector, target], partial, len(grid))
    best = int(np.argmin(losses))
    weights = basis @ solutions[:, best]
    return LinearFit(weights, float(mean_y - mean_x @ weights), float(grid[best]))


def nonnegative(m: Moments, *, rounds: int = 20_000) -> LinearFit:
    """Least squares with an intercept and weights that may not be negative."""
    gram, cross, mean_x, mean_y = m.centred()
    weights = np.zeros(len(cross))
    for _ in range(rounds):
        before = weights.copy()
        for j in range(len(weights)):
            if gram[j, j] > 1e-12:
                gradient = cross[j] - gram[j] @ weights
                weights[j] = max(0.0, weights[j] + gradient / gram[j, j])
        if np.abs(weights - before).max(initial=0.0) < 1e-14:
            break
    return LinearFit(weights, float(mean_y - mean_x @ weights), 0.0)


def self_gram(frame: DataFrame, d: int) -> np.ndarray:
    """Inner products of the d columns of the row vectors ``vec``, one or several in a line."""

    def partial(batch: pd.DataFrame) -> np.ndarray:
        x = np.concatenate(batch["vec"].to_numpy()).reshape(-1, d)
        return (x.T @ x).ravel()

    return _fold(frame, ["vec"], partial, d * d).reshape(d, d)


def _whitening(gram: np.ndarray) -> np.ndarray:
    """Matrix that turns columns with this Gram matrix orthonormal."""
    values, basis = np.linalg.eigh(gram)
    keep = values > max(values.max(), 0.0) * 1e-12
    return basis[:, keep] / np.sqrt(values[keep])


@dataclass
class Decomposition:
    """Right singular vectors per column, singular values, total energy."""

    columns: DataFrame  # (col, vec)
    singular_values: np.ndarray
    energy: float

    @property
    def captured(self) -> float:
        return float((self.singular_values**2).sum() / self.energy) if self.energy else 0.0


class RowBlocks:
    """A sparse matrix (row, col, value) laid out once and read in place by every pass.

    Cells lie in blocks of whole rows, of up to ``BLOCK_CELLS`` cells, and a block once
    for every group of dimensions. A task holds a block and, of all column
    vectors, its group's dimensions alone; so what moves in a pass is the table of
    vectors, there and back, once per block. No cell moves. Columns have numbers, and
    vectors travel as chunks of neighbouring numbers. Cells without a column count as
    absent; rows without an id are one row.

    A group reads all cells of its block, so few dimensions make poor groups. Where
    ``width``, the dimensions of a pass, is given, every core gets a block of its own
    instead, and blocks hold ``THIN_CELLS`` at most, as long as the vectors that move
    there and back are no more bytes than the cells.
    """

    def __init__(self, cells: DataFrame, width: int | None = None) -> None:
        spark = cells.sparkSession
        cells = cells.select("row", "col", F.col("value").cast("double").alias("value"))
        self.cells = cells = written(cells.where("col is not null"), "cells")
        stats = cells.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("value")).alias("energy")).first()
        self.energy = float(stats["energy"] or 0.0)
        listed = written(cells.select("col").distinct().withColumn("_id", F.monotonically_increasing_id()), "columns")
        part = F.shiftright("_id", 33).alias("_part")
        sizes = listed.groupBy(part).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()  # one row per partition
        starts, self.n_cols = [], 0
        for r in sizes:
            starts.append((r["_part"], self.n_cols))
            self.n_cols += r["n"]
        starts = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
        number = F.col("_start") + F.col("_id") - F.shiftleft("_part", 33)
        self.numbers = listed.withColumn("_part", part).join(starts, "_part").select("col", number.alias("_number"))
        self.columns = listed.select("col")
        n, cores = int(stats["n"]), spark.sparkContext.defaultParallelism
        self.blocks = max(1, -(-n // BLOCK_CELLS))
        if width and self.n_cols:
            moved = 16 * self.n_cols * width  # a cell is 12 bytes, a column of a vector 8 there and 8 back
            wanted = max(-(-n // THIN_CELLS), min(-(-n // GROUP_CELLS), cores))
            self.blocks = max(self.blocks, min(wanted, 12 * n // moved))
        self.groups = max(1, min(-(-n // GROUP_CELLS), -(-cores // self.blocks)))
        self.packs = written(self._packed(), "packs")
        self.slots = _spread_keys(spark, self.blocks * self.groups)
        of_block = F.array(*[F.array(*[F.lit(x) for x in self.slots[b :: self.blocks]]) for b in range(self.blocks)])
        placed = self.packs.select(
            F.explode(of_block[F.pmod("_part", F.lit(self.blocks))]).alias("_slot"), "_pack", "_part", "first", "sizes", "cols", "vals"
        )
        self.laid = laid_out(placed, "_slot")

    def _packed(self) -> DataFrame:
        """Cells sorted by row, many to a record: the rows' sizes and names, columns' numbers, values.

        ``first`` numbers the first row within its partition, ``goes_on`` says that it began in the record before.
        """
        kind = self.cells.schema["row"].dataType.simpleString()
        parts = int(self.cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        parts = -(-parts // self.blocks) * self.blocks  # partitions are dealt to the blocks in turn
        rows = self.cells.join(self.numbers, "col").select("row", F.col("_number").cast("int").alias("at"), "value")
        rows = rows.repartition(parts, "row").sortWithinPartitions("row").withColumn("_part", F.spark_partition_id())
        fields = ["_pack", "_part", "first", "goes_on", "names", "sizes", "cols", "vals"]

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, seq, first, last = [], 0, 0, 0, None

            def record() -> pa.RecordBatch:
                nonlocal held, n, seq, first, last
                table = pa.Table.from_batches(held)
                coded = table["row"].combine_chunks().dictionary_encode(null_encoding="encode")
                at = coded.indices.to_numpy(zero_copy_only=False)
                begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                names = coded.dictionary.take(pa.array(at[begins]))
                goes_on = last is not None and names[0].as_py() == last[0]
                if last is not None and not goes_on:
                    first += 1
                part, sizes = table["_part"][0].as_py(), np.diff(np.append(begins, len(at))).astype("int32")
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                out = pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 32) + seq]), pa.array([part], pa.int32()), pa.array([first], pa.int32()), pa.array([goes_on]),
                        one(names), one(pa.array(sizes)), one(table["at"].combine_chunks()), one(table["value"].combine_chunks()),
                    ],
                    fields,
                )
                first, last, seq, held, n = first + len(begins) - 1, (names[-1].as_py(),), seq + 1, [], 0
                return out

            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    n += batch.num_rows
                if n >= PACK_CELLS:
                    yield record()
            if held:
                yield record()

        return rows.mapInArrow(
            pack,
            f"_pack long, _part int, first int, goes_on boolean, names array<{kind}>, sizes array<int>, cols array<int>, vals array<double>",
        )

    def chunks(self, vectors: DataFrame) -> DataFrame:
        """(col, vec) as (_chunk, at, vec): per chunk, places of the columns in it and their vectors in a line."""
        # Spark takes an array for a few bytes, and might send long vectors to every task through the driver
        return self.lined_up(vectors.hint("merge").join(self.numbers, "col"))

    def lined_up(self, vectors: DataFrame) -> DataFrame:
        """`chunks` of vectors that have their columns' numbers: (_number, vec)."""

        def line_up(part: pa.Table) -> pa.Table:
            part = part.sort_by("_number")
            chunk = part["_number"][0].as_py() // CHUNK_COLS
            at = (part["_number"].to_numpy() - chunk * CHUNK_COLS).astype("int32")
            return _chunk_table([(chunk, at, part["vec"].combine_chunks().flatten().to_numpy())])

        numbered = vectors.select(F.expr(f"_number div {CHUNK_COLS}").alias("_chunk"), "_number", "vec")
        return numbered.groupBy("_chunk").applyInArrow(line_up, _CHUNKS)

    def unchunked(self, chunks: DataFrame, matrix: np.ndarray) -> DataFrame:
        """(col, vec) of chunks, the vectors times a small matrix."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, at, vec in _records(batch, "_chunk", "at", "vec"):
                    number = pa.array(at.astype("int64") + chunk * CHUNK_COLS)
                    yield pa.RecordBatch.from_arrays([number, _lists(vec.reshape(-1, len(matrix)) @ matrix)], ["_number", "vec"])

        return chunks.mapInArrow(rows, "_number long, vec array<double>").join(self.numbers, "_number").select("col", "vec")

    def apply(self, chunks: DataFrame, matrix: np.ndarray, work, schema: str) -> DataFrame:
        """Run ``work(packs, side, dims)`` in every slot beside its dimensions of the vectors times a small matrix.

        The rows that ``work`` yields come with the number of their group of dimensions.
        """
        dims, blocks, slots = self.dims(matrix.shape[1]), self.blocks, self.slots

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk, at, vec in _records(batch, "_chunk", "at", "vec"):
                    turned = (vec.reshape(-1, len(matrix)) @ matrix).T
                    for i, slot in enumerate(slots):
                        mine = dims[i // blocks]
                        if len(mine):
                            part = _chunk_table([(chunk, at, turned[mine].ravel())])
                            yield from part.add_column(0, "_slot", pa.array([slot], pa.int32())).to_batches()

        def run(packs: pa.Table, side: pa.Table) -> pa.Table:
            group = slots.index((packs if packs.num_rows else side)["_slot"][0].as_py()) // blocks
            out = work(packs, side.slice(0, side.num_rows if packs.num_rows else 0), len(dims[group]))
            return out.add_column(0, "_group", pa.array([group] * out.num_rows, pa.int32()))

        side = chunks.mapInArrow(deal, "_slot int, " + _CHUNKS)
        return self.laid.groupBy("_slot").cogroup(side.groupBy("_slot")).applyInArrow(run, "_group int, " + schema)

    def dims(self, d: int) -> list[np.ndarray]:
        """The dimensions of every group."""
        return np.array_split(np.arange(d), self.groups)

    def _shares(self, chunks: DataFrame, matrix: np.ndarray) -> DataFrame:
        """A'(A V) of every block and group of dimensions, in chunks."""
        n = self.n_cols

        def work(packs: pa.Table, side: pa.Table, d: int) -> pa.Table:
            x = _side(side, d, n)
            runs = list(_runs(packs))
            y, z = _row_sums(runs, x), np.zeros_like(x)
            for low, sizes, at, value in runs:
                for j in range(d):
                    spread = np.repeat(y[j, low : low + len(sizes)], sizes)
                    z[j] += np.bincount(at, weights=value * spread, minlength=n)
            return _chunk_table(
                (chunk, at, z[:, chunk * CHUNK_COLS + at].ravel()) for chunk, at in _records(side, "_chunk", "at")
            )

        return self.apply(chunks, matrix, work, _CHUNKS)

    def image_chunks(self, chunks: DataFrame, matrix: np.ndarray) -> DataFrame:
        """A'(A V) for V the chunks' vectors times a small matrix, in chunks."""
        dims = self.dims(matrix.shape[1])

        def merge(part: pa.Table) -> pa.Table:
            return _chunk_table([_merged(part, dims)])

        return self._shares(chunks, matrix).groupBy("_chunk").applyInArrow(merge, _CHUNKS)

    def image(self, vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
        """A'(A V) for V the column vectors times a small matrix: (col, vec)."""
        return self.unchunked(self.image_chunks(self.chunks(vectors), matrix), np.eye(matrix.shape[1]))

    def gram(self, chunks: DataFrame, matrix: np.ndarray) -> np.ndarray:
        """(A V)'(A V), which is the sum of V'A'(A V) over the chunks."""
        n, d = matrix.shape
        dims = self.dims(d)

        def product(own: pa.Table, shares: pa.Table) -> pa.Table:
            if not own.num_rows or not shares.num_rows:
                return pa.table({"sums": pa.array([], pa.list_(pa.float64()))})
            vec = own["vec"].combine_chunks().flatten().to_numpy().reshape(-1, n)
            image = _merged(shares, dims)[2].reshape(-1, d)
            return pa.table({"sums": _lists(((vec @ matrix).T @ image).reshape(1, -1))})

        shares = self._shares(chunks, matrix)
        sums = chunks.groupBy("_chunk").cogroup(shares.groupBy("_chunk")).applyInArrow(product, "sums array<double>")
        return _fold(sums, ["sums"], lambda batch: np.sum(np.vstack(batch["sums"].to_numpy()), 0), d * d).reshape(d, d)

    def project(self, chunks: DataFrame, d: int) -> DataFrame:
        """(row, vec): A V. A row without a cell in the chunks' columns is left out."""
        n, dims = self.n_cols, self.dims(d)
        kind = self.cells.schema["row"].dataType.simpleString()
        schema = pa.schema([("_pack", pa.int64()), ("known", pa.list_(pa.bool_())), ("vec", pa.list_(pa.float64()))])

        def work(packs: pa.Table, side: pa.Table, d: int) -> pa.Table:
            x = np.zeros((d + 1, n))
            x[:d] = _side(side, d, n)
            for chunk, at in _records(side, "_chunk", "at"):
                x[d, chunk * CHUNK_COLS + at] = 1.0
            # a count per row of its cells in known columns comes last
            y = _row_sums([(low, sizes, at, value) for low, sizes, at, value in _runs(packs)], x, counted=True)
            out = []
            for pack, low, sizes in _placed(packs) if side.num_rows else ():
                mine = y[:, low : low + len(sizes)]
                out.append({"_pack": pack, "known": mine[d] > 0, "vec": mine[:d].ravel()})
            return pa.Table.from_pylist(out, schema)

        def name(packs: pa.Table, shares: pa.Table) -> pa.Table:
            if not packs.num_rows or not shares.num_rows:
                return pa.table({"row": packs["names"].combine_chunks().flatten().slice(0, 0), "vec": pa.array([], pa.list_(pa.float64()))})
            rows = packs["names"].combine_chunks().flatten()
            out = np.zeros((d, len(rows)))
            for group, known, vec in _records(shares, "_group", "known", "vec"):
                if len(dims[group]):
                    out[dims[group]] = vec.reshape(len(dims[group]), -1)
            keep = np.array(known, dtype=bool)
            if packs["goes_on"][0].as_py():
                keep[0] = False
            return pa.table({"row": rows.filter(pa.array(keep)), "vec": _lists(np.ascontiguousarray(out.T[keep]))})

        shares = self.apply(chunks, np.eye(d), work, "_pack long, known array<boolean>, vec array<double>")
        names = self.packs.select("_pack", "goes_on", "names")
        return names.groupBy("_pack").cogroup(shares.groupBy("_pack")).applyInArrow(name, f"row {kind}, vec array<double>")


_CHUNKS = "_chunk long, at array<int>, vec array<double>"


def _spread_keys(spark: SparkSession, n: int) -> list[int]:
    """Keys that Spark's hash deals to as many different partitions as there are."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tried = spark.range(0, 8 * max(n, parts), 1, 1).select(F.col("id").cast("int").alias("key"))
    rows = tried.select("key", F.pmod(F.hash("key"), F.lit(parts)).alias("part")).collect()  # eight per partition or key
    place, ranked = Counter(), []
    for r in rows:
        ranked.append((place[r["part"]], r["part"], r["key"]))
        place[r["part"]] += 1
    return [key for _, _, key in sorted(ranked)[:n]]


def _lists(matrix: np.ndarray) -> pa.ListArray:
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(matrix.ravel()))


def _chunk_table(chunks: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    number, at, vec = zip(*chunks, strict=True) if (chunks := list(chunks)) else ((), (), ())

    def lists(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
        ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0), *parts]) if parts else [], kind))

    return pa.table({"_chunk": pa.array(number, pa.int64()), "at": lists(at, pa.int32()), "vec": lists(vec, pa.float64())})


def _records(table: pa.Table | pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Values of some columns row by row, lists as arrays."""
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        columns = [batch[name] for name in names]
        for i in range(batch.num_rows):
            yield tuple(
                c[i].values.to_numpy(zero_copy_only=False) if pa.types.is_list(c.type) else c[i].as_py() for c in columns
            )


def _side(side: pa.Table, d: int, n: int) -> np.ndarray:
    """A line per dimension, a place per column of the matrix."""
    out = np.zeros((d, n))
    for chunk, at, vec in _records(side, "_chunk", "at", "vec"):
        out[:, chunk * CHUNK_COLS + at] = vec.reshape(d, -1)
    return out


def _merged(part: pa.Table, dims: Sequence[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """One chunk whose dimensions lie in several records, the blocks' shares added."""
    out = None
    for group, chunk, at, vec in _records(part, "_group", "_chunk", "at", "vec"):
        if out is None:
            out = np.zeros((sum(map(len, dims)), len(at)))
        out[dims[group]] += vec.reshape(len(dims[group]), -1)
    return chunk, at, out.T.ravel()


def _placed(packs: pa.Table) -> list[tuple[int, int, np.ndarray]]:
    """(pack, number of its first row in the block, sizes), in order."""
    found = sorted(_records(packs, "_part", "_pack", "first", "sizes"), key=lambda r: r[1])
    out, base, top, before = [], 0, 0, None
    for part, pack, first, sizes in found:
        if part != before:
            base, before = top, part
        out.append((pack, base + first, sizes))
        top = max(top, base + first + len(sizes))
    return out


def _runs(packs: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Neighbouring packs as one: number of the first row, sizes of the rows, columns, values."""
    cells = {pack: (at, value) for pack, at, value in _records(packs, "_pack", "cols", "vals")}
    held, n = [], 0
    for pack, low, sizes in _placed(packs):
        held.append((low, sizes, *cells[pack]))
        n += len(cells[pack][0])
        if n >= RUN_CELLS:
            yield _one_run(held)
            held, n = [], 0
    if held:
        yield _one_run(held)


def _one_run(parts: list[tuple]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    low = parts[0][0]
    sizes = np.zeros(parts[-1][0] + len(parts[-1][1]) - low, dtype="int64")
    for first, mine, *_ in parts:
        sizes[first - low : first - low + len(mine)] += mine  # a row may go on in the next pack
    return low, sizes, np.concatenate([p[2] for p in parts]).astype(np.intp), np.concatenate([p[3] for p in parts])


def _row_sums(runs: Iterable[tuple], x: np.ndarray, *, counted: bool = False) -> np.ndarray:
    """A V, a line per dimension; ``counted``: the last line counts cells, whatever their values."""
    runs = list(runs)
    out = np.zeros((len(x), max((low + len(sizes) for low, sizes, *_ in runs), default=0)))
    for low, sizes, at, value in runs:
        row = np.repeat(np.arange(len(sizes)), sizes)
        for j, line in enumerate(x):
            weights = line[at] if counted and j == len(x) - 1 else value * line[at]
            out[j, low : low + len(sizes)] += np.bincount(row, weights=weights, minlength=len(sizes))
    return out


def truncated_svd(
    cells: DataFrame | RowBlocks, k: int, *, iterations: int = 4, oversample: int = 8, seed: int = 0
) -> Decomposition:
    """Leading k right singular vectors of a sparse matrix of (row, col, value).

    Randomised subspace iteration. A round forms A'(A V) in one pass over the
    blocks of rows, then adds the blocks' shares per chunk of columns, so a column
    that every block holds is no hot spot. The sums are a written table of each
    round, which cuts their lineage; it is removed when the next one stands.
    """
    blocks = cells if isinstance(cells, RowBlocks) else RowBlocks(cells)
    k = max(1, min(k, blocks.n_cols))
    width = min(k + oversample, blocks.n_cols)
    if not blocks.energy:  # nothing but zeros: any direction will do
        flat = F.array(*[F.lit(0.0)] * k)
        return Decomposition(blocks.columns.withColumn("vec", flat), np.zeros(k), 0.0)
    # hash digits as a repeatable test matrix, uniform on [-1, 1]
    digits = f"pmod(xxhash64(col, {seed}, i), 1000003) / 500001.5D - 1"
    start = blocks.numbers.withColumn("vec", F.expr(f"transform(sequence(0, {width - 1}), i -> {digits})"))
    vectors, matrix = blocks.lined_up(start), np.eye(width)
    for _ in range(iterations):
        before, vectors = vectors, written(blocks.image_chunks(vectors, matrix), "vectors")
        dropped(before)
        matrix = _whitening(self_gram(vectors, matrix.shape[1]))
    values, rotation = np.linalg.eigh(blocks.gram(vectors, matrix))
    order = np.argsort(values)[::-1][:k]
    columns = written(blocks.unchunked(vectors, matrix @ rotation[:, order]), "vectors")
    dropped(vectors)
    return Decomposition(columns, np.sqrt(np.maximum(values[order], 0.0)), blocks.energy)


def project(cells: DataFrame | RowBlocks, columns: DataFrame, d: int) -> DataFrame:
    """Rows of a sparse matrix times the column vectors: (row, vec).

    Rows are whole in their blocks; their products are put together from the groups of
    dimensions. A row without a known column is left out.
    """
    blocks = cells if isinstance(cells, RowBlocks) else RowBlocks(cells)
    return blocks.project(blocks.chunks(columns), d)
