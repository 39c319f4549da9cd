"""Boosted regression trees from histograms of gradients.

Columns are cut once at quantiles of the training rows, and rows are kept as one
byte per column. For each level of a tree tasks fold their rows into sums of
gradients per (node, column, bin), the sums of a column meet in one task that
picks its best cut, and the driver sees a cut per node and task. Leaves are
shrunk by an L2 term. The models of a cross-validation grow level by level
together, so that they share every pass.

Gradients are rounded to a unit that the ratings' spread and the number of rows set.
Sums of them are exact, and the trees are the same on any layout of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenreel.operators.vectors import as_double, dimension
from evenreel.session import written

LEAF = -1
#: Trees after which the rows' predictions are written; until then each pass adds the latest trees up.
TREES_PER_TABLE = 25
#: Error of a cut's rank, as a share of the rows, is 1 / ACCURACY.
ACCURACY = 10_000


@dataclass(frozen=True)
class TreeSettings:
    trees: int = 400
    depth: int = 4
    step: float = 0.05
    subsample: float = 0.8
    columns: float = 0.6
    min_child: int = 5
    l2: float = 2.0
    bins: int = 64
    seed: int = 0

    def __post_init__(self) -> None:
        if not 2 <= self.bins <= 256:
            raise ValueError("a bin is one byte: take 2 to 256 of them")


@dataclass
class Tree:
    """A binary tree laid out by levels: node i has the children 2i + 1 and 2i + 2."""

    column: np.ndarray
    cut: np.ndarray  # bins up to it go left
    value: np.ndarray

    @classmethod
    def of_depth(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, LEAF), np.zeros(n, dtype=int), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node, leaf or not yet split, in which each row stands.

        Columns are compared whole, so they had better lie in a line each.
        """
        kind, kind_of_bins = np.min_scalar_type(len(self.value)), bins.dtype.type  # bytes compare faster than whole numbers

        def below(node: int) -> np.ndarray | np.generic:
            if self.column[node] == LEAF:
                return kind.type(node)
            right = bins[:, self.column[node]] > kind_of_bins(self.cut[node])
            low, high = below(2 * node + 1), below(2 * node + 2)
            return low ^ ((low ^ high) * right)  # plain arithmetic on bytes is much faster than a choice per row

        return np.broadcast_to(below(0), len(bins))

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


@dataclass
class Forest:
    """Trees over binned columns: the mean rating plus what each tree adds."""

    edges: list[np.ndarray]
    start: float | None
    trees: list[Tree] = field(default_factory=list)

    def predict(self, vectors: np.ndarray) -> np.ndarray:
        bins = binned(vectors, self.edges)
        return sum((tree.values(bins) for tree in self.trees), np.full(len(vectors), float(self.start)))


def binned(vectors: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One byte per column: how many edges lie below the value; without a value none does."""
    out = np.zeros(vectors.shape, dtype=np.uint8, order="F")
    for i, cuts in enumerate(edges):
        known = ~np.isnan(vectors[:, i])
        out[known, i] = np.searchsorted(cuts, vectors[known, i], side="left")
    return out


def column_edges(rows: DataFrame, d: int, bins: int) -> list[np.ndarray]:
    """Distinct quantiles of every column, fewer than ``bins``, from sketches that tasks merge."""
    if d == 0:
        return []
    points = ", ".join(repr(i / bins) for i in range(1, bins))
    found = rows.agg(
        *[
            F.expr(f"percentile_approx(nullif(vec[{i}], double('NaN')), array({points}), {ACCURACY})").alias(f"q{i}")
            for i in range(d)
        ],
        *[F.expr(f"max(nullif(vec[{i}], double('NaN')))").alias(f"m{i}") for i in range(d)],
    ).first()
    # nothing lies above the greatest value, so it cuts nothing off
    return [np.array(sorted({q for q in found[f"q{i}"] or [] if q < found[f"m{i}"]})) for i in range(d)]


def drawn(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Numbers from 0 to 1 that depend on key, tree and seed alone."""
    offset = ((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF
    x = keys.astype("uint64") + np.uint64(offset)
    # fixed values: multipliers and shifts of a common 64-bit mixer
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def columns_of_tree(d: int, tree: int, s: TreeSettings) -> np.ndarray:
    """The columns a tree may cut: a share of all, at least one, drawn per tree."""
    order = np.argsort(drawn(np.arange(d), tree, s.seed + 1), kind="stable")
    return np.sort(order[: max(1, round(s.columns * d))])


class _Rows:
    """Rows binned by every model's edges, with its prediction so far, as a written table."""

    def __init__(self, rated: DataFrame, edges: list[list[np.ndarray]], starts: list[float]) -> None:
        self.models, self.d = len(edges), len(edges[0])

        def bin_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    vectors = np.vstack(batch["vec"].to_numpy()).astype(float)
                    bins = np.hstack([binned(vectors, cuts) for cuts in edges])
                    yield pd.DataFrame(
                        {
                            "key": batch["key"], "fold": batch["fold"], "rating": batch["rating"],
                            "bins": [b.tobytes() for b in bins],
                            "sums": [np.array(starts).tobytes()] * len(batch),
                        }
                    )

        self.schema = "key long, fold int, rating double, bins binary, sums binary"
        self.table = written(rated.select("key", "fold", "rating", "vec").mapInPandas(bin_rows, self.schema), "binned")

    def add(self, latest: list[list[Tree]]) -> None:
        """Write the predictions that the latest trees of each model lead to."""
        read = _reader(self.models, self.d)

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins, sums = read(batch, np.arange(batch.num_rows))
                    moved = pa.array([s.tobytes() for s in _advanced(bins, sums, latest)], pa.binary())
                    yield batch.set_column(batch.schema.get_field_index("sums"), "sums", moved)

        self.table = written(self.table.mapInArrow(step, self.schema), "binned")


def _reader(models: int, d: int):
    """Takes bins (model, column, row) and predictions (row, model) of some rows out of a batch."""

    def lines(column: pa.Array, width: int) -> np.ndarray:
        """The bytes of a column, a line per row; no row is an object of its own."""
        column = column.cast(pa.binary())
        ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(column), width)

    def read(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins = lines(batch["bins"], models * d)[rows]
        sums = lines(batch["sums"], 8 * models)[rows].view(float)
        return np.ascontiguousarray(bins.T).reshape(models, d, len(rows)), sums

    return read


def _advanced(bins: np.ndarray, sums: np.ndarray, latest: list[list[Tree]]) -> np.ndarray:
    sums = sums.copy()
    for m, trees in enumerate(latest):
        for tree in trees:
            sums[:, m] += tree.values(bins[m].T)
    return sums


_CUT = "model int, node int, gain double, col int, bin int, left_sum double, left_rows double, sum double, rows double"


def _best_cuts(rows: _Rows, latest, growing: list[Tree], level: int, tree: int, s: TreeSettings, unit: float) -> list:
    """The best cut of every node of one level, found per column; ties to the first column, then bin."""
    read = _reader(rows.models, rows.d)
    models, first, width, bins_n = rows.models, 2**level - 1, 2**level, s.bins
    cols = columns_of_tree(rows.d, tree, s)
    cells = width * bins_n

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, models * width, len(cols), bins_n))
        for batch in batches:
            rows = np.flatnonzero(drawn(batch["key"].to_numpy(), tree, s.seed) < s.subsample)
            if not len(rows):
                continue
            bins, sums = read(batch, rows)
            sums = _advanced(bins, sums, latest)
            fold, rating = batch["fold"].to_numpy()[rows], batch["rating"].to_numpy()[rows]
            for m in range(models):
                node = growing[m].nodes(bins[m].T).astype(np.intp) - first
                use = np.flatnonzero((fold != m) & (node >= 0))
                if len(use):
                    start = node[use] * bins_n
                    slope = np.rint((sums[use, m] - rating[use]) / unit)
                    own = total[:, m * width : (m + 1) * width]
                    for i, col in enumerate(cols):
                        place = start + bins[m, col][use]
                        own[0, :, i] += np.bincount(place, slope, cells).reshape(width, bins_n)
                        own[1, :, i] += np.bincount(place, minlength=cells).reshape(width, bins_n)
        if total[1].any():
            sums = pa.array([total[:, :, i].tobytes() for i in range(len(cols))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cols, pa.int32()), sums], ["col", "sums"])

    def cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns: dict[int, np.ndarray] = {}
        for batch in batches:
            for col, raw in zip(batch["col"], batch["sums"]):
                part = np.frombuffer(raw, dtype=float).reshape(2, models * width, bins_n)
                columns[col] = columns[col] + part if col in columns else part
        best: dict[int, tuple] = {}
        for col in sorted(columns):
            slope, count = columns[col].cumsum(axis=2)
            all_slope, all_count = slope[:, -1:], count[:, -1:]
            right_slope, right_count = all_slope - slope, all_count - count
            gain = (
                slope**2 / (count + s.l2 + 1e-300)
                + right_slope**2 / (right_count + s.l2 + 1e-300)
                - all_slope**2 / (all_count + s.l2 + 1e-300)
            ) * unit**2
            gain = np.where((count >= max(s.min_child, 1)) & (right_count >= max(s.min_child, 1)), gain, -np.inf)
            for i, b in enumerate(gain.argmax(axis=1)):
                if all_count[i, 0] and (i not in best or gain[i, b] > best[i][2]):
                    best[i] = (
                        i // width, first + i % width, gain[i, b], col, b,
                        slope[i, b], count[i, b], all_slope[i, 0], all_count[i, 0],
                    )
        if best:
            yield pd.DataFrame(list(best.values()), columns=[c.split()[0] for c in _CUT.split(", ")])

    found = rows.table.mapInArrow(histograms, "col int, sums binary").repartition("col").mapInPandas(cuts, _CUT).collect()
    nodes: dict[tuple[int, int], object] = {}
    for cut in found:
        at = (cut["model"], cut["node"])
        if at not in nodes or (-cut["gain"], cut["col"]) < (-nodes[at]["gain"], nodes[at]["col"]):
            nodes[at] = cut
    return list(nodes.values())


def _grow(rows: _Rows, latest: list[list[Tree]], tree: int, s: TreeSettings, unit: float) -> list[Tree]:
    """The next tree of every model."""
    growing = [Tree.of_depth(s.depth) for _ in range(rows.models)]
    leaf = lambda slope, count: -s.step * slope * unit / (count + s.l2) if count else 0.0
    for level in range(s.depth):
        split = False
        for cut in _best_cuts(rows, latest, growing, level, tree, s, unit):
            grown, node = growing[cut["model"]], cut["node"]
            if node == 0:
                grown.value[0] = leaf(cut["sum"], cut["rows"])
            if cut["gain"] > 1e-9:
                split = True
                grown.column[node], grown.cut[node] = cut["col"], cut["bin"]
                grown.value[2 * node + 1] = leaf(cut["left_sum"], cut["left_rows"])
                grown.value[2 * node + 2] = leaf(cut["sum"] - cut["left_sum"], cut["rows"] - cut["left_rows"])
        if not split:
            break
    return growing


def boosted(rated: DataFrame, folds: int | None, s: TreeSettings) -> list[Forest]:
    """Forests on (row, rating, vec, and fold where ``folds`` is given).

    With folds, forest f is fitted on all rows but those of fold f, cuts of columns
    included; it is the forest that these rows alone would give, up to the gradients'
    unit. Rows without rating or vector take no part, equal rows count apart, a value
    that is missing goes to a column's lowest bin. A model without rows has no
    start and no trees.
    """
    usable = rated.where(F.col("rating").isNotNull() & ~F.isnan(F.col("rating").cast("double")) & F.col("vec").isNotNull())
    usable = usable.select(
        F.xxhash64("row").alias("key"),
        (F.lit(-1) if folds is None else F.col("fold")).cast("int").alias("fold"),
        F.col("rating").cast("double").alias("rating"),
        as_double("vec").alias("vec"),
    )
    models, d = folds or 1, dimension(usable, "vec")
    facts = usable.agg(
        F.count(F.lit(1)).alias("n"), F.min("rating").alias("low"), F.max("rating").alias("high"),
        *[F.avg(F.when(F.col("fold") != m, F.col("rating").cast("decimal(28,9)"))).alias(f"mean{m}") for m in range(models)],
    ).first()
    means = [facts[f"mean{m}"] for m in range(models)]
    starts = [None if mean is None else float(mean) for mean in means]
    edges = [column_edges(usable.where(F.col("fold") != m), d, s.bins) for m in range(models)]
    forests = [Forest(cuts, start) for cuts, start in zip(edges, starts)]
    spread = 0.0 if facts["low"] is None else facts["high"] - facts["low"]
    if d == 0 or spread == 0.0:
        return forests
    # as fine as sums of all rows' slopes, of four times the spread at most, stay whole in a double
    unit = 2.0 ** (math.ceil(math.log2(spread)) + 2 + math.ceil(math.log2(facts["n"])) - 53)
    rows = _Rows(usable, edges, [0.0 if start is None else start for start in starts])
    latest: list[list[Tree]] = [[] for _ in range(models)]
    for tree in range(s.trees):
        if len(latest[0]) == TREES_PER_TABLE:
            rows.add(latest)
            latest = [[] for _ in range(models)]
        for m, grown in enumerate(_grow(rows, latest, tree, s, unit)):
            latest[m].append(grown)
            forests[m].trees.append(grown)
    return forests
