"""Ridge over sparse rows of any width.

No product of columns with columns is ever formed. One pass over the blocks of
rows multiplies several column vectors by A'A at once, and a Lanczos recurrence
on these vectors shrinks the centred problem to a small tridiagonal one that
holds the solution for every strength. The strength is the one of least
generalised cross-validation error, whose trace is estimated by sign vectors
over the rows that take part in the same passes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenreel.operators.linear import RowBlocks, alpha_grid
from evenreel.session import written


@dataclass
class WideFit:
    """One weight per column, the intercept, the strength, and the passes it took."""

    weights: DataFrame  # (col, weight)
    intercept: float | None
    alpha: float
    passes: int

    def score(self, cells: DataFrame) -> DataFrame:
        """(row, score): the rows times the weights, without the intercept; unknown columns count as absent."""
        known = cells.select("row", "col", "value").join(self.weights, "col")
        return known.groupBy("row").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))


class Recurrence:
    """Tridiagonal matrix of one start vector, grown by a row per pass."""

    def __init__(self) -> None:
        self.length = 0.0
        self.diagonal: list[float] = []
        self.beside: list[float] = []
        self.done = False

    def spectrum(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues, and eigenvectors as columns."""
        t = np.diag(self.diagonal) + np.diag(self.beside, 1) + np.diag(self.beside, -1)
        values, basis = np.linalg.eigh(t)
        return np.maximum(values, 0.0), basis

    def gains(self, alphas: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per strength a: b'(C + a)^-1 b and b'(C + a)^-1 C (C + a)^-1 b, for start vector b."""
        if not self.diagonal:
            return np.zeros(len(alphas)), np.zeros(len(alphas))
        values, basis = self.spectrum()
        share = (self.length * basis[0]) ** 2
        below = values[:, None] + alphas[None, :]
        return (share[:, None] / below).sum(0), (share[:, None] * values[:, None] / below**2).sum(0)

    def solution(self, alpha: float) -> np.ndarray:
        """(T + alpha)^-1 times the start vector, in the basis of the passes."""
        values, basis = self.spectrum()
        return basis @ (self.length * basis[0] / (values + alpha))


def wide_ridge(
    cells: DataFrame,
    targets: DataFrame,
    *,
    alphas: Sequence[float] | None = None,
    probes: int = 8,
    tolerance: float = 1e-10,
    max_passes: int = 500,
    seed: int = 0,
) -> WideFit:
    """Ridge with an intercept on a sparse matrix: ``cells`` (row, col, value), ``targets`` (row, rating).

    A row has one rating. One without cells counts as zeros, one without a rating
    takes no part, and cells given twice add up. The fit is done when the slope of the penalised
    error is ``tolerance`` of the one at weights zero; not reaching it within
    ``max_passes`` is an error. Without rated rows the intercept is None, without
    cells there are no weights.
    """
    grid = alpha_grid() if alphas is None else np.asarray(alphas, dtype=float)
    rated = written(targets.where("row is not null and rating is not null").select("row", F.col("rating").cast("double")), "targets")
    facts = rated.agg(F.count(F.lit(1)).alias("n"), F.avg("rating").alias("mean")).first()
    n, mean = int(facts["n"]), facts["mean"]
    signs = [f"if(pmod(xxhash64(row, {seed}, {i}), 2) = 0, 1D, -1D)" for i in range(probes)]
    sides = rated.select("row", F.expr(f"array({', '.join([f'rating - {mean or 0.0!r}D', *signs])})").alias("t"))
    width = probes + 1
    blocks = RowBlocks(cells.join(rated, "row", "left_semi"), width)
    if not n or not blocks.n_cols:
        nothing = blocks.columns.select("col", F.lit(0.0).alias("weight"))
        return WideFit(nothing, mean, float(grid[-1]), 0)
    sums = sides.agg(
        *[F.expr(f"sum(t[{j}])").alias(f"s{j}") for j in range(width)], F.expr("sum(t[0] * t[0])").alias("yy")
    ).first()
    middle = np.array([sums[f"s{j}"] / n for j in range(width)])
    energy = sums["yy"] - n * middle[0] ** 2
    signs_energy = np.array([n * (1.0 - m * m) for m in middle[1:]])

    starts = [f"sum(value * t[{j}]) - {float(middle[j])!r}D * sum(value)" for j in range(width)]
    state = blocks.cells.join(sides, "row").groupBy("col").agg(
        F.expr(f"sum(value) / {n}").alias("mean"),
        F.expr(f"array({', '.join(starts)})").alias("vec"),
        F.expr(f"array_repeat(0D, {width})").alias("prev"),
    )
    state = written(state, "directions")
    runs = [Recurrence() for _ in range(width)]
    basis: list[DataFrame] = []
    for passes in range(1, max_passes + 1):
        image = blocks.image(state.select("col", "vec"), np.eye(width)).withColumnRenamed("vec", "img")
        table = written(state.join(image, "col"), "directions")
        found = table.agg(
            *[F.expr(f"sum(vec[{j}] * vec[{j}])").alias(f"uu{j}") for j in range(width)],
            *[F.expr(f"sum(img[{j}] * vec[{j}])").alias(f"iu{j}") for j in range(width)],
            *[F.expr(f"sum(mean * vec[{j}])").alias(f"mu{j}") for j in range(width)],
        ).first()
        beta = np.sqrt([found[f"uu{j}"] for j in range(width)])
        main = runs[0]
        alpha = _strength(runs, grid, energy, signs_energy, n)
        if main.diagonal:
            slope = beta[0] * abs(main.solution(alpha)[-1])
            if main.done or slope <= tolerance * main.length:
                break
        elif beta[0] <= 1e-12 * np.sqrt(max(blocks.energy * energy, 1e-300)):  # nothing to explain
            break
        following, past = [], []
        for j, run in enumerate(runs):
            size = max(run.diagonal, default=0.0)
            if run.done or beta[j] <= 1e-13 * size or beta[j] == 0.0:  # the start vector's space is used up
                run.done = True
                following.append("0D")
                past.append("0D")
                continue
            if run.diagonal:
                run.beside.append(float(beta[j]))
                back = f" - {float(beta[j])!r}D * prev[{j}]"
            else:
                run.length, back = float(beta[j]), ""
            shift = found[f"mu{j}"] / beta[j]
            run.diagonal.append(float(found[f"iu{j}"] / beta[j] ** 2 - n * shift**2))
            unit = f"(vec[{j}] / {float(beta[j])!r}D)"
            following.append(
                f"img[{j}] / {float(beta[j])!r}D - mean * {float(n * shift)!r}D - {run.diagonal[-1]!r}D * {unit}{back}"
            )
            past.append(unit)
        basis.append(table.select("col", F.expr(past[0]).alias("v")))
        state = table.select(
            "col", "mean", F.expr(f"array({', '.join(following)})").alias("vec"), F.expr(f"array({', '.join(past)})").alias("prev")
        )
    else:
        raise RuntimeError(f"the slope is not down to {tolerance} of its start after {max_passes} passes")
    if main.diagonal:
        parts = [part.select("col", (F.col("v") * float(c)).alias("v")) for part, c in zip(basis, main.solution(alpha))]
        weights = reduce(DataFrame.unionByName, parts).groupBy("col").agg(F.sum("v").alias("weight"))
    else:
        weights = table.select("col", F.lit(0.0).alias("weight"))
    weights = written(weights, "weights")
    at_means = table.join(weights, "col").agg(F.sum(F.col("mean") * F.col("weight"))).first()[0]
    return WideFit(weights, float(mean - at_means), float(alpha), passes)


def _strength(runs: Sequence[Recurrence], grid: np.ndarray, energy: float, signs_energy: np.ndarray, n: int) -> float:
    """The strength of least generalised cross-validation error, as far as the passes tell; ties to the greater."""
    linear, square = runs[0].gains(grid)
    # |y - A w|^2 = y'y - 2 b'w + w'C w, with b'w the first gain and w'C w the second
    error = np.maximum(energy - 2.0 * linear + square, 0.0)
    free = np.mean([total - run.gains(grid)[0] for run, total in zip(runs[1:], signs_energy)], axis=0)
    loss = n * error / np.maximum(free, 1e-9 * n) ** 2
    return float(grid[len(grid) - 1 - int(np.argmin(loss[::-1]))])
