import numpy as np
import pytest
from pyspark.sql import functions as F

from evenreel.operators import linear, wide


def _table(spark, x, y):
    """Cells and targets of a dense matrix; zeros are no cells."""
    cells = [(int(i), f"c{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))]
    targets = [(i, None if np.isnan(v) else float(v)) for i, v in enumerate(y)]
    return (
        spark.createDataFrame(cells, "row long, col string, value double"),
        spark.createDataFrame(targets, "row long, rating double"),
    )


@pytest.fixture(scope="module")
def sparse():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (90, 1200)) * (rng.random((90, 1200)) < 0.03)
    x[:, :4] = rng.normal(0, 1, (90, 4))
    x[7] = 0.0
    y = 3.0 + x[:, :4] @ [0.8, -0.5, 0.3, 0.2] + rng.normal(0, 0.3, 90)
    return x, y


def _by_numpy(x, y, alpha):
    xc, yc = x - x.mean(0), y - y.mean()
    w = xc.T @ np.linalg.solve(xc @ xc.T + alpha * np.eye(len(y)), yc)
    return w, y.mean() - x.mean(0) @ w


def _weights(fit, d):
    found = {r["col"]: r["weight"] for r in fit.weights.collect()}
    return np.array([found.get(f"c{j}", 0.0) for j in range(d)])


def test_wide_ridge_equals_dense_algebra(spark, sparse):
    x, y = sparse
    cells, targets = _table(spark, x, y)
    fit = wide.wide_ridge(cells, targets)
    expected, intercept = _by_numpy(x, y, fit.alpha)
    assert np.allclose(_weights(fit, x.shape[1]), expected, atol=1e-8)
    assert fit.intercept == pytest.approx(intercept, abs=1e-8)
    scores = {r["row"]: r["score"] for r in fit.score(cells).collect()}
    assert all(scores.get(i, 0.0) == pytest.approx(x[i] @ expected, abs=1e-7) for i in range(len(y)))
    assert 7 not in scores


def test_strength_is_that_of_exact_cross_validation_or_beside_it(spark, sparse):
    x, y = sparse
    x = x[:, :40]
    grid = linear.alpha_grid()
    fit = wide.wide_ridge(*_table(spark, x, y), probes=16)
    xc, yc = x - x.mean(0), y - y.mean()
    loss = []
    for a in grid:
        hat = xc @ np.linalg.solve(xc.T @ xc + a * np.eye(40), xc.T)
        loss.append(len(y) * np.sum((yc - hat @ yc) ** 2) / (len(y) - 1 - np.trace(hat)) ** 2)
    assert abs(int(np.argmin(loss)) - int(np.argmin(np.abs(grid - fit.alpha)))) <= 2


def test_rows_without_ratings_repeated_cells_and_empty_tables(spark, sparse):
    x, y = sparse
    x, y = x[:40, :6], y[:40].copy()
    y[3] = np.nan
    cells, targets = _table(spark, x, y)
    halves = cells.withColumn("value", F.col("value") / 2)
    fit = wide.wide_ridge(halves.unionByName(halves), targets, alphas=[2.0])
    keep = ~np.isnan(y)
    expected, intercept = _by_numpy(x[keep], y[keep], 2.0)
    assert np.allclose(_weights(fit, 6), expected, atol=1e-8) and fit.intercept == pytest.approx(intercept)
    nothing = wide.wide_ridge(cells.limit(0), targets)
    assert nothing.weights.count() == 0 and nothing.intercept == pytest.approx(y[keep].mean())
    assert wide.wide_ridge(cells, targets.limit(0)).intercept is None
    level = wide.wide_ridge(cells, targets.withColumn("rating", F.lit(3.0)))
    assert np.allclose(_weights(level, 6), 0.0) and level.intercept == pytest.approx(3.0)


def test_too_few_passes_are_an_error(spark, sparse):
    with pytest.raises(RuntimeError, match="slope"):
        wide.wide_ridge(*_table(spark, *sparse), alphas=[1e-6], max_passes=3)


def test_no_cell_moves_in_a_pass(spark, sparse):
    cells, _ = _table(spark, *sparse)
    blocks = linear.RowBlocks(cells)
    image = blocks.image(blocks.columns.withColumn("vec", F.array(F.lit(1.0))), np.eye(1))
    plan = image._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("FlatMapCoGroups"):].splitlines()
    start = next(i for i, line in enumerate(left) if ":-" in line)
    end = next(i for i, line in enumerate(left) if "+-" in line and i > start and line.index("+-") == left[start].index(":-"))
    assert "ExistingRDD" in "".join(left[start:end])
    assert not any(word in line for line in left[start:end] for word in ("Exchange", "Sort"))


def test_cells_lie_once_where_few_vectors_pass(spark, monkeypatch):
    monkeypatch.setattr(linear, "GROUP_CELLS", 2_000)
    cells = spark.range(20_000).select(
        (F.col("id") % 900).alias("row"), (F.col("id") % 70).alias("col"), (F.col("id") % 5 - 1.5).alias("value")
    )
    blocks = linear.RowBlocks(cells, 9)
    cores = spark.sparkContext.defaultParallelism
    assert blocks.blocks == min(10, cores) and blocks.groups == 1
    laid = blocks.laid.groupBy("_slot").agg(F.sum(F.size("cols")).alias("n")).collect()
    assert sum(r["n"] for r in laid) == 20_000  # before: once per group of dimensions
    assert len(laid) == blocks.blocks and max(r["n"] for r in laid) < 3 * 20_000 / blocks.blocks
    dense = np.zeros((900, 70))
    for r in cells.toPandas().itertuples():
        dense[r.row, r.col] += r.value
    v = np.arange(70 * 9).reshape(70, 9) % 13 - 6.0
    vectors = spark.createDataFrame([(i, [float(x) for x in line]) for i, line in enumerate(v)], "col long, vec array<double>")
    image = {r["col"]: r["vec"] for r in blocks.image(vectors, np.eye(9)).collect()}
    assert np.allclose([image[i] for i in range(70)], dense.T @ (dense @ v))
    # as many vectors as cells: one block, as without a width
    assert linear.RowBlocks(cells.withColumn("col", F.monotonically_increasing_id()), 9).blocks == 1
