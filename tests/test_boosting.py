"""Boosted trees against a plain recursive version, and what folds and layouts change."""

import numpy as np
import pyarrow as pa
import pytest

from evenreel.operators import boosting, personal
from evenreel.operators.boosting import TreeSettings, boosted


@pytest.fixture(scope="module")
def films(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (60, 4)) / 4.0
    x[7, 2] = np.nan
    y = np.round((x[:, 0] > 1) * 2.0 + np.nan_to_num(x[:, 2]) * x[:, 1] / 2 + rng.normal(0, 0.2, 60), 2)
    rows = [(i, float(y[i]), [float(v) for v in x[i]], i % 3) for i in range(60)]
    return x, y, spark.createDataFrame(rows, "row long, rating double, vec array<double>, fold int")


def plain_tree(x, residual, depth, s):
    """(column, threshold, left, right) or a leaf's value."""
    slope, n = -residual.sum(), len(residual)
    best = None
    for c in range(x.shape[1]):
        for cut in sorted(set(x[:, c]))[:-1]:
            left = x[:, c] <= cut
            if min(left.sum(), n - left.sum()) < s.min_child:
                continue
            a, b = -residual[left].sum(), -residual[~left].sum()
            gain = a * a / (left.sum() + s.l2) + b * b / (n - left.sum() + s.l2) - slope * slope / (n + s.l2)
            if best is None or gain > best[0] + 1e-6:
                best = gain, c, cut, left
    if depth == 0 or best is None or best[0] <= 1e-9:
        return -s.step * slope / (n + s.l2)
    _, c, cut, left = best
    return c, cut, plain_tree(x[left], residual[left], depth - 1, s), plain_tree(x[~left], residual[~left], depth - 1, s)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_forest(x, y, s):
    low = np.where(np.isnan(x), -np.inf, x)
    total = np.full(len(y), y.mean())
    for _ in range(s.trees):
        tree = plain_tree(low, y - total, s.depth, s)
        total = total + np.array([plain_value(tree, row) for row in low])
    return total


def test_forest_equals_a_plain_one(films, monkeypatch):
    x, y, table = films
    monkeypatch.setattr(boosting, "TREES_PER_TABLE", 2)
    s = TreeSettings(trees=5, depth=3, step=0.3, subsample=1.0, columns=1.0, min_child=4, l2=2.0)
    forest = boosted(table.drop("fold"), None, s)[0]
    assert np.allclose(forest.predict(x), plain_forest(x, y, s), atol=1e-4)
    stiff = boosted(table.drop("fold"), None, TreeSettings(trees=5, depth=3, step=0.3, l2=200.0))[0]
    assert np.abs(stiff.predict(x) - y.mean()).max() < np.abs(forest.predict(x) - y.mean()).max()


def test_folds_grown_together_are_the_forests_of_each_part(films):
    x, _, table = films
    s = TreeSettings(trees=4, depth=2, step=0.3, min_child=3)
    for fold, forest in enumerate(boosted(table.repartition(5), 3, s)):
        alone = boosted(table.where(f"fold <> {fold}").drop("fold"), None, s)[0]
        assert np.allclose(forest.predict(x), alone.predict(x), atol=1e-5)
        assert any((tree.column >= 0).any() for tree in forest.trees)


def test_trees_do_not_depend_on_the_layout(films):
    x, _, table = films
    s = TreeSettings(trees=6, depth=3, step=0.2)
    one, other = (boosted(t, 3, s) for t in (table.coalesce(1), table.repartition(7)))
    for a, b in zip(one, other):
        assert all((s.column == t.column).all() and (s.cut == t.cut).all() for s, t in zip(a.trees, b.trees))
        assert (a.predict(x) == b.predict(x)).all()


def test_little_or_nothing_to_learn_from(films, spark):
    _, y, table = films
    model = personal.GradientBoosted(trees=2)
    schema = "row long, rating double, vec array<double>"
    asked = spark.createDataFrame([(1, None, [0.5] * 4), (2, None, None)], schema)
    some = model.fit(table.unionByName(asked, allowMissingColumns=True)).predict(asked).collect()
    assert some[0]["predicted"] is not None and some[1]["predicted"] is None
    empty = model.fit(spark.createDataFrame([], schema)).predict(asked).collect()
    assert [r["predicted"] for r in empty] == [None, None]
    same = model.fit(spark.createDataFrame([(i, 3.0, [float(i)] * 4) for i in range(9)], schema)).predict(asked)
    assert [r["predicted"] for r in same.collect()] == [3.0, None]
    assert model.fit(table).predict(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        TreeSettings(bins=300)


def test_subsamples_and_columns_are_drawn_per_tree():
    keys = np.arange(20_000)
    first, second = boosting.drawn(keys, 0, 0) < 0.8, boosting.drawn(keys, 1, 0) < 0.8
    assert abs(first.mean() - 0.8) < 0.01 and abs((first & second).mean() - 0.64) < 0.01
    s = TreeSettings(columns=0.6)
    sets = {tuple(boosting.columns_of_tree(10, tree, s)) for tree in range(20)}
    assert len(sets) > 5 and {len(c) for c in sets} == {6}


def test_rows_are_read_from_a_slice_of_a_batch_and_stand_where_a_walk_ends():
    rng = np.random.default_rng(2)
    raw, sums = rng.integers(0, 256, (50, 2 * 5), dtype=np.uint8), rng.normal(size=(50, 2))
    batch = pa.RecordBatch.from_pydict({"bins": [b.tobytes() for b in raw], "sums": [s.tobytes() for s in sums]})
    rows = np.array([0, 3, 4, 17])
    bins, found = boosting._reader(2, 5)(batch.slice(20, 25), rows)  # before: pandas rows, an object each
    assert (bins == raw[20 + rows].T.reshape(2, 5, 4)).all() and (found == sums[20 + rows]).all()
    for depth in (1, 3, 8):
        tree = boosting.Tree.of_depth(depth)
        inner = 2**depth - 1
        tree.column[:inner] = np.where(rng.random(inner) < 0.8, rng.integers(0, 5, inner), boosting.LEAF)
        tree.cut[:inner] = rng.integers(0, 256, inner)
        ends = []
        for row in raw[:, :5]:
            at = 0
            while tree.column[at] != boosting.LEAF:
                at = 2 * at + 1 + (row[tree.column[at]] > tree.cut[at])
            ends.append(at)
        assert list(tree.nodes(raw[:, :5])) == ends
