"""Quantiles of many groups beside numpy."""

import numpy as np
from pyspark.sql import functions as F

from evenreel.operators.quantiles import grouped_quantiles

POINTS = [0.0, 0.1, 0.5, 0.9, 1.0]


def test_grouped_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.integers(-50, 50, 3000)]
    rows += [(f"g{i % 7}", float(v)) for i, v in enumerate(rng.normal(0, 10**6, 500))]
    rows += [("one", 3.5), ("two", -1.0), ("two", 1.0), ("none", None), (None, 1.0), ("tied", 2.0), ("tied", 2.0), ("tied", 5.0)]
    frame = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["quantiles"] for r in grouped_quantiles(frame, ["g"], "v", POINTS).collect()}
    names = {g for g, v in rows if g is not None and v is not None}
    assert got.keys() == names
    for name in names:
        want = np.quantile([v for g, v in rows if g == name], POINTS)
        assert np.allclose(got[name], want)


def test_grouped_quantiles_of_nothing(spark):
    frame = spark.createDataFrame([], "g string, v double")
    assert grouped_quantiles(frame, ["g"], "v", POINTS).count() == 0


def test_no_task_gathers_a_group(spark):
    frame = spark.range(100).select(F.lit("a").alias("g"), (F.col("id") % 10).alias("v"))
    plan = grouped_quantiles(frame, ["g"], "v", [0.5])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "collect_list" not in plan
