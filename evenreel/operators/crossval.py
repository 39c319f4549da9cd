"""Repeated k-fold evaluation of personal models, sliced by popularity band."""

from __future__ import annotations

import copy
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenreel.functions.numeric import TAIL_BANDS, band_ordinal, popularity_band
from evenreel.operators.ordering import score_ranges
from evenreel.operators.personal import folds
from evenreel.operators.ranking import comparable
from evenreel.operators.reports import spearman
from evenreel.session import written


def cross_validate(
    models: Sequence, rated: DataFrame, *, k: int = 5, seed: int = 0, repeats: int = 1
) -> DataFrame:
    """(model, repeat, fold, row, actual, predicted): every row once per repeat.

    Every model is fitted from scratch on each training part, so nothing learned
    from a held-out film reaches its prediction. A model with ``fit_folds`` fits
    all parts at once.
    """
    parts = []
    for repeat in range(repeats):
        placed = written(folds(rated, k, seed=seed + repeat), "folds")
        together = {i: model.fit_folds(placed, k) for i, model in enumerate(models) if hasattr(model, "fit_folds")}
        for fold in range(k):
            train = placed.where(F.col("fold") != fold).drop("fold")
            test = placed.where(F.col("fold") == fold).drop("fold")
            for i, model in enumerate(models):
                fitted = together[i][fold] if i in together else copy.copy(model).fit(train)
                predicted = fitted.predict(test).select(
                    F.lit(model.name).alias("model"),
                    F.lit(repeat).alias("repeat"),
                    F.lit(fold).alias("fold"),
                    "row",
                    F.col("rating").alias("actual"),
                    F.col("predicted").cast("double").alias("predicted"),
                )
                # a plan per fold: one of all folds' predictions grows with them all
                parts.append(written(predicted, "out-of-fold"))
    return reduce(DataFrame.unionByName, parts)


def cv_global_mean(rated: DataFrame, *, k: int = 5, seed: int = 0) -> DataFrame:
    """The floor model in one plan: a fold's mean is everything less that fold."""
    placed = folds(rated.select("row", "rating"), k, seed=seed)
    per_fold = placed.groupBy("fold").agg(F.sum("rating").alias("_s"), F.count("rating").alias("_n"))
    total = per_fold.agg(F.struct(F.sum("_s").alias("s"), F.sum("_n").alias("n"))).scalar()
    means = per_fold.select(
        "fold", ((total["s"] - F.col("_s")) / (total["n"] - F.col("_n"))).alias("predicted")
    )
    return placed.join(F.broadcast(means), "fold").select(  # k rows
        F.lit("global_mean").alias("model"),
        F.lit(0).alias("repeat"),
        "fold",
        "row",
        F.col("rating").alias("actual"),
        "predicted",
    )


def with_bands(predictions: DataFrame, votes: DataFrame) -> DataFrame:
    """Add the absolute popularity band; ``votes``: (row, log_votes)."""
    count = F.expm1("log_votes")
    return predictions.join(votes.select("row", "log_votes"), "row").select(
        *predictions.columns, popularity_band(count).alias("band"), band_ordinal(count).alias("band_no")
    )


def _metrics(predictions: DataFrame, by: Sequence[str]) -> DataFrame:
    by = list(by)
    rows = predictions.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    rows = rows.withColumn("predicted", comparable(F.col("predicted")))
    error = F.col("actual") - F.col("predicted")
    errors = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    )
    order = spearman(
        rows,
        by,
        "actual",
        "predicted",
        left_spread=score_ranges(F.col("actual"), 0.0, 10.0, 64),
        right_spread=score_ranges(F.col("predicted"), 0.0, 10.0, 512),
    )
    return errors.join(order, by, "left")


def cv_summary(predictions: DataFrame) -> DataFrame:
    """Mean of each metric over the repeats, with the spread of the error."""
    return (
        _metrics(predictions, ["model", "repeat"])
        .groupBy("model")
        .agg(
            F.max("n").alias("n"),
            F.avg("rmse").alias("rmse"),
            F.coalesce(F.stddev_samp("rmse"), F.lit(0.0)).alias("rmse_sd"),
            F.avg("mae").alias("mae"),
            F.avg("spearman").alias("spearman"),
        )
        .orderBy("rmse", "model")
    )


def cv_by_band(banded: DataFrame) -> DataFrame:
    return _metrics(banded, ["model", "band_no", "band"]).orderBy("model", "band_no")


def tail_summary(by_band: DataFrame, tail_bands: Sequence[str] = TAIL_BANDS) -> DataFrame:
    """Mean band error of head and tail per model, and the gap between them."""
    tail = F.col("band").isin(*tail_bands)
    usable = by_band.where(F.col("rmse").isNotNull())
    return (
        usable.groupBy("model")
        .agg(
            F.round(F.avg(F.when(~tail, F.col("rmse"))), 3).alias("rmse_head"),
            F.round(F.avg(F.when(tail, F.col("rmse"))), 3).alias("rmse_tail"),
            F.round(
                F.avg(F.when(tail, F.col("rmse"))) - F.avg(F.when(~tail, F.col("rmse"))), 3
            ).alias("gap"),
        )
        .orderBy("rmse_tail", "model")
    )
