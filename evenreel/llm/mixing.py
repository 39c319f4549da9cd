"""Time-varying curriculum mixing (operator 9), with DataFrame functions only.

Every source has a weight; together the sources are to give ``share`` times all
words. A target above ``most`` times its source is cut there and the excess is
dealt again by weight. That fixed point is ``least(most * size, weight * level)``
with one common level, found from running sums over the sources.

Documents of a source stand in hash order and form a stream that is read again
from the start for as long as the target asks. A document copy that begins at
word c of its stream is trained at the time t at which the source's demand, the
integral of its weight schedule, reaches c / target. Schedules are linear,
``start + (end - start) * t``, so their integral is inverted in closed form.
Running words come from totals per (source, hash range): no task sums up a whole
source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evenreel.llm.common import whole_row
from evenreel.session import written

#: Weights in the order of the sources, repeated.
WEIGHTS = (5.0, 2.0, 1.0)
#: (start, end) of the schedules in the order of the sources, repeated.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Hash ranges of a source; hexadecimal digits of the row's hash.
DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank, tab, line and page breaks.

    Words are blanks plus one once white space is single blanks; the regular
    expression is left to texts in which several stand together.
    """
    blank = F.coalesce(text, F.lit(""))
    for other in "\t\n\x0b\f\r":
        blank = F.replace(blank, F.lit(other), F.lit(" "))
    squeezed = F.when(F.contains(blank, F.lit("  ")), F.regexp_replace(blank, " +", " ")).otherwise(blank)
    trimmed = F.trim(squeezed)
    blanks = F.octet_length(trimmed) - F.octet_length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(trimmed == "", 0).otherwise(blanks + 1).cast("long")


def _cycled(values: Sequence[float], place: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (place % len(values) + 1).cast("int"))


def source_targets(
    sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Targets of the sources: ``source, source_size`` in, one row per source.

    Sources are ordered by code point, null last. This table has one row per
    source, so its windows run over few rows even for a huge corpus.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_place", F.row_number().over(ordered) - 1)
    ranked = ranked.withColumn("weight", _cycled(weights, F.col("_place")))
    size, weight = F.col("source_size").cast("double"), F.col("weight")
    # sources reach their cap in the order of size / weight
    by_ratio = W.orderBy((size / weight).asc(), F.col("_place").asc())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    capped_sum = F.coalesce(F.sum(size * most).over(before), F.lit(0.0))
    free_weight = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    level = (F.sum(size).over(whole) * share - capped_sum) / free_weight
    # the first source in that order that the level doesn't lift above its cap ends the search
    leveled = ranked.withColumn("_level", level).withColumn(
        "_free", F.col("_level") * weight <= size * most
    )
    chosen = F.min(F.when(F.col("_free"), F.struct((size / weight).alias("r"), "_place", "_level"))).over(whole)
    target = F.when(chosen.isNull(), size * most).otherwise(F.least(size * most, chosen["_level"] * weight))
    return leveled.select("source", "source_size", "weight", "_place", target.alias("target"))


def training_time(fraction: Column, start: Column, end: Column) -> Column:
    """Invert the demand: the t in [0, 1] at which ``fraction`` of the words is used.

    Demand is start * t + (end - start) * t^2 / 2, over its value at t = 1.
    """
    slope = end - start
    wanted = fraction * (start + end) / 2
    root = (F.sqrt(F.greatest(F.lit(0.0), start * start + slope * wanted * 2)) - start) / slope
    return F.when(slope == 0, fraction).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), root)))


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
    share: float = 1.5,
    most: float = 2.0,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, positions.

    ``taken`` counts the words the mix takes with repeats; the copy in which a
    source's target is reached is taken in part. ``positions`` holds the time of
    each copy. Null sources form one source, null texts and texts without words
    have size 0 and are taken 0 times; a null or repeated id is a row like any
    other (equal rows are interchangeable); an empty table gives an empty one.
    Only the three named columns are read, unless ``carry`` asks for the whole
    row as a struct ``_doc`` (see ``common.whole_row``).
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        *([whole_row(docs).alias("_doc")] if carry else []),
    )
    payload = ["_doc"] if carry else []
    tie = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # one key column for null and other sources: the join below keeps the windows' partitions
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = rows.withColumns({"_tie": tie, "_range": F.substring(tie, 1, DIGITS), "_key": key})
    if not carry:  # read twice below, and the texts not at all
        rows = written(rows, "mixing-rows")
    cells = rows.groupBy("_key", "_range").agg(F.sum("size").alias("_words"), F.first("source").alias("source"))
    totals = cells.groupBy("source").agg(F.sum("_words").cast("long").alias("source_size"))
    targets = source_targets(totals, weights=weights, share=share, most=most)
    ahead = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.withColumn("_ahead", F.coalesce(F.sum("_words").over(ahead), F.lit(0)))
    same = F.col("o.source").eqNullSafe(F.col("t.source"))
    offsets = offsets.alias("o").join(targets.alias("t"), same).select(
        "_key", "_range", "_ahead", "source_size", "target",
        _cycled([s for s, _ in schedules], F.col("_place")).alias("_start"),
        _cycled([e for _, e in schedules], F.col("_place")).alias("_end"),
    )
    inside = W.partitionBy("_key", "_range").orderBy("_tie", "doc_id", "size")
    begun = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("_begun", begun).join(offsets, ["_key", "_range"])
    begins = F.col("_begun") + F.col("_ahead")
    wanted = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("size") == 0, F.array().cast("array<long>")).otherwise(
        F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(int(most))), lambda e: begins + e * F.col("source_size")),
            lambda c: c < wanted,
        )
    )
    words = F.aggregate(
        "_starts", F.lit(0).cast("long"), lambda sum_, c: sum_ + F.least(F.col("size"), F.col("_wanted") - c)
    )
    return (
        placed.select(
            "doc_id", "source", "size", "source_size", "target",
            "_start", "_end", wanted.alias("_wanted"), epochs.alias("_starts"), *payload,
        )
        .withColumn("taken", words)
        .select(
            "doc_id", "source", "size", "source_size", "target", "taken",
            F.size("_starts").alias("copies"),
            F.transform(
                "_starts", lambda c: training_time(c / F.col("target"), F.col("_start"), F.col("_end"))
            ).alias("positions"),
            *payload,
        )
    )


def curriculum(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per document copy, range-sorted by its training position."""
    copies = mixed.select("*", F.explode("positions").alias("position")).drop("positions")
    order = [F.col("position"), F.col("source"), F.col("doc_id")]
    spread = copies.repartitionByRange(partitions, *order) if partitions else copies.repartitionByRange(*order)
    return spread.sortWithinPartitions(*order)


def documents_in_order(mixed: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the training position of its first copy; those never taken stand last.

    Equal positions follow source and id, nulls first.
    """
    order = [F.get("positions", F.lit(0)).asc_nulls_last(), F.col("source").asc(), F.col("doc_id").asc()]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order)
