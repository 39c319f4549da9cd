"""Reading text files whose absence is normal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    """True when a path or glob names at least one file, on any Hadoop file system."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(where)
    return found is not None and len(found) > 0


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none for a folder that isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV with a header, every column a string; None when the file is absent.

    ``multiLine`` keeps quoted line breaks together, strips a byte-order mark
    and takes CRLF. These are the small files of one person's export, so a file
    need not be split.
    """
    if not path_exists(spark, path):
        return None
    frame = spark.read.csv(path, header=True, multiLine=True, inferSchema=False, escape='"')
    clean = [c.lstrip("﻿").strip() for c in frame.columns]
    return frame.toDF(*clean)


def text_column(frame: DataFrame, name: str):
    """A column of a text table, or null when the file does not have it."""
    return F.col(name) if name in frame.columns else F.lit(None).cast("string")


def _left_open(line: Column) -> Column:
    """1 where a quoted field that begins in the line does not end in it, else 0."""
    closed = F.regexp_replace(line, r'(?:^|(?<=,))"(?:[^"]|"")*+"(?=,|$)', "")
    return closed.rlike(r'(?:^|,)"').cast("int")


def _after(start: int, swaps: Column) -> Column:
    """State behind a run of lines: that of its last decisive one, turned by each swap since.

    ``_set``: struct(state, swaps so far) of the last line that decides the state, null
    where none does; ``swaps``: all swaps of the run.
    """
    decided = F.col("_set")
    return (F.coalesce(decided["state"], F.lit(start)) + swaps - F.coalesce(decided["swaps"], F.lit(0))) % 2


def quoted_records(lines: DataFrame, *, header: bool = False) -> DataFrame:
    """Records of quoted, comma-separated files read as text: record and _place.

    A line break inside quotes continues a record. Whether a line begins inside
    quotes depends on all lines before it, but a line can only keep, set, clear or
    swap that state. So each byte range is summed up on its own for both states at
    its start, the ranges of a file (one row each) are chained, and the lines of all
    ranges are then cut at once. Only lines of records that span several are grouped.

    A quote counts where it begins a field, or ends one before a comma or the line's
    end; others are text. Empty lines between records are dropped, and with
    ``header`` the first record of each file. A file that ends inside quotes ends
    with the record so far.
    """
    text = F.col("value")
    first_range = F.col("range") == 0
    read = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("line"),  # rises within a range
        "value",
    ).withColumn("value", F.when(first_range, F.regexp_replace(text, "^\ufeff", "")).otherwise(text))
    plain = ~F.contains(text, F.lit('"'))  # keeps the state
    states = read.withColumns(
        {
            "_from0": F.when(plain, 0).otherwise(_left_open(text)),
            "_from1": F.when(plain, 1).otherwise(_left_open(F.concat(F.lit('"'), text))),
        }
    )
    order = W.partitionBy("file", "range").orderBy("line")
    past = order.rowsBetween(W.unboundedPreceding, -1)
    swap = ((F.col("_from0") == 1) & (F.col("_from1") == 0)).cast("int")
    # swaps up to and with this line; a decisive line remembers them
    counted = states.withColumn("_swaps", F.sum(swap).over(order))
    decisive = F.when(
        F.col("_from0") == F.col("_from1"),
        F.struct(F.col("_from0").alias("state"), F.col("_swaps").alias("swaps")),
    )
    known = counted.withColumns(
        {
            "_set": F.last(decisive, ignorenulls=True).over(past),
            "_swapped": F.col("_swaps") - swap,
        }
    )
    both = known.withColumns(
        {"_at0": _after(0, F.col("_swapped")), "_at1": _after(1, F.col("_swapped"))}
    )
    step = lambda at: F.when(F.col(at) == 0, F.col("_from0")).otherwise(F.col("_from1"))
    begins = lambda at: F.max(F.when(F.col(at) == 0, F.col("line")))
    ranges = both.groupBy("file", "range").agg(
        F.max_by(step("_at0"), "line").alias("_end0"),
        F.max_by(step("_at1"), "line").alias("_end1"),
        begins("_at0").alias("_last0"),
        begins("_at1").alias("_last1"),
    )
    chain = W.partitionBy("file").orderBy("range")
    turned = ((F.col("_end0") == 1) & (F.col("_end1") == 0)).cast("int")
    set_here = F.when(
        F.col("_end0") == F.col("_end1"),
        F.struct(F.col("_end0").alias("state"), F.col("_turns").alias("swaps")),
    )
    so_far = chain.rowsBetween(W.unboundedPreceding, -1)
    chained = (
        ranges.withColumn("_turns", F.sum(turned).over(chain))
        .withColumn("_set", F.last(set_here, ignorenulls=True).over(so_far))
        .withColumn("_start", _after(0, F.col("_turns") - turned))
        .withColumn("_last", F.when(F.col("_start") == 0, F.col("_last0")).otherwise(F.col("_last1")))
        .withColumn("_own", F.when(F.col("_last").isNotNull(), F.struct("range", F.col("_last").alias("line"))))
        .select("file", "range", "_start", F.last("_own", ignorenulls=True).over(so_far).alias("_carried"))
    )
    placed = both.join(chained, ["file", "range"]).withColumn(
        "_at", F.when(F.col("_start") == 0, F.col("_at0")).otherwise(F.col("_at1"))
    )
    here = F.when(F.col("_at") == 0, F.struct("range", "line"))
    cut = placed.select(
        "file", "range", "line", "value",
        (F.col("_at") + step("_at") == 0).alias("_whole"),
        F.coalesce(F.last(here, ignorenulls=True).over(order), "_carried").alias("_begin"),
    )
    single = cut.where("_whole").select("file", "_begin", F.col("value").alias("record"))
    parts = F.array_sort(F.collect_list(F.struct("range", "line", "value")))
    joined = (
        cut.where("not _whole")
        .groupBy("file", "_begin")
        .agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("record"))
    )
    records = single.union(joined).where(F.col("record") != "")
    place = F.struct("file", "_begin.range", "_begin.line").alias("_place")
    if header:
        heads = records.groupBy("file").agg(F.min("_begin").alias("_head"))
        records = records.join(heads, "file").where(F.col("_begin") != F.col("_head"))
    return records.select("record", place)
