"""Small helpers the operators share."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evenreel.session import dropping_shuffles, scratch_path

#: Rows of whole texts that a Python worker holds at once.
TEXT_ROWS = 512


def row_ids() -> Iterator[int]:
    """Ids for the rows a task writes: unique over the table.

    They are only stable once the table is written, so write it before any
    second use.
    """
    return itertools.count(TaskContext.get().partitionId() << 33)


def arrow_types(schema: str) -> pa.Schema:
    """Arrow types of a DDL schema; to be called on the driver."""
    return to_arrow_schema(StructType.fromDDL(schema))


def map_rows(frame: DataFrame, start: Callable[[], Callable[[list[dict]], list[dict]]], schema: str) -> DataFrame:
    """Run Python over batches of rows inside the tasks.

    ``start()`` is called once per task and returns the function from a list of
    rows to a list of rows. A batch is cut into ``TEXT_ROWS`` rows, so that the
    Python objects of only so many texts are alive at a time.
    """
    types = arrow_types(schema)

    def run(batches):
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                out = work(batch.slice(at, TEXT_ROWS).to_pylist())
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=types)

    return frame.mapInArrow(run, schema)


def filter_rows(frame: DataFrame, columns: list[str], start: Callable[[], Callable[[list[dict]], list[bool]]]) -> DataFrame:
    """Keep the rows for which Python, shown ``columns``, says True; all columns stay.

    Rows are judged where they lie: nothing is shuffled. Columns of any name stay.
    """
    names = frame.columns
    plain = frame.toDF(*[f"c{i}" for i in range(len(names))])  # Spark reads a dot in a name as a field
    places = [names.index(c) for c in columns]

    def run(batches):
        work = start()
        for batch in batches:
            shown = batch.select(places).rename_columns(columns)
            for at in range(0, batch.num_rows, TEXT_ROWS):
                mask = work(shown.slice(at, TEXT_ROWS).to_pylist())
                yield batch.slice(at, TEXT_ROWS).filter(pa.array(mask, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


def whole_row(frame: DataFrame) -> Column:
    """All columns as one struct ``c0, c1, ...``, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{i}") for i, c in enumerate(frame.columns)])


def unpacked(frame: DataFrame, row: str, names: list[str]) -> DataFrame:
    """The columns of a struct made by ``whole_row``."""
    return frame.select(*[F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(names)])


def bucketed_bodies(docs: DataFrame, doc_id: str, text: str, compression: str | None = None) -> DataFrame:
    """``uid, doc_id, body``: the texts as bytes, written in buckets of a row id, so joins on it move no text.

    The bucketing is known to the plan alone: the catalog keeps no entry.
    ``compression`` is the session's by default.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("body")
    ).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "body")
    path = scratch_path(spark, "bodies")
    name = "evenreel_" + path.rsplit("-", 1)[-1]
    with dropping_shuffles(spark):
        writer = rows.repartition(n, "uid").write.bucketBy(n, "uid").sortBy("uid").option("path", path)
        (writer.option("compression", compression) if compression else writer).saveAsTable(name)
    bodies = spark.table(name)
    bodies.schema  # resolved before the entry goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return bodies
