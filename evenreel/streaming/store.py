"""The resumable store and interaction reports, fed by file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evenreel.operators.interactions import OPTIONAL_KINDS
from evenreel.sources.files import path_exists
from evenreel.sources.store import append_new


def file_stream(spark: SparkSession, folder: str, schema: T.StructType | str, *, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of a folder; ``maxFilesPerTrigger`` bounds one batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def ingest_store(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append unseen films of a stream to the store, then stop.

    The stream checkpoint remembers which files were read; the anti join against
    the store makes a repeated batch harmless.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.schema(batch.schema).parquet(store) if path_exists(spark, store) else None
        append_new(batch, store, stored)

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def coverage_counts(batch: DataFrame) -> DataFrame:
    """Rows and values per (kind, film) of one batch."""
    return batch.groupBy("kind", "film_key").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("with_value")
    )


def coverage_from_state(state: DataFrame) -> DataFrame:
    """The coverage report of all counted batches.

    Films are summed over batches first, so distinct films stay exact.
    """
    return (
        state.groupBy("kind", "film_key")
        .agg(F.sum("rows").alias("rows"), F.sum("with_value").alias("with_value"))
        .groupBy("kind")
        .agg(
            F.sum("rows").alias("rows"),
            F.count(F.lit(1)).alias("films"),
            F.sum("with_value").alias("with_value"),
        )
        .withColumn("optional", F.col("kind").isin(*OPTIONAL_KINDS))
    )


def stream_coverage(stream: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of every batch of an interaction stream under ``state``.

    A batch writes only its own folder, named by its id: repeating it overwrites
    the folder, so nothing is counted twice and no batch rewrites older ones.
    """

    def count(batch: DataFrame, batch_id: int) -> None:
        coverage_counts(batch).write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(count)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
