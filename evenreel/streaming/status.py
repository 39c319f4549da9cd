"""Film status kept up to date by a stream of interactions.

What a batch says about a film is a small state that merges with any other:
flags are or-ed, the first rating is a least struct, the latest diary value a
greatest one, and spellings are counted. A batch writes its own folder, so
repeating it changes nothing. When enough folders have gathered they are merged
into one, ``upto=<batch>``; the folders it covers are dropped only after it is
complete, and a reader takes the last complete merge and what came after it. So
the state grows with the films, not with the batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evenreel.operators.interactions import DIARY, FILM, LIKE, RATING, SEEN_KINDS, WATCHLIST
from evenreel.sources.files import drop_folder, folder_names, path_exists

#: Folders of single batches from which on they are merged.
COMPACT_EVERY = 8
FLAGS, SPELLINGS = "flags", "spellings"


def batch_flags(batch: DataFrame, keys: Sequence[str] = FILM) -> DataFrame:
    """Flags, first rating and latest diary value per film of one batch."""
    kind = F.col("kind")
    diary = (kind == DIARY) & F.col("value").isNotNull()
    either = lambda condition: F.coalesce(F.bool_or(condition), F.lit(False))
    latest = F.struct(F.col("watched_date").isNull().alias("undated"), "watched_date", "event_date", "value")
    return batch.groupBy(*keys).agg(
        either(kind.isin(*SEEN_KINDS)).alias("seen"),
        either(kind == LIKE).alias("liked"),
        either(kind == WATCHLIST).alias("on_watchlist"),
        F.min(F.when(kind == RATING, F.struct("event_date", "value"))).alias("first_rating"),
        F.max(F.when(diary, latest)).alias("latest_diary"),
    )


def merge_flags(states: DataFrame, keys: Sequence[str] = FILM) -> DataFrame:
    flags = [F.bool_or(c).alias(c) for c in ("seen", "liked", "on_watchlist")]
    return states.groupBy(*keys).agg(*flags, F.min("first_rating").alias("first_rating"), F.max("latest_diary").alias("latest_diary"))


def batch_spellings(batch: DataFrame, keys: Sequence[str] = FILM) -> DataFrame:
    """How often each title and each year stands beside a film in one batch."""
    parts = []
    for field, other in (("title", "year"), ("year", "title")):
        empty = F.lit(None).cast(batch.schema[other].dataType).alias(other)
        seen = batch.groupBy(*keys, field).agg(F.count(F.lit(1)).alias("n"))
        parts.append(seen.select(*keys, F.lit(field).alias("field"), field, empty, "n").select(*keys, "field", "title", "year", "n"))
    return parts[0].unionByName(parts[1])


def merge_spellings(states: DataFrame, keys: Sequence[str] = FILM) -> DataFrame:
    return states.groupBy(*keys, "field", "title", "year").agg(F.sum("n").alias("n"))


def _numbers(spark: SparkSession, state: str, kind: str) -> list[int]:
    """Numbers of the complete folders of a kind; the spellings are written last."""
    names = [n for n in folder_names(spark, state) if n.startswith(f"{kind}=")]
    done = [n for n in names if path_exists(spark, f"{state}/{n}/{SPELLINGS}/_SUCCESS")]
    return sorted(int(n.split("=")[1]) for n in done)


def _live(spark: SparkSession, state: str) -> tuple[int, list[str]]:
    """Last merged batch (-1: none) and the folders that make up the state."""
    merged = max(_numbers(spark, state, "upto"), default=-1)
    later = [f"batch={b}" for b in _numbers(spark, state, "batch") if b > merged]
    return merged, [f"upto={merged}"] * (merged >= 0) + later


def _read(spark: SparkSession, state: str, folders: list[str], part: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{state}/{f}/{part}") for f in folders])


def _write(flags: DataFrame, spellings: DataFrame, folder: str) -> None:
    flags.write.mode("overwrite").parquet(f"{folder}/{FLAGS}")
    spellings.write.mode("overwrite").parquet(f"{folder}/{SPELLINGS}")


def fold_batch(batch: DataFrame, number: int, state: str, keys: Sequence[str] = FILM, *, compact_every: int = COMPACT_EVERY) -> None:
    """Take one batch into the state; a batch that is taken in already changes nothing."""
    spark = batch.sparkSession
    merged, _ = _live(spark, state)
    if number <= merged:
        return
    _write(batch_flags(batch, keys), batch_spellings(batch, keys), f"{state}/batch={number}")
    _, folders = _live(spark, state)
    if len(folders) <= compact_every:
        return
    flags = merge_flags(_read(spark, state, folders, FLAGS), keys)
    _write(flags, merge_spellings(_read(spark, state, folders, SPELLINGS), keys), f"{state}/upto={number}")
    for old in folders:
        drop_folder(spark, f"{state}/{old}")


def status_from_state(spark: SparkSession, state: str, keys: Sequence[str] = FILM) -> DataFrame:
    """The film status of all batches taken in so far, as ``interactions.film_status`` gives it."""
    keys = list(keys)
    _, folders = _live(spark, state)
    if not folders:
        raise ValueError(f"no batch has been taken in under {state}")
    flags = merge_flags(_read(spark, state, folders, FLAGS), keys)
    counts = merge_spellings(_read(spark, state, folders, SPELLINGS), keys)

    def most_common(field: str) -> DataFrame:
        named = counts.where((F.col("field") == field) & F.col(field).isNotNull())
        return named.groupBy(*keys).agg(F.min_by(field, F.struct(-F.col("n"), F.col(field))).alias(field))

    return (
        flags.join(most_common("title"), keys, "left")
        .join(most_common("year"), keys, "left")
        .select(
            *keys, "title", "year", "seen",
            F.coalesce("first_rating.value", "latest_diary.value").alias("rating"),
            "liked", "on_watchlist",
            (F.col("on_watchlist") & ~F.col("seen")).alias("watchlist_pending"),
        )
    )


def stream_status(
    stream: DataFrame, state: str, checkpoint: str, keys: Sequence[str] = FILM, *, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Keep the status of an interaction stream under ``state``, then stop."""
    return (
        stream.writeStream.foreachBatch(lambda batch, number: fold_batch(batch, number, state, keys, compact_every=compact_every))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
