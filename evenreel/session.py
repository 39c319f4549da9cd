"""Session and shared-storage helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting to remove the shuffle files of an execution when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's settings of how many pieces a shuffle is cut into, up to which size they are joined, and of files' splits.
PIECES = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PIECE_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
SPLIT_SIZE = "spark.sql.files.maxPartitionBytes"
ROWS_PER_PIECE = 1 << 18
PIECE_BYTES = 8 << 20
SPLIT_BYTES = 2 << 20


def local_session(cores: int | str = 8, *, memory: str = "12g") -> SparkSession:
    """A single-node session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("evenreel")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder is invisible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is not None:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="evenreel-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder."""
    checkpoint_root(frame.sparkSession)
    return frame.checkpoint(eager=True)


def laid_out(frame: DataFrame, key: str) -> DataFrame:
    """Checkpoint a table with equal keys in one partition, sorted by the key.

    Spark goes on knowing the layout, so later grouping by the key moves no row
    of it. A plan that may be changed while it runs promises no layout; this one
    may not.
    """
    spark = frame.sparkSession
    checkpoint_root(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return frame.repartition(parts, key).sortWithinPartitions(key).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, for tables a job writes and reads back.

    All tables of an application share one parent, so that its owner can drop them at once.
    """
    run = f"evenreel-{spark.sparkContext.applicationId}"
    return f"{checkpoint_root(spark).rstrip('/')}/{run}/{label}-{uuid.uuid4().hex}"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffles of a finished write are of no further use.

    Inside, Spark drops them when a write ends, not when the driver happens to
    collect its garbage.
    """
    before = spark.conf.get(DROP_SHUFFLES)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


@contextmanager
def sized_shuffles(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles planned inside are cut into as many pieces as ``rows`` asks for.

    A fixed number of pieces gives each task more rows, and more memory, as a
    table grows; here the pieces grow instead. Spark puts small ones together
    again, up to `PIECE_BYTES`; before that there are never fewer than the
    session's own number. Files are read in small splits for the same reason: a
    task that sorts what it reads holds a few hundred thousand rows of them.
    """
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = {
        PIECES: str(max(own, -(-rows // ROWS_PER_PIECE))),
        PIECE_SIZE: str(PIECE_BYTES),
        SPLIT_SIZE: str(SPLIT_BYTES),
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def written(frame: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write a table once into the shared folder and read it back.

    For tables several later jobs read: unlike a cache it survives the loss of
    an executor without being computed again. ``compression`` is the session's
    by default.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    with dropping_shuffles(spark):
        frame.write.parquet(path, compression=compression)
    table = spark.read.schema(frame.schema).parquet(path)
    table._written_at = path
    return table


def dropped(table: DataFrame) -> None:
    """Remove the files of a table just as `written` returned it, which nothing reads again; another table stays."""
    path = getattr(table, "_written_at", None)
    if path is not None:
        context = table.sparkSession.sparkContext
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
