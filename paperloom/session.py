"""Session factory and the folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, ANSI arithmetic and adaptive execution; `conf` wins over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, whatever the length of the texts, so that Python workers need little memory.

    Spark takes the size from the session when a plan runs, so it is one value for all operators.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")


@contextmanager
def held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for what runs inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark runs in one process (tests), a temporary one, set once."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if folder is None:
        folder = tempfile.mkdtemp(prefix="paperloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def keyed(df: DataFrame) -> DataFrame:
    """`df` plus _row, a number that tells its rows apart; written once, so that every later read sees the same numbers."""
    return materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")


#: Intermediate tables that this process has written and not removed.
_WRITTEN: list[str] = []


def release(spark: SparkSession, keep: Iterable[str] = ()) -> None:
    """Remove the intermediate tables written so far, but those that hold a file of `keep`; for when what was built from
    them is itself written."""
    for path in [p for p in _WRITTEN if not any(p.rsplit("/", 1)[1] in file for file in keep)]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _WRITTEN.remove(path)


def discard(table: DataFrame) -> None:
    """Remove a table that `materialize` wrote, once nothing reads it any more."""
    files = table.inputFiles()
    release(table.sparkSession, keep=[p for p in _WRITTEN if not any(p.rsplit("/", 1)[1] in f for f in files)])


#: Spark's switch to remove the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once into the shared folder and read it back, so that its lineage ends there.

    A lost executor then costs a re-read, never a recomputation, and the planner knows the table's size. What was shuffled
    to write it is removed at once; else it stays on the executors' disks until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with held(spark, _CLEANUP, "true"):
        df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)
