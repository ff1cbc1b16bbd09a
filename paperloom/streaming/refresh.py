"""Incremental work of the review process: categories that new reports touch, and conversations that wait for a reply."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

Findings = Callable[[DataFrame], DataFrame]


def changed(new: DataFrame, old: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Rows of `new` that differ from `old` in a value, or are not in it: what has to be written."""
    same = old.select(*[F.col(c).alias(f"_{c}") for c in (*keys, *values)])
    condition = F.lit(True)
    for c in (*keys, *values):
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return new.join(same, condition, "left_anti")


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _committed(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders `kind`=number under `path` that a job has finished, ascending."""
    store, where = _folder(spark, path)
    if not store.exists(where):
        return []
    names = [f.getPath().getName() for f in store.listStatus(where) if f.isDirectory()]
    numbers = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
    return sorted(n for n in numbers if store.exists(_folder(spark, f"{path}/{kind}={n}/_SUCCESS")[1]))


def current(spark: SparkSession, results: str, schema: str, keys: tuple[str, ...], before: int | None = None) -> DataFrame:
    """The findings that hold: those of the last base, as the batches since then have changed or withdrawn them.

    schema: of the findings, keys included. Folders that no job has finished do not count; `before` leaves out batches from
    that number on. Without any there are no rows.
    """
    bases = [n for n in _committed(spark, results, "base") if before is None or n < before]
    base = bases[-1] if bases else -1
    batches = [n for n in _committed(spark, results, "batch") if n > base and (before is None or n < before)]
    paths = [f"{results}/base={base}"] * bool(bases) + [f"{results}/batch={n}" for n in batches]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _batch long, _gone boolean").parquet(*paths)
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")
    return last.where("NOT _gone").drop("_batch", "_gone")


def compact(spark: SparkSession, results: str, schema: str, keys: tuple[str, ...]) -> None:
    """Write what holds as a new base; then remove the batches and bases that it replaces. May be stopped and run again."""
    batches = _committed(spark, results, "batch")
    if not batches:
        return
    rows = current(spark, results, schema, keys).withColumns({"_batch": F.lit(batches[-1]).cast("long"), "_gone": F.lit(False)})
    rows.write.mode("overwrite").parquet(f"{results}/base={batches[-1]}")
    for kind, numbers in (("batch", batches), ("base", [n for n in _committed(spark, results, "base") if n < batches[-1]])):
        for n in numbers:
            store, where = _folder(spark, f"{results}/{kind}={n}")
            store.delete(where, True)


def refresh_batch(batch: DataFrame, batch_id: int, store: str, results: str, find: Findings, schema: str, keys: tuple[str, ...] = ("doc_id",)) -> None:
    """Take in one batch of reports (doc_id, category, ...), and write what that changes of the findings of their categories.

    The batch's new reports go to `store`/batch=<id>, by category; then the findings of the touched categories are found
    again from all their reports, and those that are new, differ, or hold no more (withdrawn) go to `results`/batch=<id>.
    `find` gives rows of `schema`, which has category and `keys`; a key tells the findings of a category apart.

    A report that is there already, or comes twice in a batch, counts once, as it came first. Both folders are named by the
    batch and replaced as a whole, and what later batches wrote is never read, so a batch that was stopped anywhere, or is
    run again, ends in the same rows. Null categories are a category; a batch without rows writes nothing but its mark.
    """
    spark = batch.sparkSession
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
    earlier = [f"{store}/batch={n}" for n in _committed(spark, store, "batch") if n < batch_id]
    have = spark.read.schema(columns).parquet(*earlier) if earlier else spark.createDataFrame([], batch.schema)
    rest = [c for c in batch.columns if c != "doc_id"]
    one = batch.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("r")).select("doc_id", "r.*")
    one = one.join(have.select(F.col("doc_id").alias("_d")).distinct(), F.col("doc_id").eqNullSafe(F.col("_d")), "left_anti")
    one.select(*batch.columns).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
    new = spark.read.schema(columns).parquet(f"{store}/batch={batch_id}")
    touched = batch.select(F.col("category").alias("_c")).distinct()
    of = lambda df: df.join(touched, F.col("category").eqNullSafe(F.col("_c")), "left_semi")
    found = find(of(have.unionByName(new)))
    names = [c for c in found.columns if c not in keys]
    old = of(current(spark, results, schema, keys, batch_id))
    written = changed(found, old, keys, tuple(names)).withColumn("_gone", F.lit(False))
    gone = changed(old, found, keys, ()).withColumn("_gone", F.lit(True))
    out = written.unionByName(gone).withColumn("_batch", F.lit(batch_id).cast("long"))
    out.write.mode("overwrite").parquet(f"{results}/batch={batch_id}")


def refresh_categories(
    uploads: DataFrame, store: str, results: str, find: Findings, schema: str, checkpoint: str, keys: tuple[str, ...] = ("doc_id",), compact_every: int = 50
) -> StreamingQuery:
    """`refresh_batch` for each micro-batch of `uploads`, all there are by now; `results` is compacted every so many batches.

    Read the findings with `current`. A new report changes those of older ones, of its own category only.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        refresh_batch(batch, batch_id, store, results, find, schema, keys)
        if batch_id % compact_every == compact_every - 1:
            compact(batch.sparkSession, results, schema, keys)

    return uploads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_STATE = "other long, since long, run long"
_OUT = "report_id long, awaiting boolean, since long, run long, overdue boolean"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Awaiting(StatefulProcessor):
    """The last message of another role, and the run of the referee's messages after it; a timer while one waits."""

    def __init__(self, overdue_ms: int, keep_ms: int):
        self.overdue_ms, self.keep_ms = overdue_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE, self.keep_ms)

    def _row(self, key, since: int, run: int, overdue: bool):
        import pandas as pd

        row = {"report_id": [key[0]], "awaiting": [since >= 0], "since": [since if since >= 0 else None], "run": [run], "overdue": [overdue]}
        return pd.DataFrame(row).astype({"since": "Int64"})

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        other, since, run = self.state.get() if self.state.exists() else (-1, -1, 0)
        waited = since >= 0
        new = pd.concat(list(rows))
        new = new[~new["automatic"].astype(bool)].sort_values("seq")
        for seq, role in zip(new["seq"], new["role"], strict=True):
            if role == "referee":
                since, run = (int(seq), 1) if since < 0 else (since, run + 1)
            else:
                other, since, run = int(seq), -1, 0
        self.state.update((other, since, run))
        if since < 0 or not waited:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if since >= 0 and not waited:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.overdue_ms)
        yield self._row(key, since, run, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:  # noqa: N802, N803
        if self.state.exists():
            _, since, run = self.state.get()
            if since >= 0:
                yield self._row(key, since, run, True)

    def close(self) -> None:
        pass


def awaiting_stream(messages: DataFrame, overdue_ms: int = 3 * 86_400_000, keep_ms: int = 365 * 86_400_000) -> DataFrame:
    """The state of operators.review.awaiting_reply, kept per conversation as messages (report_id, seq, role, automatic) come in.

    A row for each conversation that a batch has messages of; and one that is `overdue`, once, when a conversation has waited
    for overdue_ms. State that nothing has changed for keep_ms is dropped, so it does not grow for ever. Messages of one
    conversation come in order of seq from batch to batch; those of a batch may come in any order. Automatic messages change
    nothing. Timers need a trigger that goes on without new data, such as one of processing time.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    slim = messages.select("report_id", "seq", "role", "automatic")
    return slim.groupBy("report_id").transformWithStateInPandas(_Awaiting(overdue_ms, keep_ms), _OUT, "Update", "ProcessingTime")
