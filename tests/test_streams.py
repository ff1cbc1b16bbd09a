"""Streams that are run again, stopped between writes and replayed."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from paperloom.streaming import refresh

REPORTS = "doc_id long, category string, words int"
FOUND = "doc_id long, category string, rank long, most int"


def find(reports):
    """Reports over half as long as the longest of their category, and by how many they are outdone."""
    most = reports.groupBy(F.col("category").alias("_c")).agg(F.max("words").alias("most"))
    all_ = reports.join(most, F.col("category").eqNullSafe(F.col("_c"))).where("2 * words > most")
    longer = reports.select(F.col("category").alias("_k"), F.col("words").alias("_w"))
    ranked = all_.join(longer, F.col("category").eqNullSafe(F.col("_k")) & (F.col("_w") > F.col("words")), "left")
    return ranked.groupBy("doc_id", "category", "most").agg(F.count("_w").alias("rank")).select("doc_id", "category", "rank", "most")


@pytest.fixture
def place(spark, tmp_path):
    class Place:
        store, results, inbox, checkpoint = (str(tmp_path / n) for n in ("store", "results", "inbox", "checkpoint"))

        def put(self, *rows):
            spark.createDataFrame(rows, REPORTS).coalesce(1).write.mode("append").parquet(self.inbox)

        def run(self, every=50):
            uploads = spark.readStream.schema(REPORTS).parquet(self.inbox)
            refresh.refresh_categories(uploads, self.store, self.results, find, FOUND, self.checkpoint, compact_every=every).awaitTermination()

        def batch(self, k, *rows):
            refresh.refresh_batch(spark.createDataFrame(rows, REPORTS), k, self.store, self.results, find, FOUND)

        def now(self):
            return sorted((tuple(r) for r in refresh.current(spark, self.results, FOUND, ("doc_id",)).collect()), key=str)

        def whole(self, *rows):
            return sorted((tuple(r) for r in find(spark.createDataFrame(rows, REPORTS)).collect()), key=str)

    return Place()


A, B, C, D = (1, "x", 100), (2, "x", 60), (3, "y", 10), (4, "x", 250)


def test_refresh_over_two_runs_withdraws_what_holds_no_more(place):
    place.put(A, B, C)
    place.run()
    assert place.now() == place.whole(A, B, C) and len(place.now()) == 3
    place.put(D, (5, None, 7), (5, None, 7))
    place.run()
    # Reports 1 and 2 are no longer over half of the longest.
    assert place.now() == place.whole(A, B, C, D, (5, None, 7)) and [r[0] for r in place.now()] == [3, 4, 5]
    place.run()
    assert [r[0] for r in place.now()] == [3, 4, 5]


def test_a_report_counts_once_as_it_came_first(place):
    place.batch(0, A, B)
    place.batch(1, (1, "x", 900), (1, "y", 900), C)
    assert place.now() == place.whole(A, B, C)


def test_replayed_and_stopped_batches_end_in_the_same_rows(place, spark):
    place.batch(0, A, B)
    place.batch(1, D)
    once = place.now()
    place.batch(1, D)
    assert place.now() == once
    # Stopped after the store was written: no results of the batch, or files without a mark.
    shutil.rmtree(f"{place.results}/batch=1")
    assert place.now() == place.whole(A, B)
    place.batch(1, D)
    assert place.now() == once
    os.remove(f"{place.results}/batch=1/_SUCCESS")
    assert place.now() == place.whole(A, B)
    # Stopped inside the store: what is there without a mark is replaced.
    os.remove(f"{place.store}/batch=1/_SUCCESS")
    place.batch(1, D)
    assert place.now() == once


def test_only_what_changes_is_written(place, spark):
    place.batch(0, A, C)
    place.batch(1, (6, "x", 90))
    rows = spark.read.parquet(f"{place.results}/batch=1").collect()
    assert [(r["doc_id"], r["_gone"]) for r in rows] == [(6, False)]
    place.batch(2, D)
    assert {(r["doc_id"], r["_gone"]) for r in spark.read.parquet(f"{place.results}/batch=2").collect()} == {(1, True), (6, True), (4, False)}


def test_compaction_keeps_what_holds_and_removes_the_rest(place, spark):
    for k, r in enumerate((A, B, C, D)):
        place.batch(k, r)
    before = place.now()
    refresh.compact(spark, place.results, FOUND, ("doc_id",))
    assert place.now() == before and sorted(os.listdir(place.results)) == ["base=3"]
    refresh.compact(spark, place.results, FOUND, ("doc_id",))
    place.batch(4, (9, "y", 30))
    assert place.now() == place.whole(A, B, C, D, (9, "y", 30))
    place.batch(4, (9, "y", 30))
    assert place.now() == place.whole(A, B, C, D, (9, "y", 30))


def test_streamed_compaction(place, spark):
    for r in (A, B, C, D):
        place.put(r)
        place.run(every=2)
    assert place.now() == place.whole(A, B, C, D) and sorted(os.listdir(place.results)) == ["base=3"]


MESSAGES = "report_id long, seq long, role string, automatic boolean"


class Talk:
    def __init__(self, spark, tmp_path, **times):
        self.spark, self.inbox, self.checkpoint, self.out, self.times = spark, str(tmp_path / "m"), str(tmp_path / "c"), [], times

    def say(self, *rows):
        # While timers are kept, batches without data never end; here each run ends with its data.
        self.spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        self.spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("append").parquet(self.inbox)
        state = refresh.awaiting_stream(self.spark.readStream.schema(MESSAGES).parquet(self.inbox), **self.times)
        out = []
        run = state.writeStream.outputMode("update").foreachBatch(lambda b, _: out.extend(map(tuple, b.collect())))
        run = run.option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        try:
            assert run.awaitTermination(60)
        finally:
            run.stop()
            self.spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
        return sorted(out)


def test_awaiting_stream_keeps_state_over_runs(spark, tmp_path):
    talk = Talk(spark, tmp_path)
    assert talk.say((1, 2, "referee", False), (1, 1, "coordination", False), (2, 1, "coordination", False)) == [(1, True, 2, 1, False), (2, False, None, 0, False)]
    assert talk.say((1, 3, "referee", False), (1, 4, "coordination", True), (2, 2, "referee", False)) == [(1, True, 2, 2, False), (2, True, 2, 1, False)]
    assert talk.say((1, 5, "coordination", False)) == [(1, False, None, 0, False)]


def test_awaiting_stream_tells_once_what_is_overdue_and_forgets(spark, tmp_path):
    talk = Talk(spark, tmp_path, overdue_ms=1)
    talk.say((1, 1, "referee", False), (2, 1, "referee", False))
    time.sleep(0.1)
    assert (1, True, 1, 1, True) in talk.say((2, 2, "coordination", False))
    assert not [r for r in talk.say((3, 1, "coordination", False)) if r[0] == 1]
    talk = Talk(spark, tmp_path / "short", keep_ms=1)
    talk.say((1, 1, "referee", False))
    time.sleep(0.1)
    # The state is gone, so the run begins anew.
    assert talk.say((1, 2, "referee", False)) == [(1, True, 2, 1, False)]


def test_changed_tells_nulls_apart(spark):
    new = spark.createDataFrame([(1, "a"), (2, None), (3, None), (None, "c")], "k long, v string")
    old = spark.createDataFrame([(1, "b"), (2, None), (3, "x"), (None, "c")], "k long, v string")
    assert sorted(r["k"] for r in refresh.changed(new, old, ("k",), ("v",)).collect()) == [1, 3]
