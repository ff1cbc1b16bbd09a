"""Integrity audits: each finds what must not be there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Rule = tuple[str, DataFrame, str, DataFrame, str]


def orphans(rules: list[Rule]) -> DataFrame:
    """One row per rule (name, child, its key, parent, its key): children without a parent."""

    def one(name: str, child: DataFrame, key: str, parent: DataFrame, of: str) -> DataFrame:
        lost = child.select(F.col(key).alias("_k")).join(parent.select(F.col(of).alias("_k")), "_k", "left_anti")
        return lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")

    return reduce(DataFrame.unionByName, (one(*r) for r in rules))


def finding(rule: str, subject: Column, n: Column, broken: Column) -> Column:
    """rule, subject, n where `broken` holds, else null."""
    return F.when(broken, F.struct(F.lit(rule).alias("rule"), subject.alias("subject"), n.alias("n")))


def having(pairs: DataFrame, open_: DataFrame) -> DataFrame:
    """Reports that are open although all have finished, and assignments that occur more than once: rule, subject, n.

    pairs: report_id, referee_id, state, n_lines; open_: report_id. Both rules come from one pass over the pairs in
    their order, which holds the pairs of one report at a time and no table of all.
    """
    of = Window.partitionBy("report_id")
    done = F.bool_and(F.coalesce(F.col("state") == "completed", F.lit(False))).over(of)
    first = F.row_number().over(of.orderBy("referee_id")) == 1
    p = pairs.select("report_id", "referee_id", "n_lines", F.count(F.lit(1)).over(of).alias("n"), done.alias("done"), first.alias("first"))
    p = p.withColumn("done", F.col("done") & F.col("first")).where("done OR n_lines > 1")
    copies = open_.repartition("report_id").groupBy("report_id").agg(F.count(F.lit(1)).alias("copies"))
    twice = finding("duplicate_assignment", F.concat("report_id", F.lit("/"), "referee_id"), F.col("n_lines"), F.col("n_lines") > 1)
    late = finding("all_done_not_completed", F.col("report_id").cast("string"), F.col("n") * F.col("copies"), F.col("done") & F.col("copies").isNotNull())
    return p.join(copies, "report_id", "left").select(F.inline(F.array_compact(F.array(twice, late))))


def drift(stored: DataFrame, computed: DataFrame, key: str, value: str, tolerance: float = 0.05) -> DataFrame:
    """Rows whose stored value is not the computed one, either missing included."""
    c = computed.select(key, F.col(value).alias("_computed"))
    gap = F.abs(F.col(value) - F.col("_computed")) > tolerance
    return stored.join(c, key, "full").where(gap | (F.col(value).isNull() != F.col("_computed").isNull())).withColumnRenamed("_computed", "computed")


def score_integrity(scores: DataFrame, rubric: DataFrame, totals: DataFrame) -> DataFrame:
    """Per report: scores out of range, criteria missing or unknown, and whether the total is their sum within .001."""
    known = rubric.select("criterion", "points")
    s = scores.join(known, "criterion", "left")
    per = s.groupBy("report_id").agg(
        F.count_if(F.col("points").isNull()).alias("unknown"), F.count_if((F.col("score") < 0) | (F.col("score") > F.col("points"))).alias("out_of_range"),
        F.countDistinct(F.when(F.col("points").isNotNull(), F.col("criterion"))).alias("covered"), F.sum("score").alias("sum"),
    )
    n = rubric.agg(F.count(F.lit(1)).alias("n_criteria"))
    out = per.join(F.broadcast(n)).join(totals, "report_id")  # one row
    return out.select("report_id", "unknown", "out_of_range", (F.col("n_criteria") - F.col("covered")).alias("missing"), (F.abs(F.col("sum") - F.col("total")) > 0.001).alias("wrong_total"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """`rows` with ord, their place (from 0) in the order of `key`.

    Ranges of the key are counted first; each partition then numbers only its own range, so no task sees all rows.
    """
    parts = rows.repartitionByRange(F.col(key)).withColumn("_p", F.spark_partition_id())
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_low"))
    starts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_low")) - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return parts.withColumn("_i", inside).join(starts, "_p").withColumn("ord", F.col("_start") + F.col("_i")).drop("_p", "_i", "_start")
