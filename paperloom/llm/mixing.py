"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.words import free, word_count
from paperloom.session import keyed, materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix over the size of all documents, and passes over a document at most.
BUDGET_PERCENT, PASSES = 150, 2
#: Words that are scheduled at once: a longer document is served in pieces, each with a finish time of its own.
PIECE = 512
#: Documents or pieces that a window sorts, about.
BUCKET_DOCS = 20_000


def targets(sizes: DataFrame, budget_percent: int = BUDGET_PERCENT, passes: int = PASSES) -> DataFrame:
    """`sizes` (source, source_size) plus weight, budget (words of the whole mix) and target.

    All queues are served at their weight until the budget is spent, or a queue ends after `passes` rounds. A queue ends
    at the virtual time passes * size / weight, so the time at which the budget is spent follows from the queues in the
    order in which they end: it is the first at which the queues still open fill what the ended ones leave.
    Windows here run over sources, never over documents.
    """
    by_name, by_end = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ends", "rank")
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS)))
    cap = F.col("source_size") * passes
    before = by_end.rowsBetween(Window.unboundedPreceding, -1)
    q = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("ends", cap / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * (budget_percent / 100))
        .withColumn("ended", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(by_end.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("time", (F.col("budget") - F.col("ended")) / F.col("open"))
    )
    # Where the budget covers all queues, none of these holds, and every queue runs to its end.
    spent = F.min(F.when(F.col("time") <= F.col("ends"), F.struct("ends", "rank", "time"))).over(Window.partitionBy())
    return q.select(
        "source", "source_size", "weight", F.floor("budget").alias("budget"), F.coalesce(spent["time"], F.max("ends").over(Window.partitionBy())).alias("cut")
    ).select("*", F.least(F.col("cut") * F.col("weight"), cap.cast("double")).alias("target"))


def shuffled(doc_id: Column, text: Column) -> Column:
    """Place of a document in the shuffle: MD5 of its doc_id and text, so that only equal rows tie."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary"))


def schedule(sized: DataFrame, passes: int = PASSES, budget_percent: int = BUDGET_PERCENT) -> DataFrame:
    """`sized` (source, size, place: see `shuffled`) plus its source's source_size, weight, budget, target and cut, and
    `before`: words of its source ahead of it in the shuffled queue.

    Each source is dealt to buckets, ranges of that MD5 about BUCKET_DOCS documents long, so that no source is ordered in
    one task: bucket totals give each bucket's start, windows only order within a bucket.
    """
    digits = max(1, (sized.count() // BUCKET_DOCS).bit_length() // 4 + 2)
    q = sized.withColumn("_bucket", F.substring("place", 1, digits))
    bucket = q.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = bucket.withColumn("_start", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
    t = targets(bucket.groupBy("source").agg(F.sum("_sum").alias("source_size")), budget_percent, passes)
    starts = starts.join(t.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_sum")
    starts = starts.withColumnsRenamed({"source": "_source", "_bucket": "_b"})
    inside = Window.partitionBy("source", "_bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        q.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("before", F.col("_start") + F.col("_in"))
        .drop("_bucket", "_source", "_b", "_start", "_in")
    )


def finish_times(sized: DataFrame, budget_percent: int = BUDGET_PERCENT, passes: int = PASSES) -> DataFrame:
    """A row for each document, pass and piece of PIECE words: `schedule` plus pass, piece, length and virtual_finish, the
    words of its source up to the piece's end, over all passes, divided by the source's weight."""
    q = schedule(sized, passes, budget_percent).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / PIECE) - 1).cast("int")
    q = q.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    q = q.withColumn("length", F.least(F.lit(PIECE), F.col("size") - F.col("piece") * PIECE).cast("long"))
    end = F.col("before") + F.col("pass") * F.col("source_size") + F.col("piece") * PIECE + F.col("length")
    return q.withColumn("virtual_finish", end / F.col("weight"))


def mix(sized: DataFrame, budget_percent: int = BUDGET_PERCENT, passes: int = PASSES) -> DataFrame:
    """`finish_times`, plus `words` that the mix takes of each piece, and range (_part) of the global order.

    All pieces are range-sorted by their virtual finish time and truncated where the total budget is spent: each range
    adds up its words, a prefix sum over the ranges (one row each) gives where a range starts, and a window inside a range
    gives each piece's place. The piece that straddles the budget gives its first words. Ranges are written once, so that
    their numbers never change.
    """
    order = ["virtual_finish", F.col("source").asc_nulls_last(), "place", "size", "pass", "piece"]
    q = finish_times(sized, budget_percent, passes)
    q = materialize(q.repartitionByRange(sized.count() * passes // BUCKET_DOCS + 1, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = q.groupBy("_part").agg(F.sum("length").alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.col("_start") + F.coalesce(F.sum("length").over(inside), F.lit(0))
    q = q.join(starts, F.col("_part") == F.col("_p")).drop("_p")
    return q.withColumn("words", F.least(F.col("length"), F.greatest(F.lit(0).cast("long"), F.col("budget") - spent))).drop("_start")


def _taken(sized: DataFrame, budget_percent: int, passes: int) -> DataFrame:
    """Per row of `sized`: its columns but the place, source_size, target and the words that the mix takes."""
    keys = [c for c in sized.columns if c != "place"]
    return mix(sized, budget_percent, passes).groupBy(*keys, "source_size", "target").agg(F.sum("words").alias("taken"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), shuffled(F.col("doc_id"), F.col("text")).alias("place"))


def taken(docs: DataFrame, budget_percent: int = BUDGET_PERCENT, passes: int = PASSES) -> DataFrame:
    """Per document of `docs` (doc_id, source, text): doc_id, source, size, source_size, target, taken (words, all passes).

    Null texts have size 0 and are never taken; null sources are one source, last; rows that repeat a doc_id are
    documents of their own; an empty table gives an empty result; other columns play no part. What a source takes is
    within about a PIECE of its target.
    """
    return _taken(keyed(_sized(docs)), budget_percent, passes).drop("_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: each document once for every pass that takes words of it, whole.

    Documents are named by source and place in the shuffle (an MD5 of doc_id and text), so rows of a null or repeated doc_id
    are told apart, and no copy of the texts is written. Rows that are equal in these share what is taken of them: each
    comes equally often, but for a remainder that one of them gives. Documents without words are never taken; an empty
    table gives an empty one; other columns pass through, whatever their names.
    """
    place, source, each, rest, copy = free(docs.columns, "_place", "_source", "_each", "_more", "_n")
    name = shuffled(F.col("doc_id"), F.col("text"))
    rows = docs.withColumns({place: name, source: F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    sized = keyed(_sized(docs).withColumn("name", F.col("place")))
    t = _taken(sized, BUDGET_PERCENT, PASSES).withColumn("times", F.ceil(F.col("taken") / F.nullif("size", F.lit(0))))
    t = t.groupBy(F.col("name").alias(place), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias(source))
    t = t.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("_c"), F.count(F.lit(1)).alias("_m")).where("_c > 0")
    t = materialize(t.select(place, source, F.floor(F.col("_c") / F.col("_m")).cast("int").alias(each), (F.col("_c") % F.col("_m")).cast("int").alias(rest)), "copies")
    times = lambda df, n: df.withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(n)))).select(*docs.columns)
    out = times(rows.join(t, [place, source]), each)
    more = t.where(F.col(rest) > 0)
    if more.isEmpty():
        return out
    # Picked where the rows are before anything travels.
    one = rows.join(more, [place, source]).groupBy(place, source, rest).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_r"))
    return out.unionByName(times(one.select("_r.*", rest), rest))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ' ', coalesce(text, ''))) AS o FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s
), w AS (
  SELECT *, [3, 1, 2][(k - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM r
), q AS (
  SELECT *, cap / weight AS ends, (SELECT sum(source_size) FROM s) * 1.5 AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended,
         sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS o FROM w
), c AS (
  SELECT coalesce((SELECT CAST(budget - ended AS DOUBLE) / o FROM q WHERE CAST(budget - ended AS DOUBLE) / o <= ends ORDER BY ends, k LIMIT 1),
                  (SELECT max(ends) FROM q)) AS cut
), t AS (
  SELECT source, source_size, weight, CAST(floor(budget) AS BIGINT) AS budget, least(cut * weight, CAST(cap AS DOUBLE)) AS target FROM q, c
), b AS (
  SELECT rid, doc_id, d.source, size, o, source_size, weight, budget, target,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source
), e AS (
  SELECT *, unnest([0, 1]) AS pass FROM b
), f AS (
  SELECT *, unnest(range(0, greatest(1, (size + 511) // 512))) AS piece FROM e
), g AS (
  SELECT *, least(512, size - 512 * piece) AS length,
         CAST(before + pass * source_size + 512 * piece + least(512, size - 512 * piece) AS DOUBLE) / weight AS finish FROM f
), h AS (
  SELECT *, coalesce(sum(length) OVER (ORDER BY finish, source NULLS LAST, o, size, pass, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM g
)
SELECT doc_id, size, source_size, target, CAST(sum(least(length, greatest(0, budget - spent))) AS BIGINT) AS taken
FROM h GROUP BY rid, doc_id, size, source_size, target
"""
