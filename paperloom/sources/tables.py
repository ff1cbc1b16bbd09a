"""Parquet tables of a directory, and the review entities that they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports: a customer is a team, its nation a competition, a region a season's group."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    state = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "waiting").otherwise("uploaded")
    return (
        o.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("report_id"), F.col("c_custkey").alias("team_id"), F.col("n_nationkey").alias("competition_id"),
            F.col("n_regionkey").alias("group_id"), F.col("o_orderpriority").alias("category"), state.alias("state"),
            F.col("o_orderdate").alias("uploaded"), (F.col("o_orderkey") * 37 % 101).cast("double").alias("model_score"),
            F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(0.131).alias("cost"),
        )
    )


def assigned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as assignments of a referee (supplier) to a report (order), with the evaluation if one was begun, and n_lines.

    Of several lines of one pair the least counts. Pairs seldom repeat and a report has few of them, so the lines of a
    report meet first: no task sorts its share of the file, and what is grouped by report needs no other shuffle.
    """
    line = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_returnflag", "l_shipdate")
    a = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(F.min(line).alias("x"), F.count(F.lit(1)).alias("n_lines"))
    state = F.when(F.col("x.l_linestatus") == "F", "completed").when(F.col("x.l_returnflag") == "R", "draft")
    return a.select(
        F.col("l_orderkey").alias("report_id"), F.col("l_suppkey").alias("referee_id"), state.alias("state"),
        F.when(state.isNotNull(), F.col("x.l_quantity") * 2).alias("total"), F.to_date("x.l_shipdate").alias("deadline"),
        F.col("x.l_shipdate").alias("assigned"), "n_lines",
    )


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assigned_lines(spark, sf_dir).drop("n_lines")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as messages: the user is a referee, system messages are automatic."""
    c = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "referee").otherwise("coordination")
    return c.select(F.col("conv_id").alias("report_id"), F.col("turn").alias("seq"), role.alias("role"), (F.col("role") == "system").alias("automatic"), "text")


#: The same entities in SQL, for the oracles.
REPORTS_SQL = """reports AS (
  SELECT o_orderkey AS report_id, c_custkey AS team_id, n_nationkey AS competition_id, n_regionkey AS group_id, o_orderpriority AS category,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'waiting' ELSE 'uploaded' END AS state, o_orderdate AS uploaded,
         CAST(o_orderkey * 37 % 101 AS DOUBLE) AS model_score, CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE 0.131 END AS cost
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""
ASSIGNMENTS_SQL = """assignments AS (
  SELECT report_id, referee_id, state, CASE WHEN state IS NOT NULL THEN q * 2 END AS total, CAST(assigned AS DATE) AS deadline, assigned FROM (
    SELECT l_orderkey AS report_id, l_suppkey AS referee_id, l_quantity AS q, l_shipdate AS assigned,
           CASE WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'R' THEN 'draft' END AS state,
           row_number() OVER (PARTITION BY l_orderkey, l_suppkey
             ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_linestatus, l_returnflag, l_shipdate) AS k
    FROM lineitem) WHERE k = 1
)"""
MESSAGES_SQL = """messages AS (
  SELECT conv_id AS report_id, turn AS seq, CASE role WHEN 'user' THEN 'referee' ELSE 'coordination' END AS role, role = 'system' AS automatic, text
  FROM conversations
)"""
