"""Queries of events: the batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.sources.tables import table
from paperloom.streaming import events as E

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


@query("event_windows", """SELECT time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100 AS total
FROM events GROUP BY ALL""")
def event_windows(spark, d):
    w = E.windows(table(spark, d, "events"), "1 hour")
    return w.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("total", F.floor(F.col("total") * 100 + 0.5) / 100)


@query("event_sessions", """WITH g AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    s = E.sessions(table(spark, d, "events"), "2 hours")
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("event_dedup", """SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, props FROM events) GROUP BY ALL""")
def event_dedup(spark, d):
    e = E.distinct_events(table(spark, d, "events"), ("user_id", "event_type", "props"))
    return e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("event_props", """SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""")
def event_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
