"""Queries of the review process over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.operators import audit, review
from paperloom.operators.export import BACK, FRONT, category_sheets, score_sheet, titled
from paperloom.sources.tables import ASSIGNMENTS_SQL, MESSAGES_SQL, REPORTS_SQL, assigned_lines, assignments, messages, reports, table

TODAY = "2000-01-01"


def _today():
    return F.lit(TODAY).cast("date")


QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


_SCORES_SQL = """scores AS (
  SELECT report_id, floor(avg(t) * 10 + 0.5) / 10 AS final, floor((max(t) - min(t)) * 10 + 0.5) / 10 AS spread, count(t) AS n_scores
  FROM (SELECT report_id, CASE WHEN state = 'completed' THEN total END AS t FROM assignments) GROUP BY report_id
)"""


@query("final_score", f"WITH {ASSIGNMENTS_SQL}, {_SCORES_SQL} SELECT * FROM scores")
def final_score(spark, d):
    return review.final_scores(assignments(spark, d))


@query("pass_mark", f"""WITH {ASSIGNMENTS_SQL}, {_SCORES_SQL}, n AS (SELECT report_id, count(*) AS n_assigned FROM assignments GROUP BY report_id)
SELECT report_id, final, n_scores, n_assigned, verdict, CASE WHEN verdict = 'failed' THEN floor((60.0 - final) * 10 + 0.5) / 10 END AS shortfall FROM (
  SELECT s.report_id, final, n_scores, n_assigned,
         CASE WHEN n_scores = 0 OR n_scores <> n_assigned THEN 'pending' WHEN final >= 60 THEN 'passed' ELSE 'failed' END AS verdict
  FROM scores s JOIN n USING (report_id))""")  # fmt: skip
def pass_mark(spark, d):
    a = assignments(spark, d)
    n = a.groupBy("report_id").agg(F.count(F.lit(1)).alias("n_assigned"))
    return review.pass_marks(review.final_scores(a).join(n, "report_id"), 60.0).drop("spread")


@query("referee_state_by_report", f"""WITH {ASSIGNMENTS_SQL}
SELECT report_id, count(*) AS n_assigned, count(*) FILTER (state = 'completed') AS n_completed, count(*) FILTER (state = 'draft') AS n_draft,
       bool_and(coalesce(state = 'completed', false)) AS all_done FROM assignments GROUP BY report_id""")  # fmt: skip
def referee_state_by_report(spark, d):
    return review.referee_state(assignments(spark, d))


@query("flow_summary", f"""WITH {REPORTS_SQL}, {ASSIGNMENTS_SQL}, p AS (
  SELECT report_id, count(*) AS n, count(*) FILTER (state = 'completed') AS done,
         count(*) FILTER (state IS DISTINCT FROM 'completed' AND deadline < DATE '{TODAY}') AS late FROM assignments GROUP BY report_id
), r AS (
  SELECT competition_id, state, coalesce(n, 0) AS n, coalesce(done, 0) AS done, coalesce(late, 0) AS late FROM reports LEFT JOIN p USING (report_id)
)
SELECT competition_id, count(*) AS reports, count(*) FILTER (state = 'completed') AS completed,
       count(*) FILTER (state <> 'completed' AND n > 0) AS assigned, count(*) FILTER (state <> 'completed' AND n = 0) AS unassigned,
       count(*) FILTER (n > 0 AND done = n) AS all_evaluated, CAST(sum(n) AS BIGINT) AS expected, CAST(sum(done) AS BIGINT) AS evaluated,
       count(*) FILTER (late > 0) AS late_reports, CAST(sum(late) AS BIGINT) AS late_evaluations,
       CAST(CASE WHEN sum(n) > 0 THEN floor(sum(done) * 100 / sum(n) + 0.5) ELSE 0 END AS BIGINT) AS percent
FROM r GROUP BY competition_id""")  # fmt: skip
def flow_summary(spark, d):
    return review.flow_summary(reports(spark, d), assignments(spark, d), _today(), ("competition_id",))


@query("referee_load", f"""WITH {ASSIGNMENTS_SQL}
SELECT s_suppkey AS referee_id, s_name AS name, count(report_id) AS assigned, count(*) FILTER (state = 'completed') AS completed,
       count(*) FILTER (state = 'draft') AS draft FROM supplier LEFT JOIN assignments ON referee_id = s_suppkey GROUP BY ALL""")
def referee_load(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("referee_id"), F.col("s_name").alias("name"))
    return review.referee_load(s, assignments(spark, d))


@query("dashboard", f"""WITH {REPORTS_SQL}, {ASSIGNMENTS_SQL}, {_SCORES_SQL}, r AS (
  SELECT *, abs(final - model_score) AS gap FROM reports LEFT JOIN scores USING (report_id))
SELECT count(*) FILTER (state = 'completed') AS n_completed, count(*) FILTER (state = 'waiting') AS n_waiting, count(*) FILTER (state = 'uploaded') AS n_uploaded,
       count(gap) AS n_compared, floor(avg(gap) * 10 + 0.5) / 10 AS mean_deviation, floor(sum(cost) * 1000 + 0.5) / 1000 AS cost,
       floor(sum(cost) / count(model_score) * 1000 + 0.5) / 1000 AS cost_per_report, count(*) FILTER (cost = 0) AS n_cached,
       CAST(floor(count(*) FILTER (gap <= 5) * 100 / count(gap) + 0.5) AS BIGINT) AS agreement FROM r""")  # fmt: skip
def dashboard(spark, d):
    return review.dashboard(reports(spark, d), review.final_scores(assignments(spark, d)))


@query("counts_two_levels", f"WITH {REPORTS_SQL} SELECT competition_id, category, count(*) AS n FROM reports GROUP BY GROUPING SETS ((competition_id), (category))")
def counts_two_levels(spark, d):
    return review.counts_two_levels(reports(spark, d))


@query("missing_upload", f"""WITH {REPORTS_SQL}
SELECT c_custkey AS team_id, c_name AS name, count(report_id) AS n_reports, max(uploaded) AS last_upload, count(report_id) = 0 AS missing
FROM customer LEFT JOIN reports ON team_id = c_custkey GROUP BY ALL""")
def missing_upload(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("team_id"), F.col("c_name").alias("name"))
    return review.missing_uploads(c, reports(spark, d))


@query("my_applications", """SELECT DISTINCT o_orderkey AS application_id, o_orderdate AS created FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE o_custkey = 7 OR (c_nationkey = 3 AND c_mktsegment = 'BUILDING')""")
def my_applications(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    mine = (F.col("o_custkey") == 7) | ((F.col("c_nationkey") == 3) & (F.col("c_mktsegment") == "BUILDING"))
    found = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").where(mine)
    return found.select(F.col("o_orderkey").alias("application_id"), F.col("o_orderdate").alias("created")).distinct()


@query("latest_per_group", f"""WITH {REPORTS_SQL} SELECT team_id, report_id, uploaded FROM (
  SELECT *, rank() OVER (PARTITION BY team_id ORDER BY uploaded DESC) AS k FROM reports) WHERE k = 1""")
def latest_per_group(spark, d):
    return review.latest(reports(spark, d).select("team_id", "report_id", "uploaded"), ("team_id",), "uploaded")


_WAIT_SQL = """o AS (
  SELECT report_id, max(CASE WHEN role <> 'referee' THEN seq END) AS other FROM messages WHERE NOT automatic GROUP BY report_id
), w AS (
  SELECT report_id, min(seq) AS since, count(*) AS run FROM messages JOIN o USING (report_id)
  WHERE NOT automatic AND role = 'referee' AND seq > coalesce(other, -1) GROUP BY report_id
)"""


@query("awaiting_reply", f"""WITH {MESSAGES_SQL}, {_WAIT_SQL}
SELECT o.report_id, since IS NOT NULL AS awaiting, since, coalesce(run, 0) AS run FROM o LEFT JOIN w USING (report_id)""")
def awaiting_reply(spark, d):
    return review.awaiting_reply(messages(spark, d))


@query("inbox", f"""WITH {MESSAGES_SQL}, {_WAIT_SQL}, l AS (
  SELECT report_id, arg_max(role, seq) AS last_role, trim(regexp_replace(arg_max(text, seq), '\\s+', ' ', 'g')) AS t, count(*) AS n_messages, max(seq) AS last_seq
  FROM messages GROUP BY report_id)
SELECT l.report_id, last_role, CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 60)) || '…' ELSE t END AS excerpt, n_messages, last_seq,
       w.report_id IS NOT NULL AS awaiting FROM l LEFT JOIN w USING (report_id)""")  # fmt: skip
def inbox(spark, d):
    return review.inbox(messages(spark, d))


@query("referee_alias", f"""WITH {ASSIGNMENTS_SQL}, k AS (
  SELECT report_id, referee_id, row_number() OVER (PARTITION BY report_id ORDER BY assigned, referee_id) - 1 AS k FROM assignments
), s AS (
  SELECT l_suppkey AS report_id, l_orderkey AS referee_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_shipdate), l_orderkey) - 1 AS k
  FROM lineitem GROUP BY l_suppkey, l_orderkey
)
SELECT report_id, referee_id, substr('ABCDEFGHJKLMNOPRSTUVYZ', CAST(k % 22 + 1 AS BIGINT), 1) || CASE WHEN k >= 22 THEN CAST(k // 22 + 1 AS VARCHAR) ELSE '' END AS alias
FROM (SELECT * FROM k UNION ALL SELECT report_id + 1000000000, referee_id, k FROM s)""")
def referee_alias(spark, d):
    """Referees of orders, and (under numbers of their own) orders of suppliers, which are many enough for a second round of letters."""
    many = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") + 1_000_000_000).alias("report_id"), F.col("l_orderkey").alias("referee_id"))
    many = many.agg(F.min("l_shipdate").alias("assigned"))
    return review.referee_alias(assignments(spark, d).select("report_id", "referee_id", "assigned").unionByName(many))


@query("board_open", f"""WITH {ASSIGNMENTS_SQL}
SELECT report_id, bool_and(coalesce(state = 'completed', false)) AND count(*) >= 2 AS board_open FROM assignments GROUP BY report_id""")
def board_open(spark, d):
    return review.board_open(assignments(spark, d))


_CRITERIA_SQL = """lines AS (
  SELECT l_orderkey AS report_id, l_suppkey AS referee_id, 'C' || l_linenumber AS criterion, l_quantity AS score, l_returnflag AS note FROM lineitem)"""


def _criteria(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.col("l_suppkey").alias("referee_id"), F.concat(F.lit("C"), "l_linenumber").alias("criterion"),
        F.col("l_quantity").alias("score"), F.col("l_returnflag").alias("note"),
    )


@query("criterion_average", f"""WITH {_CRITERIA_SQL}
SELECT report_id, criterion, floor(avg(score) * 10 + 0.5) / 10 AS mean, count(score) AS n_scorers, array_to_string(list(note ORDER BY referee_id, note), ',') AS notes
FROM lines GROUP BY report_id, criterion""")
def criterion_average(spark, d):
    return review.criterion_average(_criteria(spark, d)).withColumn("notes", F.concat_ws(",", "notes"))


@query("clamp_scores", f"""WITH {_CRITERIA_SQL}
SELECT report_id, referee_id, criterion, greatest(0, least(points, score)) AS score, note
FROM lines JOIN (VALUES ('C1', 10.0), ('C2', 20.0), ('C3', 30.0), ('C4', 40.0)) r(c, points) ON c = criterion""")
def clamp_scores(spark, d):
    rubric = spark.createDataFrame([("C1", 10.0), ("C2", 20.0), ("C3", 30.0), ("C4", 40.0)], "criterion string, points double")
    return review.clamp_scores(_criteria(spark, d), rubric).select("report_id", "referee_id", "criterion", "score", "note")


_RUBRIC_SQL = "rubric AS (SELECT p_brand AS rubric_id, p_partkey AS ord, CAST(p_size AS DOUBLE) AS points FROM part)"


def _rubric(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("rubric_id"), F.col("p_partkey").alias("ord"), F.col("p_size").cast("double").alias("points"))


@query("rubric_rescale", f"""WITH {_RUBRIC_SQL}, s AS (
  SELECT *, floor(points * 100.0 / sum(points) OVER (PARTITION BY rubric_id) * 10 + 0.5) / 10 AS scaled FROM rubric
), f AS (
  SELECT *, 100.0 - sum(scaled) OVER (PARTITION BY rubric_id) AS rest, row_number() OVER (PARTITION BY rubric_id ORDER BY scaled DESC, ord) AS k FROM s)
SELECT rubric_id, ord, points, floor((CASE WHEN k = 1 THEN scaled + rest ELSE scaled END) * 10 + 0.5) / 10 AS scaled FROM f""")
def rubric_rescale(spark, d):
    return review.rescale(_rubric(spark, d), 100.0)


@query("rubric_draft", f"""WITH {_RUBRIC_SQL}, c AS (
  SELECT *, 100 // count(*) OVER (PARTITION BY rubric_id) AS base, count(*) OVER (PARTITION BY rubric_id) AS n,
         row_number() OVER (PARTITION BY rubric_id ORDER BY ord) AS k FROM rubric)
SELECT rubric_id, ord, points, CAST(CASE WHEN k = 1 THEN base + 100 - base * n ELSE base END AS BIGINT) AS draft_points FROM c""")
def rubric_draft(spark, d):
    return review.draft_rubric(_rubric(spark, d))


@query("feedback_merge", """WITH m AS (
  SELECT o_custkey AS report_id, o_orderkey AS seq, '  ' || o_orderpriority || ' ' || o_orderstatus AS text FROM orders)
SELECT report_id, seq, text FROM (
  SELECT *, row_number() OVER (PARTITION BY report_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) ORDER BY seq) AS k FROM m) WHERE k = 1""")
def feedback_merge(spark, d):
    text = F.concat(F.lit("  "), "o_orderpriority", F.lit(" "), "o_orderstatus")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("seq"), text.alias("text"))
    return review.first_wins(rows, ("report_id",), "text", "seq")


@query("score_sheet", f"""WITH {ASSIGNMENTS_SQL}, {_SCORES_SQL}, {_CRITERIA_SQL}, c AS (
  SELECT report_id, criterion, floor(avg(score) * 10 + 0.5) / 10 AS mean FROM lines GROUP BY report_id, criterion
), p AS (
  SELECT report_id, max(mean) FILTER (criterion = 'C1') AS c1, max(mean) FILTER (criterion = 'C2') AS c2, max(mean) FILTER (criterion = 'C3') AS c3 FROM c GROUP BY report_id
), r AS (
  SELECT report_id, string_agg('R' || referee_id || ': ' || CAST(CAST(total AS BIGINT) AS VARCHAR), ' | ' ORDER BY referee_id) AS names
  FROM assignments WHERE state = 'completed' GROUP BY report_id)
SELECT report_id, concat_ws(';', report_id, coalesce(CAST(final AS VARCHAR), ''), coalesce(CAST(c1 AS VARCHAR), ''), coalesce(CAST(c2 AS VARCHAR), ''),
       coalesce(CAST(c3 AS VARCHAR), ''), coalesce(names, '')) AS line FROM scores LEFT JOIN p USING (report_id) LEFT JOIN r USING (report_id)""")  # fmt: skip
def score_sheet_query(spark, d):
    a = assignments(spark, d)
    means = review.criterion_average(_criteria(spark, d))
    return score_sheet(review.final_scores(a), means, a, ["C1", "C2", "C3"])


_HEAD_SQL = [";".join(x) for x in (FRONT, BACK)]


@query("category_sheets", f"""WITH {REPORTS_SQL}, {ASSIGNMENTS_SQL}, {_SCORES_SQL}, {_CRITERIA_SQL}, m AS (
  SELECT report_id, criterion, floor(avg(score) * 10 + 0.5) / 10 AS mean FROM lines GROUP BY report_id, criterion
), rubric AS (
  SELECT DISTINCT category, criterion, CAST(substr(criterion, 2) AS INT) AS ord, 10.0e0 * CAST(substr(criterion, 2) AS INT) AS points
  FROM lines JOIN reports USING (report_id) WHERE CAST(substr(criterion, 2) AS INT) <= CAST(substr(category, 1, 1) AS INT) + 1
), heads AS (
  SELECT category, sum(points) AS most, string_agg('Kriter ' || ord || ' (' || regexp_replace(CAST(points AS VARCHAR), '[.]0$', '') || ')', ';' ORDER BY ord) AS titles FROM rubric GROUP BY category
), own AS (
  SELECT report_id, string_agg(coalesce(regexp_replace(CAST(mean AS VARCHAR), '[.]0$', ''), ''), ';' ORDER BY ord) AS cells
  FROM reports JOIN rubric USING (category) LEFT JOIN m USING (report_id, criterion) GROUP BY report_id
), who AS (
  SELECT report_id, string_agg('R' || referee_id || ': ' || regexp_replace(CAST(total AS VARCHAR), '[.]0$', ''), ' | ' ORDER BY 'R' || referee_id) FILTER (state = 'completed') AS names,
         string_agg('R' || referee_id || ': ' || CAST(deadline AS VARCHAR), ' | ' ORDER BY 'R' || referee_id) FILTER (state IS NOT NULL) AS notes,
         count(*) FILTER (state = 'completed') || '/' || count(*) AS scorers FROM assignments GROUP BY report_id
), size AS (SELECT category, count(*) AS n FROM reports GROUP BY category)
SELECT category AS sheet, CASE WHEN (SELECT count(*) FROM size) > 1 THEN category || ' — ' || n || ' rapor' || chr(10) ELSE '' END || '{_HEAD_SQL[0]};' || titles || ';{_HEAD_SQL[1]}' AS head,
       report_id AS ord, concat_ws(';', 'TF-' || report_id, 'T' || team_id, team_id, 'Project ' || report_id, state, '', '', cells,
         coalesce(regexp_replace(CAST(final AS VARCHAR), '[.]0$', ''), ''), regexp_replace(CAST(most AS VARCHAR), '[.]0$', ''), regexp_replace(CAST(model_score AS VARCHAR), '[.]0$', ''),
         coalesce(regexp_replace(CAST(floor((final - model_score) * 10 + 0.5) / 10 AS VARCHAR), '[.]0$', ''), ''), coalesce(names, ''), coalesce(scorers, ''),
         coalesce(regexp_replace(CAST(spread AS VARCHAR), '[.]0$', ''), ''), coalesce(notes, ''), '', '', '', CAST(CAST(uploaded AS DATE) AS VARCHAR)) AS line
FROM reports JOIN heads USING (category) JOIN own USING (report_id) JOIN size USING (category) LEFT JOIN who USING (report_id) LEFT JOIN scores USING (report_id)""")  # fmt: skip
def category_sheets_query(spark, d):
    r, a = reports(spark, d).repartition("report_id"), assignments(spark, d)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("ord"))
    rubric = lines.join(r.select("report_id", "category"), "report_id").where(F.col("ord") <= F.substring("category", 1, 1).cast("int") + 1).select("category", "ord").distinct()
    rubric = rubric.select("category", F.concat(F.lit("C"), "ord").alias("criterion"), "ord", F.concat(F.lit("Kriter "), "ord").alias("name"), (F.col("ord") * 10.0).alias("points"))
    nothing = F.lit(None).cast("string")
    full = r.select(
        "report_id", "category", F.concat(F.lit("TF-"), "report_id").alias("number"), F.concat(F.lit("T"), "team_id").alias("team"), F.col("team_id").alias("team_code"),
        F.concat(F.lit("Project "), "report_id").alias("project"), "state", nothing.alias("pages"), nothing.alias("words"), F.col("model_score").alias("model_total"),
        nothing.alias("findings"), nothing.alias("sources"), nothing.alias("similarity"), F.to_date("uploaded").alias("done_on"),
    )
    given = a.select("report_id", F.concat(F.lit("R"), "referee_id").alias("referee"), "state", "total", F.col("deadline").cast("string").alias("note"))
    return titled(category_sheets(full, rubric, review.criterion_average(_criteria(spark, d)), given))


@query("orphan_audit", """
SELECT 'order_without_customer' AS rule, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'line_without_order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'line_without_supplier', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey)
UNION ALL SELECT 'customer_without_order', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)
UNION ALL SELECT 'label_without_document', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""")
def orphan_audit(spark, d):
    t = {n: table(spark, d, n) for n in ("orders", "customer", "lineitem", "supplier", "labels", "documents")}
    return audit.orphans([
        ("order_without_customer", t["orders"], "o_custkey", t["customer"], "c_custkey"),
        ("line_without_order", t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"),
        ("line_without_supplier", t["lineitem"], "l_suppkey", t["supplier"], "s_suppkey"),
        ("customer_without_order", t["customer"], "c_custkey", t["orders"], "o_custkey"),
        ("label_without_document", t["labels"], "doc_id", t["documents"], "doc_id"),
    ])


@query("having_audit", f"""WITH {REPORTS_SQL}, {ASSIGNMENTS_SQL}
SELECT 'all_done_not_completed' AS rule, CAST(report_id AS VARCHAR) AS subject, count(*) AS n FROM assignments a JOIN reports USING (report_id)
WHERE reports.state <> 'completed' GROUP BY report_id HAVING bool_and(coalesce(a.state = 'completed', false))
UNION ALL SELECT 'duplicate_assignment', l_orderkey || '/' || l_suppkey, count(*) FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1""")
def having_audit(spark, d):
    return audit.having(assigned_lines(spark, d), reports(spark, d).where("state <> 'completed'").select("report_id"))


@query("state_tabs", f"""WITH {REPORTS_SQL}
SELECT count(*) FILTER (state IN ('waiting', 'uploaded')) AS waiting, count(*) FILTER (state = 'completed') AS completed,
       count(*) FILTER (model_score < 10) AS manual, count(*) AS total FROM reports""")
def state_tabs(spark, d):
    return reports(spark, d).agg(
        F.count_if(F.col("state").isin("waiting", "uploaded")).alias("waiting"), F.count_if(F.col("state") == "completed").alias("completed"),
        F.count_if(F.col("model_score") < 10).alias("manual"), F.count(F.lit(1)).alias("total"),
    )


@query("progress_top", f"""WITH {REPORTS_SQL}, p AS (
  SELECT competition_id, count(*) AS n, count(*) FILTER (state = 'completed') AS done FROM reports GROUP BY competition_id)
SELECT competition_id, n, done, n - done AS remaining FROM p ORDER BY n = done, n - done DESC, competition_id LIMIT 5""")
def progress_top(spark, d):
    p = reports(spark, d).groupBy("competition_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "completed").alias("done"))
    p = p.withColumn("remaining", F.col("n") - F.col("done"))
    return p.orderBy(F.col("n") == F.col("done"), F.col("remaining").desc(), "competition_id").limit(5)


@query("referee_work_list", f"""WITH {ASSIGNMENTS_SQL}, {REPORTS_SQL}
SELECT a.report_id, referee_id, competition_id, category, coalesce(a.state, 'new') AS work,
       row_number() OVER (PARTITION BY referee_id ORDER BY coalesce(a.state = 'completed', false), deadline NULLS LAST, assigned, a.report_id) AS place
FROM assignments a JOIN reports r ON r.report_id = a.report_id""")
def referee_work_list(spark, d):
    from pyspark.sql import Window

    a = assignments(spark, d).join(reports(spark, d).select("report_id", "competition_id", "category"), "report_id")
    done = F.coalesce(F.col("state") == "completed", F.lit(False))
    w = Window.partitionBy("referee_id").orderBy(done, F.col("deadline").asc_nulls_last(), "assigned", "report_id")
    return a.select("report_id", "referee_id", "competition_id", "category", F.coalesce("state", F.lit("new")).alias("work"), F.row_number().over(w).alias("place"))


@query("balanced_assignment", f"""WITH RECURSIVE {REPORTS_SQL}, p AS (
  SELECT DISTINCT l_orderkey AS report_id, l_suppkey AS referee_id FROM lineitem
), r AS (
  SELECT n_nationkey AS competition_id, s_suppkey AS referee_id, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) AS ord,
         (SELECT count(*) FROM p JOIN reports o USING (report_id) WHERE o.competition_id = n_nationkey AND p.referee_id = s_suppkey) AS load
  FROM supplier JOIN nation ON s_suppkey % 5 = n_regionkey
), l AS (
  SELECT competition_id, list(load ORDER BY ord) AS loads, list(referee_id ORDER BY ord) AS ids FROM r GROUP BY competition_id
), t AS (
  SELECT o.competition_id, o.report_id, row_number() OVER (PARTITION BY o.competition_id ORDER BY o.report_id) AS ord,
         coalesce(list_filter(ids, lambda x: list_contains(coalesce(h.have, []), x)), []) AS have
  FROM reports o JOIN l USING (competition_id) LEFT JOIN (SELECT report_id, list(referee_id) AS have FROM p GROUP BY report_id) h USING (report_id)
  WHERE o.report_id % 5 = 0
), g AS (
  SELECT competition_id, CAST(0 AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS report_id, loads, ids, CAST([] AS BIGINT[]) AS picks FROM l
  UNION ALL
  SELECT competition_id, ord, report_id, [loads[i] + CASE WHEN list_contains(picks, i) THEN 1 ELSE 0 END FOR i IN range(1, len(ids) + 1)], ids, picks
  FROM (SELECT g.competition_id, t.ord, t.report_id, g.loads, g.ids,
               [x.i FOR x IN list_sort([{{'l': g.loads[i], 'i': i}} FOR i IN range(1, len(g.ids) + 1) IF NOT list_contains(t.have, g.ids[i])])[1:2]] AS picks
        FROM g JOIN t ON t.competition_id = g.competition_id AND t.ord = g.ord + 1)
)
SELECT report_id, ids[unnest(CASE WHEN len(picks) = 0 THEN [CAST(NULL AS BIGINT)] ELSE picks END)] AS referee_id FROM g WHERE report_id IS NOT NULL""")
def balanced_assignment(spark, d):
    """Two more referees of the region for every fifth report; loads are the assignments that they have in the competition."""
    pairs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_suppkey").alias("referee_id")).distinct()
    r = reports(spark, d).select("report_id", "competition_id")
    load = pairs.join(r, "report_id").groupBy("competition_id", "referee_id").agg(F.count(F.lit(1)).alias("load"))
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    referees = s.join(n, F.col("s_suppkey") % 5 == F.col("n_regionkey")).select(F.col("n_nationkey").alias("competition_id"), F.col("s_suppkey").alias("referee_id"), F.col("s_suppkey").alias("ord"))
    referees = referees.join(load, ["competition_id", "referee_id"], "left").fillna(0, ["load"])
    targets = r.where(F.col("report_id") % 5 == 0).withColumn("ord", F.col("report_id"))
    return review.assign(targets, referees, pairs, 2)


@query("stage_calendar", f"""WITH c AS (
  SELECT o_custkey AS stage, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'result' ELSE 'deadline' END AS kind, CAST(o_orderdate AS DATE) AS day FROM orders
), s AS (
  SELECT stage, arg_min(day, seq) FILTER (kind = 'deadline') AS deadline, arg_min(day, seq) FILTER (kind = 'result') AS result FROM c GROUP BY stage)
SELECT stage, deadline, result, CASE WHEN deadline >= DATE '{TODAY}' THEN 'future' WHEN result IS NULL OR result >= DATE '{TODAY}' THEN 'evaluation' ELSE 'done' END AS state,
       CAST(deadline - DATE '{TODAY}' AS INTEGER) AS days FROM s""")  # fmt: skip
def stage_calendar(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "result").otherwise("deadline")
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("stage"), F.col("o_orderkey").alias("seq"), kind.alias("kind"), F.to_date("o_orderdate").alias("day"))
    return review.stage_state(c, _today())
