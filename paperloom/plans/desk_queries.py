"""Queries of the coordination desk over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.functions.numbers import round_up_half
from paperloom.operators import checks, desk, review
from paperloom.plans.document_queries import _LANGS, _language_sql
from paperloom.plans.review_queries import _SCORES_SQL
from paperloom.sources.tables import ASSIGNMENTS_SQL, MESSAGES_SQL, REPORTS_SQL, assignments, messages, reports, table

TODAY = "2000-01-01"
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return keep


def _competitions(spark, d):
    n = table(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("competition_id"), F.col("n_name").alias("name"), (2023 + F.col("n_nationkey") % 4).alias("season"), "n_regionkey")


@query("report_filter", f"""WITH {REPORTS_SQL} SELECT report_id, competition_id, category FROM reports WHERE category = '1-URGENT' AND 2023 + competition_id % 4 = 2024""")
def report_filter(spark, d):
    found = desk.filter_reports(reports(spark, d), _competitions(spark, d), category="1-URGENT", season=2024)
    return found.select("report_id", "competition_id", "category")


@query("reports_in_list", f"""WITH {REPORTS_SQL} SELECT report_id, state FROM reports WHERE report_id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1)""")
def reports_in_list(spark, d):
    ids = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(F.col("l_orderkey").alias("report_id"))
    return desk.within(reports(spark, d), ids, "report_id").select("report_id", "state")


@query("reports_by_number", """SELECT s_suppkey AS asked_id, o_orderkey AS report_id, row_number() OVER (PARTITION BY s_suppkey ORDER BY o_orderdate, o_orderkey) AS place
FROM supplier JOIN orders ON o_custkey = s_suppkey""")
def reports_by_number(spark, d):
    r = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.concat(F.lit("TF-"), "o_custkey", F.lit("/a")).alias("number"), F.col("o_orderdate").alias("uploaded"))
    asked = table(spark, d, "supplier").select(F.col("s_suppkey").alias("asked_id"), F.concat(F.lit("  tf "), "s_suppkey", F.lit(" A")).alias("number"))
    return desk.by_number(r, asked).drop("uploaded")


@query("first_tab", f"""WITH {REPORTS_SQL}, c AS (SELECT team_id, count(*) FILTER (state = 'waiting') AS waiting, count(*) FILTER (state = 'uploaded') AS uploaded,
  count(*) FILTER (state = 'completed') AS completed FROM reports GROUP BY team_id)
SELECT *, CASE WHEN waiting > 0 THEN 'waiting' WHEN uploaded > 0 THEN 'uploaded' ELSE 'completed' END AS tab FROM c""")
def first_tab(spark, d):
    tabs = ["waiting", "uploaded", "completed"]
    return desk.first_tab(reports(spark, d).groupBy("team_id").agg(*[F.count_if(F.col("state") == t).alias(t) for t in tabs]), tabs)


@query("application_stage", f"""WITH {ASSIGNMENTS_SQL}, {_SCORES_SQL}
SELECT o_orderkey AS application_id, CASE WHEN o_totalprice <= 60000 THEN 'applied' WHEN final IS NOT NULL THEN 'concluded' WHEN s.report_id IS NOT NULL THEN 'evaluation' ELSE 'uploaded' END AS stage,
       o_totalprice > 60000 AND s.report_id IS NOT NULL AS locked
FROM orders LEFT JOIN scores s ON s.report_id = o_orderkey""")
def application_stage(spark, d):
    o, a = table(spark, d, "orders"), assignments(spark, d)
    uploaded = o.where("o_totalprice > 60000").select(F.col("o_orderkey").alias("application_id"), F.col("o_orderkey").alias("report_id"))
    return desk.application_stage(o.select(F.col("o_orderkey").alias("application_id")), uploaded, a, review.final_scores(a))


@query("competition_readiness", """WITH c AS (SELECT s_nationkey AS id, count(*) AS categories, count(*) FILTER (s_acctbal > 0) AS approved, count(*) FILTER (s_suppkey % 2 = 0) AS with_spec,
  count(*) FILTER (s_suppkey % 4 = 0) AS with_summary FROM supplier GROUP BY s_nationkey)
SELECT n_nationkey AS competition_id, coalesce(categories, 0) AS categories, coalesce(approved, 0) AS approved, coalesce(with_spec, 0) AS with_spec, coalesce(with_summary, 0) AS with_summary,
  CASE WHEN n_nationkey % 3 <> 0 THEN CASE WHEN categories > 0 AND categories = approved THEN 'ready' ELSE 'needs_review' END WHEN n_regionkey < 3 THEN 'installable' ELSE 'no_template' END AS status
FROM nation LEFT JOIN c ON id = n_nationkey""")
def competition_readiness(spark, d):
    c = _competitions(spark, d)
    k = table(spark, d, "supplier").select(F.col("s_nationkey").alias("competition_id"), (F.col("s_acctbal") > 0).alias("approved"), (F.col("s_suppkey") % 2 == 0).alias("spec"), (F.col("s_suppkey") % 4 == 0).alias("summary"))
    return desk.readiness(c.select("competition_id", (F.col("n_regionkey") < 3).alias("has_template")), c.where("competition_id % 3 <> 0"), k)


@query("competition_levels", """WITH e AS (
  SELECT n_nationkey AS id, n_nationkey % 8 AS p FROM nation UNION ALL SELECT s_nationkey, s_suppkey % 31 FROM supplier UNION ALL SELECT c_nationkey, c_custkey % 97 FROM customer
) SELECT id AS competition_id, array_to_string([['İlkokul', 'Ortaokul', 'Yıldızlar', 'Lise', 'Üniversite', 'Mezun'][p + 1] FOR p IN list_sort(list_distinct(list(p)))], ',') AS levels
FROM e WHERE p < 6 GROUP BY id""")
def competition_levels(spark, d):
    level = lambda k: F.get(F.array(*map(F.lit, desk.LEVELS)), k.cast("int"))
    own = table(spark, d, "nation").select(F.col("n_nationkey").alias("competition_id"), level(F.col("n_nationkey") % 8).alias("level"))
    docs = table(spark, d, "supplier").select(F.col("s_nationkey").alias("competition_id"), level(F.col("s_suppkey") % 31).alias("level"))
    names = table(spark, d, "customer").select(F.col("c_nationkey").alias("competition_id"), F.concat_ws(" ", "c_mktsegment", level(F.col("c_custkey") % 97)).alias("name"))
    return desk.levels(own, docs, names).withColumn("levels", F.array_join("levels", ","))


@query("already_applied", """SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW' AND o_orderstatus <> 'P') AS duplicate FROM customer""")
def already_applied(spark, d):
    incoming = table(spark, d, "customer").select("c_custkey", F.concat(F.lit(" iı-"), "c_custkey").alias("number"), F.lit("5-low").alias("code"))
    known = table(spark, d, "orders").select(F.concat(F.lit("İI-"), "o_custkey").alias("number"), F.col("o_orderpriority").alias("code"), (F.col("o_orderstatus") != "P").alias("active"))
    return desk.already_applied(incoming, known).select("c_custkey", "duplicate")


@query("evaluation_gate", f"""WITH {ASSIGNMENTS_SQL}, s AS (SELECT l_orderkey AS report_id, CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS referee_id, l_linenumber AS line,
  0.0 + l_quantity + coalesce(CASE WHEN l_linenumber <> 2 THEN l_tax END, 0) + l_discount AS total FROM lineitem)
SELECT s.report_id, s.referee_id, line, CASE WHEN a.report_id IS NULL THEN 'not_assigned' WHEN a.state = 'completed' THEN 'completed' ELSE 'accepted' END AS verdict, s.total
FROM s LEFT JOIN assignments a ON a.report_id = s.report_id AND a.referee_id = s.referee_id""")
def evaluation_gate(spark, d):
    line = F.col("l_linenumber")
    s = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("report_id"), F.when(line % 3 == 0, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey")).alias("referee_id"), line.alias("line"),
        F.array(F.col("l_quantity"), F.when(line != 2, F.col("l_tax")), F.col("l_discount")).alias("scores"),
    )
    return desk.evaluation_gate(s, assignments(spark, d)).drop("scores")


@query("delete_guard", f"""WITH {ASSIGNMENTS_SQL}
SELECT c_custkey AS referee_id, count(report_id) AS n_assigned, CASE WHEN coalesce(bool_or(state IS NOT NULL AND report_id IS NOT NULL), false) THEN 'deactivate' ELSE 'delete' END AS action
FROM customer LEFT JOIN assignments ON referee_id = c_custkey GROUP BY c_custkey""")
def delete_guard(spark, d):
    """Referees have the numbers of customers; those beyond the suppliers were never assigned a report."""
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("referee_id"))
    return desk.delete_guard(s, assignments(spark, d))


@query("bulk_insert", """SELECT o_orderkey, o_custkey, CASE WHEN o_custkey IN (SELECT s_suppkey FROM supplier) THEN 'exists' WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 THEN 'repeated' ELSE 'inserted' END AS outcome
FROM orders""")
def bulk_insert(spark, d):
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("o_custkey"))
    return desk.bulk_insert(table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", "o_orderkey")


@query("competition_tree", """SELECT n_nationkey AS competition_id, 2023 + n_nationkey % 4 AS season, CAST(row_number() OVER (ORDER BY n_nationkey % 4 DESC, n_name) AS INTEGER) AS place,
  (SELECT string_agg(s_name, ',' ORDER BY s_acctbal, s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS children FROM nation""")
def competition_tree(spark, d):
    children = table(spark, d, "supplier").withColumn("competition_id", F.col("s_nationkey"))
    out = desk.with_children(_competitions(spark, d), children, "competition_id", [F.col("season").desc(), F.col("name")], F.col("s_name"), F.struct("s_acctbal", "s_name"))
    return out.select("competition_id", "season", "place", F.array_join("children", ",").alias("children"))


@query("report_referees", f"""WITH {ASSIGNMENTS_SQL} SELECT report_id, s_name AS name, CAST(row_number() OVER (PARTITION BY report_id ORDER BY assigned, referee_id) AS INTEGER) AS place
FROM assignments JOIN supplier ON s_suppkey = referee_id""")
def report_referees(spark, d):
    a = assignments(spark, d).join(table(spark, d, "supplier"), F.col("referee_id") == F.col("s_suppkey"))
    return desk.listed(a, "report_id", [F.col("assigned"), F.col("referee_id")]).select("report_id", F.col("s_name").alias("name"), "place")


@query("team_members", """SELECT n_name AS team, c_name AS person, c_custkey % 10 = 0 AS captain, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey % 10 <> 0, c_custkey) AS INTEGER) AS place
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def team_members(spark, d):
    m = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("captain", F.col("c_custkey") % 10 == 0)
    return desk.listed(m, "n_nationkey", [F.col("captain").desc(), F.col("c_custkey")]).select(F.col("n_name").alias("team"), F.col("c_name").alias("person"), "captain", "place")


@query("unread_questions", f"""WITH {MESSAGES_SQL}, {REPORTS_SQL}, o AS (SELECT report_id, max(CASE WHEN role <> 'referee' THEN seq END) AS other FROM messages GROUP BY report_id),
u AS (SELECT report_id, count(*) FILTER (seq > coalesce(other, -1)) AS unread, arg_max(text, seq) AS question FROM messages JOIN o USING (report_id) WHERE role = 'referee' GROUP BY report_id)
SELECT u.report_id, n_name AS competition, unread, md5(question) AS question FROM u JOIN reports r ON r.report_id = u.report_id JOIN nation ON n_nationkey = competition_id""")
def unread_questions(spark, d):
    u = desk.unread(messages(spark, d)).join(reports(spark, d).select("report_id", "competition_id"), "report_id").join(_competitions(spark, d), "competition_id")
    return u.select("report_id", F.col("name").alias("competition"), "unread", F.md5(F.col("question").cast("binary")).alias("question"))


@query("pair_records", """SELECT least(l_suppkey, l_partkey % 100) AS a, greatest(l_suppkey, l_partkey % 100) AS b, count(*) AS n, max(l_shipdate) AS latest FROM lineitem GROUP BY ALL""")
def pair_records(spark, d):
    return desk.pair_records(table(spark, d, "lineitem").withColumn("p", F.col("l_partkey") % 100), "l_suppkey", "p", "l_shipdate")


@query("taken_numbers", """SELECT c_custkey + 1000 AS number, number IN (SELECT o_custkey FROM orders) OR number IN (SELECT s_suppkey FROM supplier) OR number IN (SELECT p_partkey * 7 FROM part) AS taken FROM customer""")
def taken_numbers(spark, d):
    o, s, p = table(spark, d, "orders").select("o_custkey"), table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "part").select(F.col("p_partkey") * 7)
    return desk.taken_keys(table(spark, d, "customer").select((F.col("c_custkey") + 1000).alias("number")), "number", o, s, p)


@query("conversation_sources", f"""WITH {MESSAGES_SQL}
SELECT 'report' AS source, report_id AS id, count(*) AS n, max(seq) AS last FROM messages GROUP BY report_id
UNION ALL SELECT 'application', user_id, count(*), max(event_id) FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def conversation_sources(spark, d):
    m = messages(spark, d).groupBy(F.col("report_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last")).select(F.lit("report").alias("source"), "id", "n", "last")
    e = table(spark, d, "events").where("event_type <> 'error'").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))
    return m.unionByName(e.withColumn("source", F.lit("application")))


@query("seasons", """SELECT season, CAST(row_number() OVER (ORDER BY season DESC) AS INTEGER) AS place FROM (SELECT DISTINCT 2023 + n_nationkey % 4 AS season FROM nation)""")
def seasons(spark, d):
    s = _competitions(spark, d).select("season").distinct().withColumn("_all", F.lit(1))
    return desk.listed(s, "_all", [F.col("season").desc()]).drop("_all")


@query("shared_targets", """SELECT split_part(url, '?', 1) AS source, min(page_id) AS page_id, count(*) - 1 AS sharers FROM pages GROUP BY 1""")
def shared_targets(spark, d):
    return desk.shared_targets(table(spark, d, "pages"), F.substring_index("url", "?", 1), "page_id")


@query("unassigned_first", f"""WITH {REPORTS_SQL} SELECT report_id, uploaded, report_id IN (SELECT l_orderkey FROM lineitem) AS assigned FROM reports
ORDER BY assigned, uploaded DESC, report_id LIMIT 60""")
def unassigned_first(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"))
    r = desk.taken_keys(reports(spark, d).select("report_id", "uploaded"), "report_id", lines).withColumnRenamed("taken", "assigned")
    return r.orderBy("assigned", F.col("uploaded").desc(), "report_id").limit(60)


@query("deadline_board", f"""WITH {REPORTS_SQL}, g AS (SELECT competition_id AS group_id, count(*) AS applications, count(*) FILTER (state = 'waiting') AS missing,
  CAST(DATE '1999-12-20' + INTERVAL (competition_id * 3 % 25) DAY AS DATE) AS deadline FROM reports GROUP BY competition_id)
SELECT *, CAST(deadline - DATE '{TODAY}' AS INTEGER) AS days FROM g ORDER BY deadline < DATE '{TODAY}', deadline, missing DESC, group_id LIMIT 6""")
def deadline_board(spark, d):
    g = reports(spark, d).groupBy(F.col("competition_id").alias("group_id")).agg(F.count(F.lit(1)).alias("applications"), F.count_if(F.col("state") == "waiting").alias("missing"))
    g = g.withColumn("deadline", F.date_add(F.lit("1999-12-20").cast("date"), F.col("group_id") * 3 % 25))
    return desk.deadline_board(g, F.lit(TODAY).cast("date"))


@query("score_summary", f"""WITH {REPORTS_SQL}, {ASSIGNMENTS_SQL}, {_SCORES_SQL}, n AS (SELECT count(*) AS n FROM assignments GROUP BY referee_id)
SELECT (SELECT floor(avg(final) * 10 + 0.5) / 10 FROM scores JOIN reports USING (report_id) WHERE state = 'completed') AS mean,
       (SELECT count(final) FROM scores JOIN reports USING (report_id) WHERE state = 'completed') AS n, min(n.n) AS fewest, max(n.n) AS most, max(n.n) - min(n.n) AS gap FROM n""")
def score_summary(spark, d):
    a = assignments(spark, d)
    # Two tables of one row each.
    return desk.mean_published(review.final_scores(a), reports(spark, d)).join(F.broadcast(desk.balance(a)))


@query("usage_by_kind", """SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls, bool_and(event_type <> 'error' OR value > 5) AS all_cached FROM events GROUP BY event_type""")
def usage_by_kind(spark, d):
    calls = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("tokens"), ((F.col("event_type") != "error") | (F.col("value") > 5)).alias("cached"))
    return desk.usage(calls, "event_type")


_ADDRESSED_SQL = "a AS (SELECT report_id, seq, role, CASE WHEN seq % 5 <> 4 THEN seq % 3 END AS referee_id FROM messages WHERE NOT automatic)"


@query("referees_awaiting", f"""WITH {MESSAGES_SQL}, {_ADDRESSED_SQL}
SELECT report_id, referee_id FROM a WHERE referee_id IS NOT NULL GROUP BY ALL HAVING arg_max(role, seq) = 'referee'""")
def referees_awaiting(spark, d):
    m = messages(spark, d).withColumn("referee_id", F.when(F.col("seq") % 5 != 4, F.col("seq") % 3))
    return desk.referees_awaiting(m)


@query("awaiting_scope", f"""WITH {MESSAGES_SQL}, {REPORTS_SQL}, l AS (SELECT report_id, arg_max(role, seq) AS role, max(seq) AS seq FROM messages WHERE NOT automatic GROUP BY report_id)
SELECT l.report_id, seq FROM l JOIN reports r ON r.report_id = l.report_id WHERE role = 'referee' AND 2023 + competition_id % 4 IN (2024, 2025)""")
def awaiting_scope(spark, d):
    c = _competitions(spark, d)
    r = [desk.filter_reports(reports(spark, d), c, season=s) for s in (2024, 2025)]
    return desk.latest_open(messages(spark, d), r[0].unionByName(r[1]))


@query("session_expiry", """SELECT user_id, count(*) AS n, count(*) FILTER (ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-05 00:00:00') AS alive, max(ts + INTERVAL 30 DAY) AS last FROM events GROUP BY user_id""")
def session_expiry(spark, d):
    s = desk.expiry(table(spark, d, "events").select("user_id", "ts"), "ts", F.lit("2024-02-05 00:00:00").cast("timestamp"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("alive").alias("alive"), F.max("expires").alias("last"))


@query("loose_identity", """WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS x, lead(lower(p_type || ' of the ' || p_name || ' kind')) OVER (ORDER BY p_partkey) AS y FROM part),
w AS (SELECT *, list_distinct([t FOR t IN string_split(x, ' ') IF length(t) > 2]) AS a, list_distinct([t FOR t IN string_split(y, ' ') IF length(t) > 2]) AS b FROM p WHERE y IS NOT NULL)
SELECT p_partkey, contains(x, y) OR contains(y, x) OR (least(len(a), len(b)) > 0 AND len(list_intersect(a, b)) / least(len(a), len(b)) >= 0.6) AS same FROM w""")
def loose_identity(spark, d):
    p = table(spark, d, "part")
    x = p.select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("x"))
    y = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower(F.concat(F.col("p_type"), F.lit(" of the "), F.col("p_name"), F.lit(" kind"))).alias("y"))
    return x.join(y, "p_partkey").select("p_partkey", desk.loosely_equal(F.col("x"), F.col("y")).alias("same"))


_SECTIONS_SQL = """s AS (SELECT p_brand AS doc_id, (p_partkey % 7 + 1) || CASE WHEN p_partkey % 3 > 0 THEN '.' || (p_partkey % 5 + 1) ELSE '' END || CASE WHEN p_partkey % 3 = 2 THEN '.' || p_partkey ELSE '' END AS number,
  sum(p_size) AS words FROM part GROUP BY 1, 2)"""


@query("effective_words", f"""WITH {_SECTIONS_SQL} SELECT x.doc_id, x.number, CAST(any_value(x.words) AS BIGINT) AS words, CAST(any_value(x.words) + coalesce(sum(y.words), 0) AS BIGINT) AS effective
FROM s x LEFT JOIN s y ON y.doc_id = x.doc_id AND starts_with(y.number, x.number || '.') GROUP BY x.doc_id, x.number""")
def effective_words(spark, d):
    k = F.col("p_partkey")
    number = F.concat((k % 7 + 1).cast("string"), F.when(k % 3 > 0, F.concat(F.lit("."), (k % 5 + 1).cast("string"))).otherwise(""), F.when(k % 3 == 2, F.concat(F.lit("."), k.cast("string"))).otherwise(""))
    return desk.effective_words(table(spark, d, "part").groupBy(F.col("p_brand").alias("doc_id"), number.alias("number")).agg(F.sum("p_size").alias("words")))


#: Required headings of three made-up templates, in order of preference.
TEMPLATES = {"new": ["small ring", "large gear", "blue bolt", "green plate"], "old": ["small gear", "red ring", "large bolt"], "first": ["steel frame", "copper wire"]}
_TEMPLATES_SQL = "h(template, rank, key) AS (VALUES " + ", ".join(f"('{t}', {i}, '{k}')" for i, (t, keys) in enumerate(TEMPLATES.items()) for k in keys) + ")"


@query("template_findings", f"""WITH {_TEMPLATES_SQL}, t AS (SELECT DISTINCT CAST(p_partkey // 10 AS BIGINT) AS doc_id, p_name AS key FROM part),
f AS (SELECT doc_id, template, rank, count(DISTINCT h.key) AS found FROM t JOIN h ON 1 - levenshtein(t.key, h.key) / greatest(length(t.key), length(h.key)) >= 0.72 GROUP BY ALL),
z AS (SELECT template, count(*) AS size FROM h GROUP BY template), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY found / size DESC, rank) AS k FROM f JOIN z USING (template)),
d AS (SELECT DISTINCT doc_id, doc_id % 30 AS pages, doc_id % 11 = 0 AS scanned, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0 END AS holes FROM t),
x AS (SELECT d.*, template, coalesce(found / size, 0) AS share, coalesce(template <> 'new' AND found / size > 0.5, false) AS old FROM d LEFT JOIN b ON b.doc_id = d.doc_id AND k = 1)
SELECT doc_id, 'SCANNED' AS code, 'error' AS severity FROM x WHERE scanned UNION ALL SELECT doc_id, 'TEMPLATE_OLD', 'warning' FROM x WHERE old
UNION ALL SELECT doc_id, 'TEMPLATE_UNKNOWN', 'error' FROM x WHERE NOT old AND share < 0.5 UNION ALL SELECT doc_id, 'PAGES_OVER', 'warning' FROM x WHERE pages > 20
UNION ALL SELECT doc_id, 'PAGES_UNDER', 'warning' FROM x WHERE pages < 5 UNION ALL SELECT doc_id, 'PLACEHOLDERS_LEFT', 'warning' FROM x WHERE holes > 0""")
def template_findings(spark, d):
    s = table(spark, d, "part").select(F.expr("p_partkey div 10").alias("doc_id"), F.col("p_name").alias("key")).distinct()
    h = spark.createDataFrame([(t, i, k) for i, (t, keys) in enumerate(TEMPLATES.items()) for k in keys], "template string, rank int, key string")
    n = F.col("doc_id")
    docs = s.select("doc_id").distinct().select("doc_id", (n % 30).alias("pages"), (n % 11 == 0).alias("scanned"), F.when(n % 5 == 0, 2).otherwise(0).alias("n_placeholders"))
    return desk.template_findings(docs, desk.best_template(s, h), "new", 5, 20)


@query("document_status", f"""WITH q AS ({_language_sql()}), f AS (
  SELECT doc_id, CASE WHEN language IN ('undetermined', 'mixed') THEN 2 ELSE 3 END AS s FROM q WHERE language <> lang
  UNION ALL SELECT doc_id, 1 FROM q WHERE n_tokens < 40)
SELECT d.doc_id, ['clean', 'info', 'warning', 'error'][coalesce(max(s), 0) + 1] AS status, count(s) AS n_findings FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id""")
def document_status(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    judged = checks.languages(docs, "text", _LANGS)
    short = judged.where("n_tokens < 40").select("doc_id", F.lit("SHORT").alias("code"), F.lit("info").alias("severity"))
    return checks.overall(docs.select("doc_id"), checks.language_findings(judged, F.col("lang")), short)


@query("merged_rules", """SELECT p_partkey AS category_id, coalesce(s.lo, CASE WHEN p_size % 3 > 0 THEN p_size END) AS min_pages, coalesce(s.hi, p_size + 10) AS max_pages, coalesce(s.hi <> p_size + 10, false) AS conflict
FROM part LEFT JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 5 END AS lo, CASE WHEN s_suppkey % 5 > 0 THEN CAST(s_suppkey % 60 AS INTEGER) END AS hi FROM supplier) s ON s_suppkey = p_partkey""")
def merged_rules(spark, d):
    k = F.col("s_suppkey")
    t = table(spark, d, "part").select(F.col("p_partkey").alias("category_id"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("min_pages"), (F.col("p_size") + 10).alias("max_pages"))
    s = table(spark, d, "supplier").select(k.alias("category_id"), F.when(k % 2 == 0, 5).alias("min_pages"), F.when(k % 5 > 0, (k % 60).cast("int")).alias("max_pages"))
    return desk.merged_rules(t, s)


@query("names_as_seen", f"""WITH {ASSIGNMENTS_SQL}, a AS (
  SELECT report_id, referee_id, substr('ABCDEFGHJKLMNOPRSTUVYZ', row_number() OVER (PARTITION BY report_id ORDER BY assigned, referee_id), 1) AS alias,
         min(referee_id) OVER (PARTITION BY report_id) AS me FROM assignments)
SELECT report_id, referee_id, CASE WHEN referee_id = me THEN 'you (' || alias || ')' ELSE alias END AS shown FROM a""")
def names_as_seen(spark, d):
    a = assignments(spark, d).select("report_id", "referee_id", "assigned")
    me = a.groupBy("report_id").agg(F.min("referee_id").alias("me"))
    return desk.seen_as(review.referee_alias(a), me).select("report_id", "referee_id", "shown")


@query("short_names", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Supplier#0000…' WHEN s_suppkey % 3 = 1 THEN 'Kaya' || s_suppkey ELSE 'Dr.' END AS short FROM supplier""")
def short_names(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("Prof. Dr. "), "s_name")).when(k % 3 == 1, F.concat(F.lit("Doç.  Ali Kaya"), k.cast("string"), F.lit(" (geçiş öncesi)"))).otherwise("Dr. (x)")
    return table(spark, d, "supplier").select("s_suppkey", T.short_name(name).alias("short"))


@query("source_checks", """WITH k AS (SELECT p_partkey, p_name || ' in ' || p_type || ' parts' AS t, 1990 + p_size AS y FROM part)
SELECT p_partkey, t AS title, 'Akyon' AS author, CASE WHEN p_partkey % 2 = 0 THEN '10.1000/x' || p_partkey END AS doi, p_partkey % 4 = 3 AS unindexed, p_partkey % 5 = 1 AS local_venue, y AS year,
  array_to_string(list_concat(CASE WHEN y > 2025 THEN ['FUTURE_YEAR'] ELSE [] END, CASE WHEN p_partkey % 4 = 3 AND y >= 2025 THEN ['DATED_ENCYCLOPAEDIA'] ELSE [] END,
    CASE WHEN p_partkey % 4 = 3 THEN ['NO_ACCESS_DATE'] ELSE [] END), ',') AS flags FROM k""")
def source_checks(spark, d):
    k = F.col("p_partkey")
    raw = F.concat(
        F.lit("F. C. Akyon, “"), "p_name", F.lit(" in "), "p_type", F.lit(" parts,” "), F.when(k % 5 == 1, "Ulusal Sempozyum, ").otherwise("Journal, "), (1990 + F.col("p_size")).cast("string"),
        F.when(k % 2 == 0, F.concat(F.lit(", 10.1000/x"), k.cast("string"), F.lit("."))).otherwise(""), F.when(k % 4 == 3, ", en.wikipedia.org").otherwise(""),
    )
    s = table(spark, d, "part").select("p_partkey", raw.alias("raw")).withColumn("r", T.reference_entry(F.col("raw")))
    s = s.withColumn("s", T.source_fields(F.col("raw")))
    flags = T.source_flags(F.col("raw"), F.col("r.year"), F.col("r.doi"), F.col("r.link"), F.col("r.bare_link"), 2025)
    return s.select("p_partkey", "s.title", "s.author", "s.doi", "s.unindexed", "s.local_venue", F.col("r.year").alias("year"), F.array_join(flags, ",").alias("flags"))


@query("bibliography_patterns", """WITH e AS (SELECT p_brand AS doc_id, p_size % 25 = 0 AS doi, CASE WHEN p_brand LIKE '%2' THEN 2022 + p_size % 3 ELSE 1980 + p_size END AS y, p_partkey % 3 = 0 AS lost FROM part)
SELECT doc_id, count(*) AS n, NOT bool_or(doi) AND count(*) >= 4 AS no_doi, min(y) >= 2022 AS all_recent, count(*) FILTER (lost) >= 2 AND count(*) FILTER (lost) / count(*) >= 0.4 AS many_lost FROM e GROUP BY doc_id""")
def bibliography_patterns(spark, d):
    e = table(spark, d, "part").select(
        F.col("p_brand").alias("doc_id"), (F.col("p_size") % 25 == 0).alias("doi"), F.when(F.col("p_brand").like("%2"), 2022 + F.col("p_size") % 3).otherwise(1980 + F.col("p_size")).alias("year"), F.lit(True).alias("academic"), (F.col("p_partkey") % 3 == 0).alias("lost"),
    )
    return checks.bibliography_patterns(e, 2025)


@query("plain_counts", f"""WITH {MESSAGES_SQL}, w AS (SELECT report_id FROM messages WHERE NOT automatic GROUP BY report_id HAVING arg_max(role, seq) = 'referee')
SELECT (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS texts, (SELECT count(DISTINCT o_custkey) FROM orders) AS teams, (SELECT count(*) FROM w) AS waiting""")
def plain_counts(spark, d):
    # Three tables of one row each.
    texts = table(spark, d, "documents").agg(F.count("text").alias("texts"))
    teams = table(spark, d, "orders").agg(F.countDistinct("o_custkey").alias("teams"))
    waiting = desk.latest_open(messages(spark, d), messages(spark, d).select("report_id").distinct()).agg(F.count(F.lit(1)).alias("waiting"))
    return texts.join(F.broadcast(teams)).join(F.broadcast(waiting)).select("texts", "teams", "waiting")
