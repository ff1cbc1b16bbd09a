"""Queries of catalogue pages and pasted lists, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import numbers as N
from paperloom.functions import text as T
from paperloom.operators import catalog as C
from paperloom.sources.lists import parse_list
from paperloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_STRIP = "trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("html_titles", f"""WITH t AS (SELECT page_id, url,
  trim(regexp_replace({_STRIP.format("regexp_extract(html, '(?is)<h1[^>]*>(.{3,}?)</h1>', 1)")}, '\\s*[|–—]\\s*[^|–—]*$', '')) AS h,
  trim(regexp_replace({_STRIP.format("regexp_extract(html, '(?is)<title[^>]*>(.{3,}?)</title>', 1)")}, '\\s*[|–—]\\s*[^|–—]*$', '')) AS t FROM pages)
SELECT page_id, CASE WHEN length(h) >= 5 THEN h WHEN length(t) >= 5 THEN t ELSE url END AS title FROM t""")  # fmt: skip
def html_titles(spark, d):
    return table(spark, d, "pages").select("page_id", C.title(F.col("html"), F.col("url"), plain=True).alias("title"))


@query("html_links", f"""WITH a AS (SELECT page_id, unnest(l) AS tag, unnest(range(len(l))) AS ord FROM (
  SELECT page_id, regexp_extract_all(html, '(?is)<a[^>]*href="[^"]+"[^>]*>.*?</a>') AS l FROM pages)),
b AS (SELECT page_id, ord, regexp_extract(tag, '(?is)href="([^"]+)"', 1) AS href, {_STRIP.format("tag")} AS label FROM a)
SELECT page_id, href, label FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY label = '', ord) AS k FROM b) WHERE k = 1""")
def html_links(spark, d):
    return C.links(table(spark, d, "pages"))


@query("html_slugs", """SELECT DISTINCT unnest(regexp_extract_all(html, 'href="/([^"/?#]+)"', 1)) AS slug FROM pages""")
def html_slugs(spark, d):
    return C.slugs(table(spark, d, "pages"), 'href="/([^"/?#]+)"')


@query("distinguishing_tokens", """WITH t AS (SELECT p_brand, p_partkey, unnest(w) AS token, unnest(range(len(w))) AS ord FROM (
  SELECT p_brand, p_partkey, string_split(lower(p_name || ' ' || p_type), ' ') AS w FROM part)),
n AS (SELECT p_brand, token, count(DISTINCT p_partkey) AS n FROM t GROUP BY ALL), g AS (SELECT p_brand, count(*) AS size FROM part GROUP BY ALL)
SELECT p_partkey, string_agg(token, ' ' ORDER BY ord) AS tokens FROM t JOIN n USING (p_brand, token) JOIN g USING (p_brand) WHERE n <> size GROUP BY p_partkey""")
def distinguishing_tokens(spark, d):
    p = table(spark, d, "part").withColumn("label", F.lower(F.concat_ws(" ", "p_name", "p_type")))
    return C.distinguishing(p, "p_brand", "label", "p_partkey")


@query("document_types", """WITH k AS (SELECT item_id, ['teknik sartname', 'oneri raporu sablonu', 'genel sartname lise', 'video yonergesi', 'proje detay raporu'][item_id % 5 + 1] AS k FROM benchmark)
SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'technical_spec' WHEN 1 THEN 'template' WHEN 2 THEN 'spec' WHEN 3 THEN 'other' ELSE 'template' END AS type,
CASE item_id % 5 WHEN 1 THEN 'ÖNR' WHEN 4 THEN 'PDR' END AS stage, CASE WHEN item_id % 5 = 2 THEN 'Lise' END AS level FROM k""")
def document_types(spark, d):
    names = ["teknik sartname", "oneri raporu sablonu", "genel sartname lise", "video yonergesi", "proje detay raporu"]
    k = F.get(F.array(*map(F.lit, names)), (F.col("item_id") % 5).cast("int"))
    b = table(spark, d, "benchmark").select("item_id", k.alias("k"))
    return b.select("item_id", C.document_type(F.col("k"), F.lit("docx")).alias("type"), C.stage(F.col("k")).alias("stage"), C.level(F.col("k")).alias("level"))


@query("catalog_merge", """WITH c AS (SELECT 's' || n_nationkey AS slug, n_name AS name FROM nation), i AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_nationkey END AS slug, CASE WHEN s_suppkey % 3 = 0 THEN 'x' || s_name ELSE lower(n_name) END AS name, s_suppkey AS id
  FROM supplier JOIN nation ON n_nationkey = s_nationkey),
b AS (SELECT c.slug, c.name, coalesce(s.id, l.id) AS id FROM c LEFT JOIN (SELECT slug, min(id) AS id FROM i WHERE slug IS NOT NULL GROUP BY slug) s ON s.slug = c.slug
  LEFT JOIN (SELECT lower(trim(name)) AS low, min(id) AS id FROM i GROUP BY low) l ON l.low = lower(translate(trim(c.name), 'İI', 'iı')))
SELECT *, CASE WHEN id IS NULL THEN 'catalogue' ELSE 'both' END AS origin FROM b
UNION ALL SELECT slug, name, id, 'installed' FROM i WHERE id NOT IN (SELECT id FROM b WHERE id IS NOT NULL)""")
def catalog_merge(spark, d):
    n = table(spark, d, "nation")
    c = n.select(F.concat(F.lit("s"), "n_nationkey").alias("slug"), F.col("n_name").alias("name"))
    i = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("s"), "s_nationkey")).alias("slug"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("x"), "s_name")).otherwise(F.lower("n_name")).alias("name"), F.col("s_suppkey").alias("id"),
    )
    return C.merge(c, i)


@query("report_search", """SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'building') AND contains(lower(c_name || ' ' || c_mktsegment), '00001')""")
def report_search(spark, d):
    return C.search(table(spark, d, "customer"), ["c_name", "c_mktsegment"], "Building 00001").select("c_custkey", "c_name")


@query("report_page", """SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""")
def report_page(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return C.page_of(rows, [F.col("o_orderdate").desc(), F.col("o_orderkey")], 3)


@query("latest_versions", """SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_versions(spark, d):
    return C.latest_version(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


_LIST_SQL = """l AS (SELECT c_custkey AS k, c_custkey + 1 AS row, c_name AS n, c_mktsegment AS seg, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS z FROM customer)"""


def _pasted(spark, d):
    """A header, then lines with tabs, with semicolons and no number, with commas and quotes, of a number alone, without a team."""
    k, z = F.col("c_custkey"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")
    text = (
        F.when(k == 0, "Basvuru no;Takim adi")
        .when(k % 5 == 0, F.concat(F.lit("TF-2026-"), z, F.lit("\t"), "c_name", F.lit("\tT"), k.cast("string"), F.lit("\t"), "c_mktsegment", F.lit(" arm\ta@b.org")))
        .when(k % 5 == 1, F.concat(F.lit("  "), "c_name", F.lit(";"), "c_mktsegment", F.lit(" arm;x@y.org")))
        .when(k % 5 == 2, F.concat(F.lit("2026-"), z, F.lit(',"'), "c_name", F.lit('"')))
        .when(k % 5 == 3, F.concat(F.lit("TF-"), z))
        .otherwise(F.concat(z, F.lit(";;"), "c_mktsegment"))
    )
    return parse_list(table(spark, d, "customer").select((k + 1).alias("row"), text.alias("text")))


@query("pasted_list", f"""WITH {_LIST_SQL} SELECT row, CASE k % 5 WHEN 0 THEN 'TF-2026-' || z WHEN 2 THEN '2026-' || z END AS application_no, n AS team,
CASE WHEN k % 5 = 0 THEN 'T' || k END AS team_id, CASE WHEN k % 5 < 2 THEN seg || ' arm' END AS project, CASE k % 5 WHEN 0 THEN 'a@b.org' WHEN 1 THEN 'x@y.org' END AS email FROM l WHERE k > 0 AND k % 5 < 3""")
def pasted_list(spark, d):
    return _pasted(spark, d)[0]


@query("pasted_rejects", f"""WITH {_LIST_SQL} SELECT row, CASE k % 5 WHEN 3 THEN 'TF-' || z ELSE z || ';;' || seg END AS text, CASE k % 5 WHEN 3 THEN 'no team' ELSE 'unreadable team' END AS reason FROM l WHERE k % 5 >= 3""")
def pasted_rejects(spark, d):
    return _pasted(spark, d)[1]


@query("label_dates", """SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' → ' || strftime(o_orderdate, '%Y-%m-28') ELSE '' END END AS found
FROM orders""")
def label_dates(spark, d):
    """The first date of every order's label, whatever its day; null where the label has none (years before 2000)."""
    o = table(spark, d, "orders")
    day, rest = F.date_format("o_orderdate", "dd"), F.date_format("o_orderdate", "MM.yyyy")
    label = F.concat(F.lit("Son teslim "), day, F.when(F.col("o_orderkey") % 2 == 0, "-28").otherwise(""), F.lit("."), rest, F.lit(", 31.02.2020"))
    return o.select("o_orderkey", F.get(N.dates(label), F.lit(0)).alias("found"))


@query("masked_names", """SELECT s_suppkey, regexp_replace('seen by ' || s_name || ' twice', '(?i)supplier#00000000[0-9]', '***') AS shown FROM supplier""")
def masked_names(spark, d):
    names = [f"Supplier#00000000{i}" for i in range(10)]
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", T.masked(F.concat(F.lit("seen by "), "s_name", F.lit(" twice")), names, "***").alias("shown"))
