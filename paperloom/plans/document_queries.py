"""Queries of document analytics over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import hashing
from paperloom.functions import numbers as N
from paperloom.functions import text as T
from paperloom.operators import checks
from paperloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def repair_sql(x: str) -> str:
    """functions.text.repair as SQL."""
    for a, b in T.MOJIBAKE:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    bad = _quoted(f"[{T.CP1254[0]}]")
    x = f"(SELECT CASE WHEN regexp_matches(t, {bad}) AND NOT regexp_matches(t, {_quoted(T.INTACT)}) THEN translate(t, {_quoted(T.CP1254[0])}, {_quoted(T.CP1254[1])}) ELSE t END FROM (SELECT {x} AS t))"
    for a, b in T.LIGATURES:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    x = f"nfc_normalize(translate({x}, {_quoted(T.TYPOGRAPHY[0])}, {_quoted(T.TYPOGRAPHY[1])}))"
    for p, b in T.DETACHED:
        x = f"regexp_replace({x}, {_quoted(p)}, {_quoted(b)}, 'g')"
    marks = _quoted("[̀-ͯ]")
    return f"trim(regexp_replace(regexp_replace({x}, {marks}, '', 'g'), '[ \t]+', ' ', 'g'))"


def fold_sql(x: str) -> str:
    x = f"lower(translate({x}, {_quoted(T.FOLDED[0])}, {_quoted(T.FOLDED[1])}))"
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_KEYS_SQL = f"keys AS (SELECT doc_id, source, lang, {fold_sql(repair_sql('text'))} AS k FROM documents)"


def _keys(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", "lang", T.key(F.col("text")).alias("k"))


@query("doc_key", f"WITH {_KEYS_SQL} SELECT doc_id, md5(k) AS key_md5, length(k) AS key_length FROM keys")
def doc_key(spark, d):
    return _keys(spark, d).select("doc_id", F.md5(F.col("k").cast("binary")).alias("key_md5"), F.length("k").cast("long").alias("key_length"))


_DAMAGE = "|".join([a for a, _ in T.MOJIBAKE] + [p for p, _ in T.DETACHED])


@query("token_stats", f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct,
floor(len(regexp_extract_all(text, {_quoted(_DAMAGE)})) / greatest(length(text) / 100, 1.0) * 1000 + 0.5) / 1000 AS damage FROM (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}''’-]+'), lambda x: length(x) > 1) AS w FROM documents)""")
def token_stats(spark, d):
    w = table(spark, d, "documents").select("doc_id", "text", T.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), N.round_up_half(T.damage(F.col("text")), 3).alias("damage"))


_LANGS = ("en", "fr", "de", "es")


def _language_sql() -> str:
    lists = {n: "[" + ", ".join(_quoted(w) for w in checks.FUNCTION_WORDS[n]) + "]" for n in _LANGS}
    hits = ", ".join(f"CAST(len(list_filter(w, lambda x: list_contains({lists[n]}, x))) AS DOUBLE) AS h_{n}" for n in _LANGS)
    total = " + ".join(f"h_{n}" for n in _LANGS)
    shares = ", ".join(f"CASE WHEN t > 0 THEN h_{n} / t ELSE 0.0 END AS share_{n}" for n in _LANGS)
    ranked = "list_reverse_sort([" + ", ".join(f"{{'s': share_{n}, 'n': '{n}'}}" for n in _LANGS) + "])"
    return f"""WITH w AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(translate(text, 'İI', 'iı')), '[^\\p{{L}}]+'), lambda x: length(x) > 1) AS w FROM documents),
h AS (SELECT doc_id, lang, CAST(len(w) AS INTEGER) AS n_tokens, {hits} FROM w), t AS (SELECT *, {total} AS t FROM h),
s AS (SELECT *, {shares} FROM t), r AS (SELECT *, {ranked} AS r FROM s)
SELECT doc_id, lang, n_tokens, CASE WHEN n_tokens < 20 OR t < 5 THEN 'undetermined' WHEN r[1].s - r[2].s < 0.25 THEN 'mixed' ELSE r[1].n END AS language,
       CASE WHEN n_tokens < 20 OR t < 5 THEN 0.0 ELSE r[1].s - r[2].s END AS confidence FROM r"""


@query("language_id", f"""WITH q AS ({_language_sql()}) SELECT lang, language, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS n_tokens,
floor(avg(confidence) * 1000 + 0.5) / 1000 AS confidence FROM q GROUP BY ALL""")
def language_id(spark, d):
    judged = checks.languages(table(spark, d, "documents").select("doc_id", "lang", "text"), "text", _LANGS)
    return judged.groupBy("lang", "language").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tokens"), N.round_up_half(F.avg("confidence"), 3).alias("confidence"))


@query("language_findings", f"""WITH q AS ({_language_sql()})
SELECT CASE language WHEN 'undetermined' THEN 'LANGUAGE_UNDETERMINED' WHEN 'mixed' THEN 'LANGUAGE_MIXED' ELSE 'LANGUAGE_OTHER' END AS code,
       CASE WHEN language IN ('undetermined', 'mixed') THEN 'warning' ELSE 'error' END AS severity, count(*) AS n FROM q WHERE language <> lang GROUP BY ALL""")
def language_findings(spark, d):
    judged = checks.languages(table(spark, d, "documents").select("doc_id", "lang", "text"), "text", _LANGS)
    return checks.histogram(checks.language_findings(judged, F.col("lang")))


_HITS_SQL = ", ".join(f"regexp_extract_all(text, {_quoted(p)})" for p in T.PLACEHOLDERS)
_HIT_KEY_SQL = f"trim(regexp_replace(lower(translate(hit, {_quoted(T.FOLDED[0])}, {_quoted(T.FOLDED[1])})), '[^a-z0-9]+', ' ', 'g'))"


@query("placeholder_hits", f"""WITH d AS (SELECT 'document' AS origin, doc_id, text FROM documents UNION ALL SELECT 'page', page_id, html FROM pages),
h AS (SELECT DISTINCT origin, doc_id, trim(unnest(flatten([{_HITS_SQL}]))) AS hit FROM d)
SELECT origin, doc_id, count(*) AS n_hits, min(hit) AS first_hit FROM h
WHERE NOT regexp_matches(hit, '^\\[\\s*\\d[\\d\\s,–-]*\\]$') AND length({_HIT_KEY_SQL}) >= 2 GROUP BY origin, doc_id""")
def placeholder_hits(spark, d):
    """Over documents and over pages as they come, whose short tags look like <places to fill in>."""
    texts = table(spark, d, "documents").select(F.lit("document").alias("origin"), "doc_id", "text")
    texts = texts.unionByName(table(spark, d, "pages").select(F.lit("page").alias("origin"), F.col("page_id").alias("doc_id"), F.col("html").alias("text")))
    found = texts.select("origin", "doc_id", F.explode(T.placeholders(F.col("text"))).alias("hit"))
    return found.groupBy("origin", "doc_id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("hit").alias("first_hit"))


@query("citation_numbers", """WITH g AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '\\[(\\d{1,3}(?:\\s*[-–,]\\s*\\d{1,3})*)\\]', 1)) AS g FROM documents
), p AS (SELECT doc_id, [CAST(x AS INTEGER) FOR x IN regexp_extract_all(unnest(string_split(g, ',')), '\\d{1,3}')] AS e FROM g),
n AS (SELECT doc_id, unnest(CASE WHEN len(e) = 1 THEN [e[1]] WHEN e[2] >= e[1] AND e[2] - e[1] < 100 THEN range(e[1], e[2] + 1) ELSE [] END) AS n FROM p)
SELECT doc_id, count(DISTINCT n) AS n_numbers, CAST(max(n) AS INTEGER) AS largest FROM n GROUP BY doc_id""")
def citation_numbers(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.explode(T.citations(F.col("text"))).alias("n"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_numbers"), F.max("n").alias("largest"))


# Words too common in the tables' prose to tell their sources apart.
STOP = "that with this from have which avec dans pour nicht eine para como entre".split()


@query("term_profile", f"""WITH {_KEYS_SQL}, t AS (SELECT source, unnest(string_split(k, ' ')) AS term FROM keys), n AS (
  SELECT source, term, count(*) AS n FROM t WHERE length(term) >= 4 AND NOT regexp_matches(term, '^[0-9]') AND term NOT IN ({", ".join(map(_quoted, STOP))})
  GROUP BY ALL HAVING count(*) >= 2)
SELECT source, term, n, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, term) AS place FROM n) WHERE place <= 40""")
def term_profile(spark, d):
    return checks.term_profiles(_keys(spark, d), "source", "k", STOP)


def _term_rows():
    fold = str.maketrans(*T.FOLDED)
    return sorted({(n, w.translate(fold)) for n in _LANGS for w in checks.FUNCTION_WORDS[n]})


_TERMS_SQL = "terms(category, term) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in _term_rows()) + ")"
_CATEGORY_SQL = f"""{_KEYS_SQL}, {_TERMS_SQL}, weighted AS (
  SELECT category, term, ln((4 + 1) / (count(*) OVER (PARTITION BY term) + 0.5)) AS idf FROM terms
), hits AS (
  SELECT doc_id, greatest(1.0, len(string_split(any_value(k), ' ')) / 1000) AS long, term, count(*) AS tf
  FROM (SELECT doc_id, k, unnest(string_split(k, ' ')) AS term FROM keys) WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, term
), scores AS (
  SELECT doc_id, category, sum((1 + ln(tf)) * idf / long) AS score, count(*) AS n_terms FROM hits JOIN weighted USING (term) GROUP BY doc_id, category
)"""


def _category_scores(spark, d):
    return checks.category_scores(_keys(spark, d), "k", spark.createDataFrame(_term_rows(), "category string, term string"))


@query("category_tfidf", f"""WITH {_CATEGORY_SQL}
SELECT doc_id, category, floor(score * 1000 + 0.5) / 1000 AS score, n_terms, floor(score / sum(score) OVER (PARTITION BY doc_id) * 1000 + 0.5) / 1000 AS share FROM scores""")
def category_tfidf(spark, d):
    s = _category_scores(spark, d)
    return s.select("doc_id", "category", N.round_up_half(F.col("score"), 3).alias("score"), "n_terms", N.round_up_half(F.col("share"), 3).alias("share"))


@query("category_verdict", f"""WITH {_CATEGORY_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS k FROM scores), b AS (
  SELECT doc_id, max(category) FILTER (k = 1) AS best, max(score) FILTER (k = 1) AS s1, max(n_terms) FILTER (k = 1) AS n_terms,
         max(category) FILTER (k = 2) AS second, max(score) FILTER (k = 2) AS s2 FROM k GROUP BY doc_id)
SELECT d.doc_id, lang AS category, best, second, coalesce(b.n_terms, 0) AS n_terms, CASE WHEN coalesce(b.n_terms, 0) < 3 OR coalesce(s1 < 1.4 * s2, false) THEN 'unclear'
       WHEN best <> lang AND coalesce(s1 >= 2 * s.score, true) THEN 'misfit' ELSE 'fits' END AS verdict
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN scores s ON s.doc_id = d.doc_id AND s.category = d.lang""")
def category_verdict(spark, d):
    declared = table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"))
    return checks.category_verdict(_category_scores(spark, d), declared)


# Ends of sentences are marked, marks behind abbreviations are taken away again, and what is left cuts: RE2 has no look-behind.
_KEY_SQL = f"trim(regexp_replace(lower(translate(s, {_quoted(T.FOLDED[0])}, {_quoted(T.FOLDED[1])})), '[^a-z0-9]+', ' ', 'g'))"


@query("sentence_commonness", f"""WITH m AS (
  SELECT doc_id, regexp_replace(regexp_replace(text, '\\n+', ' ', 'g'), '([.!?])(\\s+)([{T.CAPITAL}])', '\\1' || chr(1) || '\\2\\3', 'g') AS t FROM documents
), c AS (
  SELECT doc_id, trim(unnest(string_split_regex(
    regexp_replace(t, '(^|[^\\p{{L}}])({"|".join(T.ABBREVIATIONS)})([.!?])\\x01', '\\1\\2\\3', 'gi'), '\\x01\\s+'))) AS s FROM m
), k AS (SELECT DISTINCT doc_id, {_KEY_SQL} AS s FROM c WHERE length(s) > 20)
SELECT md5(s) AS sentence, count(*) AS n_documents, array_to_string(list_sort(list(doc_id))[1:8], ',') AS first_documents
FROM k WHERE len(string_split(s, ' ')) >= 8 GROUP BY s HAVING count(*) >= 2""")
def sentence_commonness(spark, d):
    """Sentences (comparison keys of eight words or more) that two documents or more hold: hash, number of documents, and
    the first eight of them.

    One count per document and sentence is pre-aggregated, so that a boilerplate sentence is no hot group, and the window
    for the first eight keeps no more than eight rows of a sentence in any task.
    """
    from pyspark.sql import Window

    s = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(T.sentences(F.col("text")), lambda x: T.fold(x)))).alias("s"))
    s = s.where(F.size(F.split("s", " ")) >= 8).select(F.md5(F.col("s").cast("binary")).alias("sentence"), "doc_id").distinct()
    n = s.groupBy("sentence").agg(F.count(F.lit(1)).alias("n_documents")).where("n_documents >= 2")
    first = s.withColumn("_k", F.row_number().over(Window.partitionBy("sentence").orderBy("doc_id"))).where("_k <= 8")
    ids = first.groupBy("sentence").agg(F.array_sort(F.collect_list("doc_id")).alias("first_documents"))
    return n.join(ids, "sentence").select("sentence", "n_documents", F.array_join(F.col("first_documents").cast("array<string>"), ",").alias("first_documents"))


@query("heading_numbers", """SELECT p_partkey, CASE WHEN regexp_matches(h, p) THEN regexp_replace(regexp_extract(h, p, 1), '[.)]+$', '') END AS number,
CASE WHEN regexp_matches(h, p) THEN trim(regexp_extract(h, p, 2)) ELSE h END AS title FROM (
  SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size || '.' || p_size % 7 || '. ' ELSE '' END || p_name AS h,
         '^((?:\\d{1,2}[.)]){1,3}\\d{0,2}|[IVXLC]{1,5}[.)]|[A-ZÇĞİÖŞÜ][.)])\\s+(.*)$' AS p FROM part)""")
def heading_numbers(spark, d):
    size = F.col("p_size")
    head = F.concat(F.when(size % 2 == 0, F.concat(size.cast("string"), F.lit("."), (size % 7).cast("string"), F.lit(". "))).otherwise(""), F.col("p_name"))
    n = T.heading_number(head)
    return table(spark, d, "part").select("p_partkey", n["number"].alias("number"), n["title"].alias("title"))


@query("fuzzy_titles", """WITH a AS (SELECT DISTINCT p_name AS x FROM part), b AS (SELECT DISTINCT p_name AS y FROM part),
s AS (SELECT x, y, 1 - levenshtein(x, y) / greatest(length(x), length(y)) AS s FROM a, b WHERE x <> y)
SELECT x AS title, y AS match, floor(s * 1000 + 0.5) / 1000 AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS k FROM s WHERE s >= 0.55) WHERE k = 1""")
def fuzzy_titles(spark, d):
    from paperloom.operators.similarity import best_titles

    names = table(spark, d, "part").select(F.col("p_name").alias("title")).distinct()
    return best_titles(names, names.withColumnRenamed("title", "match"))


@query("pseudonyms", """WITH c AS (SELECT s_suppkey, [ascii(x) FOR x IN string_split(s_name, '')] AS codes FROM supplier),
h AS (SELECT s_suppkey, list_reduce(list_prepend(CAST(2166136261 AS HUGEINT), [CAST(x AS HUGEINT) FOR x IN codes]), lambda a, x:
  ((CAST(CAST(CASE WHEN xor(a, x) >= 2147483648 THEN xor(a, x) - 4294967296 ELSE xor(a, x) END AS DOUBLE) * 16777619 AS HUGEINT) % 4294967296) + 4294967296) % 4294967296) AS h FROM c)
SELECT s_suppkey, array_to_string([substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(h // p % 36 AS BIGINT) + 1, 1) FOR p IN [46656, 1296, 36, 1]], '') AS pseudonym FROM h""")
def pseudonyms(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", hashing.pseudonym(F.col("s_name")).alias("pseudonym"))
