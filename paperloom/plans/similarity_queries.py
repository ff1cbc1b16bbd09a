"""Queries of corpus similarity over the driver's tables, each with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import hashing as H
from paperloom.functions import text as T
from paperloom.functions.numbers import round_up_half
from paperloom.operators import similarity as S
from paperloom.plans.document_queries import fold_sql, repair_sql
from paperloom.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("category"), T.key(F.col("text")).alias("key"))


def _shingle_sql(table_: str, id_: str) -> str:
    key = fold_sql(repair_sql("text"))
    return f"""SELECT {id_}, list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) AS s
      FROM (SELECT {id_}, string_split({key}, ' ') AS w FROM {table_})"""


@query("boilerplate_overlap", f"""WITH d AS ({_shingle_sql("documents", "doc_id")}), p AS ({_shingle_sql("benchmark", "item_id")}),
b AS (SELECT item_id, doc_id, len(p.s) AS np, len(d.s) AS nd, count(*) AS shared
  FROM (SELECT doc_id, s, unnest(s) AS g FROM d) d JOIN (SELECT item_id, s, unnest(s) AS g FROM p) p USING (g) GROUP BY ALL)
SELECT item_id, doc_id, shared, floor(shared / least(np, nd) * 1000 + 0.5) / 1000 AS containment, floor(shared / (np + nd - shared) * 1000 + 0.5) / 1000 AS jaccard
FROM b WHERE shared / least(np, nd) >= 0.3""")  # fmt: skip
def boilerplate_overlap(spark, d):
    p = table(spark, d, "benchmark").select("item_id", T.key(F.col("text")).alias("key"))
    o = S.overlap_with(_docs(spark, d), p).where("containment >= 0.3")
    return o.select("item_id", "doc_id", "shared", round_up_half(F.col("containment"), 3).alias("containment"), round_up_half(F.col("jaccard"), 3).alias("jaccard"))


def _prints_sql() -> str:
    """fingerprints() as SQL: FNV-1a of every run of four words, then the least of each permutation."""
    key = fold_sql(repair_sql("text"))
    slots = ", ".join(f"({a}, {b})" for a, b in zip(*(x.tolist() for x in H.permutations()), strict=True))
    return f"""w AS MATERIALIZED (SELECT doc_id, source AS category, string_split({key}, ' ') AS w FROM documents),
s AS (SELECT doc_id, category, unnest([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) AS s FROM w),
f AS MATERIALIZED (SELECT DISTINCT doc_id, category, list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), [CAST(ascii(c) AS UBIGINT) FOR c IN string_split(s, '')]),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM s),
p(slot, a, b) AS (SELECT row_number() OVER () - 1, CAST(a AS UBIGINT), CAST(b AS UBIGINT) FROM (VALUES {slots}) t(a, b)),
m AS (SELECT doc_id, category, slot, min(((h * a + b) & 4294967295) >> 1) AS v FROM f, p GROUP BY ALL),
prints AS MATERIALIZED (SELECT doc_id, category, n_shingles, list(v ORDER BY slot) AS signature
  FROM m JOIN (SELECT doc_id, count(*) AS n_shingles FROM f GROUP BY doc_id) USING (doc_id) GROUP BY ALL)"""


_PAIRS_SQL = f"""{_prints_sql()},
c AS (SELECT category, signature, min(doc_id) AS doc_id, count(*) AS copies, max(n_shingles) AS n FROM prints GROUP BY category, signature),
q AS (SELECT category, x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, x.copies AS ca, y.copies AS cb,
  CAST(list_sum([CASE WHEN x.signature[i] = y.signature[i] THEN 1 ELSE 0 END FOR i IN range(1, 129)]) AS BIGINT) AS agree
  FROM c x JOIN c y USING (category) WHERE x.doc_id < y.doc_id OR (x.doc_id = y.doc_id AND x.copies > 1)),
pairs AS MATERIALIZED (SELECT category, a, b, agree, agree / 128 AS jaccard, least(1.0, agree / 128 * (na + nb) / (1 + agree / 128) / least(na, nb)) AS coverage,
  CAST(CASE WHEN a = b THEN ca * (ca - 1) / 2 ELSE ca * cb END AS BIGINT) AS n_pairs FROM q WHERE agree > 0)"""
_LIMITS_SQL = """every AS (SELECT category, count(*) * (count(*) - 1) // 2 AS n FROM prints GROUP BY category),
v AS (SELECT category, unnest(list_concat(flatten(list([coverage FOR i IN range(n_pairs)])), [0.0 FOR i IN range(CAST(any_value(e.n) - sum(n_pairs) AS BIGINT))])) AS v
  FROM pairs JOIN every e USING (category) GROUP BY category),
med AS (SELECT category, median(v) AS m FROM v GROUP BY category),
limits AS (SELECT category, greatest(0.22, m + greatest(3 * median(abs(v - m)), 0.08)) AS threshold FROM v JOIN med USING (category) GROUP BY category, m)"""


@query("signature_pairs", f"WITH {_PAIRS_SQL} SELECT category, a, b, agree, floor(coverage * 1000 + 0.5) / 1000 AS coverage, n_pairs FROM pairs WHERE agree >= 16")
def signature_pairs(spark, d):
    p = S.signature_pairs(S.fingerprints(_docs(spark, d)), 16)
    return p.select("category", "a", "b", "agree", round_up_half(F.col("coverage"), 3).alias("coverage"), "n_pairs")


@query("similarity_classes", f"""WITH {_prints_sql()}
SELECT doc_id, category, min(doc_id) OVER (PARTITION BY category, signature) AS class_id, count(*) OVER (PARTITION BY category, signature) AS copies FROM prints""")
def similarity_classes(spark, d):
    return S.classes(S.fingerprints(_docs(spark, d)))


@query("nearest_reports", f"""WITH {_PAIRS_SQL}, e AS (SELECT a AS doc_id, b AS other, greatest(coverage, jaccard) AS s FROM pairs WHERE a <> b
  UNION ALL SELECT b, a, greatest(coverage, jaccard) FROM pairs WHERE a <> b)
SELECT doc_id, other, CAST(place AS INTEGER) AS place, floor(s * 1000 + 0.5) / 1000 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, other) AS place FROM e) WHERE place <= 5""")
def nearest_reports(spark, d):
    n = S.nearest(S.signature_pairs(S.fingerprints(_docs(spark, d)), best=5), 5)
    return n.select("doc_id", "other", "place", round_up_half(F.col("score"), 3).alias("score"))


@query("flagged_pairs", f"""WITH {_PAIRS_SQL}, {_LIMITS_SQL}
SELECT category, a, b, floor(coverage * 1000 + 0.5) / 1000 AS coverage, n_pairs, floor(threshold * 1000 + 0.5) / 1000 AS threshold,
       CASE WHEN coverage >= 0.55 THEN 'text' ELSE 'little' END AS remark FROM pairs JOIN limits USING (category) WHERE coverage >= threshold""")
def flagged_pairs(spark, d):
    """Classes over the threshold of their category, largest first; thresholds come from all pairs of documents, zeros included."""
    prints = S.fingerprints(_docs(spark, d))
    limits = S.limits(prints)
    pairs = S.signature_pairs(prints, least=limits)
    plain = pairs.withColumn("n_images", F.lit(0)).withColumn("n_sentences", F.lit(0)).withColumn("same_team", F.lit(False))
    out = S.comment(S.flag(plain, limits)).orderBy(F.greatest("coverage", "jaccard").desc(), "a", "b")
    return out.select("category", "a", "b", round_up_half(F.col("coverage"), 3).alias("coverage"), "n_pairs", round_up_half(F.col("threshold"), 3).alias("threshold"), "remark")


def _images(spark, d):
    e = table(spark, d, "embeddings").where(F.size("embedding") == 64)
    return e.select(F.col("vec_id").alias("image_id"), H.median_bits(F.col("embedding")).alias("hash"))


_HASH_SQL = """h AS (
  SELECT vec_id AS image_id, CAST(list_sum([CASE WHEN CAST(embedding[i + 1] AS DOUBLE) > m THEN (CASE WHEN i = 63 THEN -9223372036854775808 ELSE CAST(1 AS HUGEINT) << CAST(i AS INTEGER) END) ELSE 0 END FOR i IN range(64)]) AS BIGINT) AS hash
  FROM (SELECT vec_id, embedding, (CAST(list_sort(embedding)[32] AS DOUBLE) + CAST(list_sort(embedding)[33] AS DOUBLE)) / 2 AS m FROM embeddings WHERE len(embedding) = 64))"""


@query("image_hash", f"WITH {_HASH_SQL} SELECT image_id, hash, CAST(bit_count(hash) AS INTEGER) AS ones FROM h")
def image_hash(spark, d):
    return _images(spark, d).withColumn("ones", F.bit_count("hash"))


@query("hamming_pairs", f"""WITH {_HASH_SQL}, v AS (SELECT image_id * 10 + v AS image_id, xor(hash, m) AS hash FROM h, (VALUES (0, 0), (1, 0), (2, 3), (3, 4095)) x(v, m)),
g AS (SELECT * FROM v WHERE bit_count(hash) BETWEEN 16 AND 48), c AS (SELECT hash, min(image_id) AS image_id FROM g GROUP BY hash)
SELECT x.image_id AS a, y.image_id AS b, CAST(bit_count(xor(x.hash, y.hash)) AS INTEGER) AS distance FROM c x JOIN c y ON x.image_id < y.image_id
WHERE bit_count(xor(x.hash, y.hash)) <= 6
UNION ALL SELECT c.image_id, g.image_id, 0 FROM g JOIN c USING (hash) WHERE g.image_id <> c.image_id""")
def hamming_pairs(spark, d):
    """Four versions of every image: as it is, an equal copy, two bits changed, twelve bits changed."""
    versions = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(m).cast("long").alias("m")) for v, m in ((0, 0), (1, 0), (2, 3), (3, 4095))])).alias("x")
    images = _images(spark, d).select("image_id", "hash", versions)
    return S.image_matches(images.select((F.col("image_id") * 10 + F.col("x.v")).alias("image_id"), F.col("hash").bitwiseXOR(F.col("x.m")).alias("hash")))


@query("asof_price", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, m.mark AS last_event FROM
  (SELECT *, l_suppkey % 50 AS user_id FROM lineitem) l ASOF LEFT JOIN
  (SELECT user_id, CAST(ts AS TIMESTAMP) - INTERVAL 8000 DAY AS at, max(event_type) AS mark FROM events GROUP BY ALL) m ON l.user_id = m.user_id AND l.l_shipdate >= m.at""")
def asof_price(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", (F.col("l_suppkey") % 50).alias("user_id"), F.col("l_shipdate").alias("at"))
    marks = table(spark, d, "events").select("user_id", (F.col("ts") - F.expr("INTERVAL 8000 DAYS")).alias("at"), F.col("event_type").alias("last_event"))
    rows = rows.withColumn("at", F.col("at").cast(dict(marks.dtypes)["at"]))
    return S.asof(rows, marks, "user_id", "at", "last_event").drop("user_id", "at")
