"""Quality rules per document, and host verdicts from shrunk failure rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.words import SPACES, WORD_CHAR, free, let, words
from paperloom.session import materialize

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: A host loses all its documents if its shrunk failure rate of any rule is this at least, and its odds are this many
#: times the odds in the whole corpus.
MIN_HOST_RATE, ODDS = 0.3, 4
#: Documents that the prior weighs as, at least, and where hosts don't differ by more than chance.
MIN_STRENGTH, STRENGTH = 20.0, 1000.0


def repeated_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more in the array `w` (windows compare by 64-bit hash).

    Most texts repeat nothing, which a count of distinct windows shows; only the others sort their windows.
    """

    def of_windows(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            found = F.filter(
                F.transform(
                    F.sequence(F.lit(0), F.size(s) - 1),
                    lambda i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), F.get(s, i)["i"]),
                ),
                lambda x: x.isNotNull(),
            )
            return let(
                F.array_sort(found),
                lambda p: F.aggregate(
                    p,
                    F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                    lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")),
                    lambda a: a["n"],
                ),
            )

        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(pairs), of_sorted))

    # As get() gives null beyond the end, `w` needs no bound check; too short texts have no window.
    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW)))
    )
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(windows, of_windows)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without its text, plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long; null text: 0)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CHAR))
    return docs.select(
        *[c for c in docs.columns if c != text],
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))).alias("_w"),
    ).select("*", F.col("_w.n").alias("n_words"), F.col("_w.r").alias("n_repeat_words")).drop("_w")


#: Rules of a document by name; the base verdict is that of the first two, all four are counted by host.
RULES = {
    "few_words": lambda: F.col("n_words") < MIN_WORDS,
    "repeats": lambda: 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "dup_lines": lambda: F.col("n_dup_lines") > 10,
}


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """Per host (null is one): n_docs, and for each rule n_<rule>, rate_<rule> (shrunk) and limit_<rule>; rejected.

    A rule's prior is Beta(a, b) by the method of moments from the hosts' own rates: with m the rate of all documents and
    v the variance of the hosts' rates less what chance alone gives, a + b = m (1 - m) / v - 1, kept within
    [MIN_STRENGTH, STRENGTH]. A host of few documents stays near the rate of all. A rule's limit follows from the corpus: the rate at
    ODDS times the odds of m, MIN_HOST_RATE at least. A host with a rate above its limit is rejected.
    """
    per = measured.groupBy(host).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.count_if(rule()).alias(f"n_{name}") for name, rule in RULES.items()]
    )
    moments = []
    for name in RULES:
        m = F.sum(f"n_{name}") / F.sum("n_docs")
        v = F.var_pop(F.col(f"n_{name}") / F.col("n_docs")) - m * (1 - m) * F.avg(1 / F.col("n_docs"))
        moments.append(F.struct(m.alias("m"), v.alias("v")).alias(name))
    prior = per.agg(*moments)
    rates, limits = [], []
    for name in RULES:
        m, v = F.col(f"{name}.m"), F.col(f"{name}.v")
        k = F.when(v > 0, F.greatest(F.lit(MIN_STRENGTH), F.least(F.lit(STRENGTH), m * (1 - m) / v - 1))).otherwise(STRENGTH)
        rates.append(((F.col(f"n_{name}") + m * k) / (F.col("n_docs") + k)).alias(f"rate_{name}"))
        limits.append(F.greatest(F.lit(MIN_HOST_RATE), ODDS * m / (1 - m + ODDS * m)).alias(f"limit_{name}"))
    # The priors are the one row of a global aggregate.
    out = per.join(F.broadcast(prior)).select(*per.columns, *rates, *limits)
    over = reduce(Column.__or__, (F.col(f"rate_{name}") > F.col(f"limit_{name}") for name in RULES))
    return out.withColumn("rejected", over)


def judge(docs: DataFrame, text: str = "text", host: str = "source", extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`extra` columns, the measures, base_failed, host_rejected and kept, one row per row of `docs`.

    kept: the document passes the base rules and its host is not rejected (see host_rates). Null and
    empty texts have no words and fail; null hosts are one host; repeated rows are judged each; an empty table gives an
    empty result; other columns of `docs` play no part. Measures are written once (a few numbers per document), since
    both the hosts' rates and the documents' verdicts need them. The join on the host carries no texts, and a hot host
    only makes one side of it large, which adaptive execution splits.
    """
    # The extra columns keep out of the way of the measures' names.
    slim = docs.select(*[F.col(c).alias(f"_x{i}") for i, c in enumerate(extra)], F.col(host).alias("_host"), F.col(text).alias("_text"))
    m = measures(slim, "_text")
    m = materialize(m.withColumn("base_failed", RULES["few_words"]() | RULES["repeats"]()), "quality")
    rates = host_rates(m, "_host").select(F.col("_host").alias("_h"), F.col("rejected").alias("host_rejected"))
    return m.join(rates, F.col("_host").eqNullSafe(F.col("_h")), "left").select(
        *[F.col(f"_x{i}").alias(c) for i, c in enumerate(extra)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rejected",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host_rejected")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents that the rules keep, each row by its own verdict, whatever its doc_id.

    A verdict follows from text and source, so rows are named by 128 bits of hashes of these: no copy of the texts is
    written, and rows of one name share their fate. Rows of null or empty text go; an empty table gives an empty one;
    other columns pass through, whatever their names.
    """
    h, g = free(docs.columns, "_h", "_g")
    rows = docs.withColumns({h: F.xxhash64("source", "text"), g: F.xxhash64("text", F.lit(1), "source")})
    bad = judge(rows, extra=(h, g)).where(~F.col("kept")).select(h, g).distinct()
    return rows.join(bad, [h, g], "left_anti").select(*docs.columns)


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), x AS (
  SELECT *, n_words < 50 AS a, 100 * n_repeat_words > 50 * n_words AS b, 10 * n_symbols > n_words AS c, n_dup_lines > 10 AS d FROM b
), f AS (
  SELECT source, rule, count(*) AS n, count(*) FILTER (hit) AS f
  FROM (SELECT source, unnest(['few_words', 'repeats', 'symbols', 'dup_lines']) AS rule, unnest([a, b, c, d]) AS hit FROM x) GROUP BY source, rule
), p AS (
  SELECT rule, m, var - m * (1 - m) * inverse AS v
  FROM (SELECT rule, sum(f) / sum(n) AS m, var_pop(f / n) AS var, avg(1 / n) AS inverse FROM f GROUP BY rule)
), s AS (
  SELECT source, (f.f + m * k) / (n + k) > greatest(0.3, 4 * m / (1 - m + 4 * m)) AS bad
  FROM f JOIN (SELECT rule, m, CASE WHEN v > 0 THEN greatest(20.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM p) p USING (rule)
), h AS (
  SELECT source, bool_or(bad) AS rejected FROM s GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM b JOIN h ON h.source IS NOT DISTINCT FROM b.source
"""
