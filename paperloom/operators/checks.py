"""Checks of documents: language, category fit, term profiles, bibliographies, findings and their worst severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.session import materialize

# Function words by language.
FUNCTION_WORDS = {
    "tr": (
        "ve bir bu için ile olarak olan daha gibi sonra ancak ise da de ki en çok her veya göre üzere kadar tarafından içinde "
        "arasında bulunmaktadır edilmiştir yapılmıştır olduğu amacıyla nedeniyle"
    ).split(),
    "en": (
        "the and of to in is for with that this are as be by on from was were which has have been these their can will other between"
    ).split(),
    "fr": "le la les de des du et un une dans est pour que qui sur avec par pas au aux ce se il elle".split(),
    "de": "der die das und den dem von zu mit sich des auf für ist im nicht ein eine als auch es an werden aus er hat".split(),
    "es": "el los las y en que del un una por con para es su al lo como más o pero sus le ya este entre".split(),
}
SEVERITIES = ("clean", "info", "warning", "error")
MIN_TOKENS, MIN_EVIDENCE, MIN_GAP = 20, 5, 0.25
MIN_TERMS, MIN_LEAD, MISFIT = 3, 1.4, 2.0


def languages(docs: DataFrame, text: str, names: tuple[str, ...]) -> DataFrame:
    """`docs` (doc_id, ...) without text plus n_tokens, one share per language, language and confidence.

    language: undetermined under 20 tokens or 5 function words, mixed if the two best shares are within 0.25. Words that
    several languages share count for each. Turkish letters count as evidence too, at most 5 % of the tokens. Tokens meet
    the function words, a table of fixed size, in an equi-join and are counted per document before any shuffle.
    """
    spark = docs.sparkSession
    d = docs.withColumn("_w", T.letters_only(T.lower_tr(F.col(text)))).withColumn("n_tokens", F.size("_w"))
    every = sorted({w for n in names for w in FUNCTION_WORDS[n]})
    rows = [(w, *(w in FUNCTION_WORDS[n] for n in names)) for w in every]
    known = spark.createDataFrame(rows, "token string, " + ", ".join(f"_{n} boolean" for n in names))
    hits = d.select("doc_id", F.explode("_w").alias("token")).join(known, "token").groupBy("doc_id").agg(*[F.count_if(F.col(f"_{n}")).alias(f"_{n}") for n in names])
    bonus = F.least(F.regexp_count(F.col(text), F.lit("[ığşİĞŞ]")) / 12, F.col("n_tokens") * 0.05)
    d = d.join(hits, "doc_id", "left").fillna(0, [f"_{n}" for n in names])
    hits = [F.col(f"_{n}").cast("double") + (bonus if n == "tr" else 0.0) for n in names]
    d = d.withColumn("_h", F.array(*hits)).drop("_w", text, *[f"_{n}" for n in names])
    total = F.aggregate("_h", F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("_t", total)
    shares = [F.when(F.col("_t") > 0, F.get("_h", F.lit(i)) / F.nullif(F.col("_t"), F.lit(0.0))).otherwise(0.0).alias(f"share_{n}") for i, n in enumerate(names)]
    d = d.select("*", *shares)
    ranked = F.sort_array(F.array(*[F.struct(F.col(f"share_{n}").alias("s"), F.lit(n).alias("n")) for n in names]), asc=False)
    gap = F.get(ranked, F.lit(0))["s"] - F.get(ranked, F.lit(1))["s"]
    weak = (F.col("n_tokens") < MIN_TOKENS) | (F.col("_t") < MIN_EVIDENCE)
    language = F.when(weak, "undetermined").when(gap < MIN_GAP, "mixed").otherwise(F.get(ranked, F.lit(0))["n"])
    return d.withColumn("language", language).withColumn("confidence", F.when(weak, 0.0).otherwise(gap)).drop("_h", "_t")


def language_findings(judged: DataFrame, expected: Column) -> DataFrame:
    """Findings (doc_id, code, severity) of documents that are not in the expected language."""
    code = (
        F.when(F.col("language") == "undetermined", F.struct(F.lit("LANGUAGE_UNDETERMINED").alias("code"), F.lit("warning").alias("severity")))
        .when(F.col("language") == "mixed", F.struct(F.lit("LANGUAGE_MIXED").alias("code"), F.lit("warning").alias("severity")))
        .when(F.col("language") != expected, F.struct(F.lit("LANGUAGE_OTHER").alias("code"), F.lit("error").alias("severity")))
    )
    return judged.select("doc_id", code.alias("f")).where(F.col("f").isNotNull()).select("doc_id", "f.*")


def term_profiles(docs: DataFrame, group: str, key: str, stop: list[str], k: int = 40) -> DataFrame:
    """The `k` most frequent terms of each group: four characters or more, no leading digit, no stop word, twice or more."""
    t = docs.select(group, F.explode(F.split(key, " ")).alias("term"))
    t = t.where((F.length("term") >= 4) & ~F.col("term").rlike("^[0-9]") & ~F.col("term").isin(stop))
    n = t.groupBy(group, "term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), "term")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def category_scores(docs: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """doc_id, category, score, share, n_terms: sublinear TF-IDF of each document against the categories' terms.

    terms: category, term (a comparison key of one word). A term of df of N categories weighs ln((N + 1) / (df + .5));
    scores are per 1000 words. Categories without a hit give no row. Documents meet terms by an equi-join on the term.
    """
    t = terms.dropDuplicates(["category", "term"])
    n = t.select("category").distinct().agg(F.count(F.lit(1)).alias("n_categories"))
    df = t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = t.join(df, "term").join(F.broadcast(n)).withColumn("idf", F.log((F.col("n_categories") + 1) / (F.col("df") + 0.5)))  # n: one row
    # The words are split once and their number stands beside them before they are dealt out; then only numbers travel.
    split = docs.select("doc_id", F.split(key, " ").alias("_w")).select("doc_id", "_w", F.greatest(F.lit(1.0), F.size("_w") / 1000).alias("long"))
    words = split.select("doc_id", "long", F.explode("_w").alias("term"))
    hits = words.join(weighted.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "long", "term").agg(F.count(F.lit(1)).alias("tf"))
    part = (1 + F.log("tf")) * F.col("idf") / F.col("long")
    s = hits.join(weighted, "term").groupBy("doc_id", "category").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n_terms"))
    # Written once: verdicts read the scores twice, and a few numbers are cheaper than the texts.
    s = materialize(s, "scores")
    return s.withColumn("share", F.col("score") / F.sum("score").over(Window.partitionBy("doc_id")))


def category_verdict(scores: DataFrame, declared: DataFrame) -> DataFrame:
    """Per document: best and second category, lead, verdict (unclear, fits, misfit) against the declared category.

    unclear: under 3 terms, or the best not 1.4 times the second; misfit: the best is another one, 2 times the declared.
    A document without any term has 0 of them and is unclear.
    """
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "category")
    top = scores.withColumn("k", F.row_number().over(w))
    at = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    best = top.groupBy("doc_id").agg(at(1, "category").alias("best"), at(1, "score").alias("s1"), at(1, "n_terms").alias("n_terms"), at(2, "category").alias("second"), at(2, "score").alias("s2"))
    own = scores.join(declared, ["doc_id", "category"]).select("doc_id", F.col("score").alias("s0"))
    out = declared.join(best, "doc_id", "left").fillna(0, ["n_terms"]).join(own, "doc_id", "left")
    unclear = (F.col("n_terms") < MIN_TERMS) | F.coalesce(F.col("s1") < MIN_LEAD * F.col("s2"), F.lit(False))
    misfit = (F.col("best") != F.col("category")) & F.coalesce(F.col("s1") >= MISFIT * F.col("s0"), F.lit(True))
    return out.select("doc_id", "category", "best", "second", "n_terms", F.when(unclear, "unclear").when(misfit, "misfit").otherwise("fits").alias("verdict"))


def bibliography(lines: DataFrame, body: str) -> DataFrame:
    """Per document: listed entries, cited numbers, cited but not listed, listed but never cited, weak entries.

    lines: doc_id, ord, line (of the bibliography). If two lines or more are numbered, only numbers begin an entry;
    otherwise a line that begins with a small letter goes on. Entries under three words are left out.
    """
    pattern = r"^\[?(\d{1,3})[\].)]\s+(.+)$"
    by_doc = Window.partitionBy("doc_id")
    n = lines.withColumn("m", F.regexp_extract("line", pattern, 1)).withColumn("numbered", F.count_if(F.col("m") != "").over(by_doc) >= 2)
    begins = F.when(F.col("numbered"), F.col("m") != "").otherwise(~F.col("line").rlike(f"^[{T.SMALL}(]"))
    e = n.withColumn("entry", F.sum(begins.cast("int")).over(by_doc.orderBy("ord"))).withColumn("t", F.when(F.col("m") != "", F.regexp_extract("line", pattern, 2)).otherwise(F.col("line")))
    e = e.groupBy("doc_id", "entry").agg(F.max(F.nullif("m", F.lit(""))).cast("int").alias("number"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"]), " ").alias("raw"))
    e = e.where(F.size(T.tokens(F.col("raw"))) >= 3).withColumn("r", T.reference_entry(F.col("raw")))
    weak = F.col("r.bare_link") | (F.col("r.year").isNull() & ~F.col("r.doi"))
    place = F.row_number().over(by_doc.orderBy("entry"))
    listed = e.withColumn("number", F.coalesce("number", place)).groupBy("doc_id").agg(F.collect_set("number").alias("listed"), F.count_if(weak).alias("n_weak"), F.count(F.lit(1)).alias("n_entries"))
    cited = lines.groupBy("doc_id").agg(F.first(T.citations(F.col(body))).alias("cited"))
    out = cited.join(listed, "doc_id", "left").withColumn("listed", F.coalesce("listed", F.array().cast("array<int>")))
    lost = F.when(F.size("cited") > 0, F.array_sort(F.array_except("listed", "cited"))).otherwise(F.array().cast("array<int>"))
    return out.select("doc_id", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("n_weak", F.lit(0)).alias("n_weak"), F.array_sort(F.array_except("cited", "listed")).alias("unlisted"), lost.alias("uncited"))


def bibliography_findings(b: DataFrame, at_least: int = 3) -> DataFrame:
    """Findings of the bibliography: empty, too few, no citation, cited but not listed, listed but not cited, weak."""
    some = lambda c: F.size(c) > 0
    rules = [
        (F.col("n_entries") == 0, "BIBLIOGRAPHY_EMPTY", "error"), ((F.col("n_entries") > 0) & (F.col("n_entries") < at_least), "BIBLIOGRAPHY_SHORT", "warning"),
        (some("unlisted"), "CITED_NOT_LISTED", "error"), (some("uncited"), "LISTED_NOT_CITED", "info"), (F.col("n_weak") > 0, "SOURCES_WEAK", "info"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("code"), F.lit(s).alias("severity"))) for c, k, s in rules]))
    return b.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.lit(list(SEVERITIES)), severity) - 1


def worst(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """The worst severity of each document's findings."""
    return findings.groupBy(key).agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("status"), F.count(F.lit(1)).alias("n_findings"))


def overall(docs: DataFrame, *findings: DataFrame) -> DataFrame:
    """Per document of `docs` (doc_id): the worst severity of all checks' findings, clean without any, and their number."""
    every = reduce(DataFrame.unionByName, (f.select("doc_id", "severity") for f in findings))
    return docs.join(worst(every), "doc_id", "left").fillna({"status": "clean", "n_findings": 0})


def bibliography_patterns(entries: DataFrame, this_year: int) -> DataFrame:
    """Per document: n entries, no_doi (four academic ones or more, none with a DOI), all_recent (five dated or more, all of
    the last three years), many_lost (two or more, and .4 of the academic ones, not found where they should be).

    entries: doc_id, doi, year, academic, lost. Under three entries nothing is said.
    """
    n, academic = F.count(F.lit(1)), F.count_if("academic")
    some, lost, dated = n >= 3, F.count_if("lost"), F.count("year")
    return entries.groupBy("doc_id").agg(
        n.alias("n"),
        (some & ~F.bool_or("doi") & (academic >= 4)).alias("no_doi"),
        (some & (dated >= 5) & F.coalesce(F.min("year") >= this_year - 3, F.lit(False))).alias("all_recent"),
        (some & (lost >= 2) & (lost / F.greatest(academic, F.lit(1)) >= 0.4)).alias("many_lost"),
    )


def histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def edge_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page, line) that repeat, digits masked, on at least max(3, 60 %) of a document's pages: headers and footers."""
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    n = lines.withColumn("mask", F.regexp_replace("line", r"\d+", "#")).groupBy("doc_id", "mask").agg(F.countDistinct("page").alias("n"))
    return n.join(pages, "doc_id").where(F.col("n") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * 0.6)))


def body_size(lines: DataFrame) -> DataFrame:
    """Font size (to halves) that carries most characters of a document; the smaller on a tie; 12 without lines."""
    s = lines.withColumn("size", F.floor(F.col("size") * 2 + 0.5) / 2).groupBy("doc_id", "size").agg(F.sum(F.length("line")).alias("n"))
    return s.groupBy("doc_id").agg(F.coalesce(F.max_by("size", F.struct("n", -F.col("size"))), F.lit(12.0)).alias("size"))


def sections(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, ord, line, is_heading) as sections: the text between a heading and the next; 0 is what comes first."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    n = lines.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    body = F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("ord", "line"))))
    return n.groupBy("doc_id", "section").agg(
        F.max(F.when(F.col("is_heading"), F.col("line"))).alias("title"), F.array_join(F.transform(body, lambda x: x["line"]), "\n").alias("body")
    )


def match_headings(expected: DataFrame, found: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Greedy one-to-one match of a template's headings (template order) with a document's sections.

    expected: doc_id, ord, key, number; found: doc_id, section, key, number, words. Similarity of keys, + .25 for an equal
    number (1 at most); within .02 the section of more words wins; each section is used once.
    """
    pairs = expected.alias("e").join(found.alias("f"), "doc_id").select(
        "doc_id", "ord", "section", "words",
        F.least(F.lit(1.0), T.similarity(F.col("e.key"), F.col("f.key")) + F.when(F.col("e.number") == F.col("f.number"), 0.25).otherwise(0.0)).alias("s"),
    ).where(F.col("s") >= threshold)

    def run(p):
        import pandas as pd

        used, out = set(), []
        for ord_, g in p.sort_values(["ord", "section"]).groupby("ord"):
            best = None
            for r in g.itertuples():
                if r.section in used:
                    continue
                if best is None or r.s > best.s + 0.02 or (abs(r.s - best.s) <= 0.02 and r.words > best.words):
                    best = r
            if best is not None:
                used.add(best.section)
                out.append((best.doc_id, ord_, best.section, best.s))
        return pd.DataFrame(out, columns=["doc_id", "ord", "section", "similarity"])

    return pairs.groupBy("doc_id").applyInPandas(run, "doc_id long, ord int, section int, similarity double")
