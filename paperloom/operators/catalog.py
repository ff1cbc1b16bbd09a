"""Catalogue pages: titles, links, slugs, and what documents they offer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

# Patterns, on comparison keys, of stages and levels, the first that fits wins.
STAGES = [
    ("ÖDR", r"on degerlendirme raporu|\bodr\b"), ("ÖTR", r"on tasarim raporu|\botr\b"), ("PDR", r"proje detay raporu|\bpdr\b"),
    ("DTR", r"detayli tasarim raporu|\bdtr\b"), ("KTR", r"kritik tasarim raporu|\bktr\b"), ("ÖNR", r"proje oneri raporu|oneri raporu|\bonr\b|\bpor\b"),
]
LEVELS = [
    ("Lise", r"\blise\b"), ("Üniversite", r"\buniversite\b"), ("Ortaokul", r"\bortaokul\b"), ("İlkokul", r"\bilkokul\b"),
    ("Yıldızlar", r"\byildizlar\b"), ("Mezun", r"\bmezun\b"),
]
# What a document is, by its label and file name.
ATTACHMENT, INSTRUCTION = r"attachment|\bek[\s-]?\d|checklist|kontrol listesi", "yonerge|video|sunum|poster|afis"
#: Words that name a document, not a category, and what names all categories.
DOCUMENT_WORDS = (
    "yarışması yarismasi yarısması yarışmaları yarislari yarışları TEKNOFEST şablonu sablonu şablon raporu rapor"
    " şartnamesi sartnamesi şartname sartname formu kitapçığı kitapcigi bölüm bolum"
).split()
ALL_CATEGORIES = "tum kategori"
NO_TEMPLATE = r"\b(form|formu|dilekce|taahhut|muvafakat|tutanak|tutanagi|kilavuz|yonerge|talimat)\b"


def _first(key: Column, patterns: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(key.rlike(p), n) for n, p in patterns])


def stage(key: Column) -> Column:
    return _first(key, STAGES)


def level(key: Column) -> Column:
    return _first(key, LEVELS)


def document_type(key: Column, extension: Column) -> Column:
    """technical_spec before spec, since the one name holds the other; attachments and instructions are never templates."""
    return (
        F.when(key.rlike("teknik sartname"), "technical_spec")
        .when(key.rlike(ATTACHMENT) | key.rlike(INSTRUCTION), "other")
        .when(key.rlike("sablon|template"), "template")
        .when(key.rlike("sartname"), "spec")
        .when(extension.isin("docx", "doc") & key.rlike(r"\brapor") & ~key.rlike(NO_TEMPLATE), "template")
        .otherwise("other")
    )


def category_name(label: Column) -> Column:
    """The category that a document's label names: what stands before "kategori" and behind the last word for a document
    or year, without leading marks and ordinal. Null without that word, for all categories, and without a letter."""
    flat = T.repair(label)
    before = F.substring(flat, F.lit(1), F.locate("kategori", F.lower(F.translate(flat, *T.FOLDED))) - 1)
    name = F.regexp_replace(before, r"(?isu)^.*(?:" + "|".join(DOCUMENT_WORDS) + r"|\d{4})", "")
    name = F.regexp_replace(F.regexp_replace(name, r"^[\s\-–—/,:.]+", ""), r"^\d+[\s\-–—.)]+", "")
    name = F.substring(F.trim(F.regexp_replace(name, r"\s+", " ")), 1, 90)
    return F.when(~F.contains(T.fold(flat), F.lit(ALL_CATEGORIES)) & (F.length(name) >= 2) & name.rlike(r"\p{L}"), name)


def title(html: Column, slug: Column, plain: bool = False, longest: int | None = None) -> Column:
    """First heading, else the page title, of five characters or more; else the slug in words. What follows a bar or long
    dash at the end (the site's name) is cut. `longest`: characters, markup included, beyond which a heading is passed over."""

    def of(tag: str) -> Column:
        raw = F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.{{3,{longest or ""}}}?)</{tag}>", 1)
        name = F.trim(F.regexp_replace(T.strip_tags(raw), r"\s*[|–—]\s*[^|–—]*$", ""))
        return F.when(F.length(name) >= 5, name)

    return F.coalesce(of("h1"), of("title"), slug if plain else F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))


def links(pages: DataFrame, longest: int | None = None) -> DataFrame:
    """page_id, href, label: distinct links of each page; of one address the first label that is not blank wins.

    `longest`: characters, markup included, beyond which a label is passed over with its link.
    """
    found = F.regexp_extract_all("html", F.lit(rf'(?is)<a[^>]*href="[^"]+"[^>]*>.{{0,{longest or ""}}}?</a>'), F.lit(0))
    a = pages.select("page_id", F.posexplode(found).alias("ord", "tag"))
    a = a.select("page_id", "ord", F.regexp_extract("tag", '(?is)href="([^"]+)"', 1).alias("href"), T.strip_tags(F.col("tag")).alias("label"))
    best = F.min_by("label", F.struct(F.col("label") == "", "ord"))
    return a.groupBy("page_id", "href").agg(best.alias("label"))


def slugs(pages: DataFrame, pattern: str, blacklist: tuple[str, ...] = ()) -> DataFrame:
    """Distinct captures of `pattern` over all pages, without the blacklist."""
    s = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("slug")).distinct()
    return s.where(~F.col("slug").isin(list(blacklist))) if blacklist else s


def distinguishing(rows: DataFrame, group: str, label_key: str, row_id: str) -> DataFrame:
    """row_id, tokens: the words of a label that not all labels of its group hold, in order."""
    t = rows.select(group, row_id, F.posexplode(F.split(label_key, " ")).alias("ord", "token"))
    size = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    n = t.groupBy(group, "token").agg(F.countDistinct(row_id).alias("_n"))
    keep = t.join(n, [group, "token"]).join(size, group).where("_n <> _size")
    words = F.transform(F.array_sort(F.collect_list(F.struct("ord", "token"))), lambda x: x["token"])
    return keep.groupBy(row_id).agg(F.array_join(words, " ").alias("tokens"))


def merge(catalog: DataFrame, installed: DataFrame) -> DataFrame:
    """Catalogue entries with what is installed: by slug first, then by name in small letters; leftovers are appended.

    catalog: slug, name; installed: slug, name, id. Returns slug, name, id, origin (both, catalogue, installed).
    """
    low = lambda c: T.lower_tr(F.trim(c))
    by_slug = installed.where("slug is not null").groupBy("slug").agg(F.min("id").alias("_by_slug"))
    by_name = installed.groupBy(low(F.col("name")).alias("_low")).agg(F.min("id").alias("_by_name"))
    c = catalog.join(by_slug, "slug", "left").join(by_name, low(F.col("name")) == F.col("_low"), "left")
    c = c.select("slug", "name", F.coalesce("_by_slug", "_by_name").alias("id"))
    rest = installed.join(c.where("id is not null").select("id").distinct(), "id", "left_anti").select("slug", "name", "id", F.lit("installed").alias("origin"))
    return c.withColumn("origin", F.when(F.col("id").isNotNull(), "both").otherwise("catalogue")).unionByName(rest)


def spec_for(categories: DataFrame, specs: DataFrame) -> DataFrame:
    """Each category with its own spec, else the competition's: two left joins and a coalesce."""
    own = specs.where("category_id is not null").select("category_id", F.col("spec").alias("_own"))
    wide = specs.where("category_id is null").select("competition_id", F.col("spec").alias("_wide"))
    c = categories.join(own, "category_id", "left").join(wide, "competition_id", "left")
    return c.withColumn("spec", F.coalesce("_own", "_wide")).drop("_own", "_wide")


def search(rows: DataFrame, columns: list[str], term: str) -> DataFrame:
    """Rows whose columns, as comparison keys on end, hold every word of `term`; a blank term keeps all."""
    hay = T.fold(F.concat_ws(" ", *columns))
    words = F.split(T.fold(F.lit(term)), " ")
    return rows.where(F.forall(words, lambda w: F.contains(hay, w)))


def first_spelling(rows: DataFrame, code: str, wanted: str) -> DataFrame:
    """Rows whose access code is `wanted` but for case, blanks and hyphens."""
    return rows.where(T.access_code(F.col(code)) == T.access_code(F.lit(wanted)))


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 50) -> DataFrame:
    """The given page (from 1) of the rows in `order`."""
    return rows.orderBy(*order).offset((max(1, page) - 1) * size).limit(size)


def latest_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, that of the highest version: how an upsert reads back."""
    # An aggregate, so that a key of very many versions is reduced where its rows are.
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(version, *rows.columns)).alias("_r")).select("_r.*")
