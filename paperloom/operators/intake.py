"""Taking reports in: fields of the cover, codes and numbers that nobody has yet, texts that left without approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: Labels of cover fields, as comparison keys.
COVER_LABELS = {
    "team": ["takim adi", "takim ismi"],
    "team_code": ["takim id", "takim kodu", "takim no", "takim numarasi"],
    "application": ["basvuru id", "basvuru no", "basvuru numarasi", "basvuru kodu"],
    "project": ["proje adi", "proje basligi", "proje ismi"],
    "level": ["takim seviyesi", "seviye", "katilim seviyesi"],
}
#: Letters of access codes, without those that are mistaken for another.
CODE_LETTERS = "ABCDEFGHJKMNPQRSTUVWXYZ23456789"
#: Fixed value: model texts shorter than this are not looked for.
LEAK_LENGTH = 25


def _field(label: Column) -> Column:
    """The cover field that a label's key ends with, else null."""
    whens = F.lit(None).cast("string")
    for name, labels in reversed(COVER_LABELS.items()):
        whens = F.when(label.rlike("(" + "|".join(labels) + ")$"), name).otherwise(whens)
    return whens


def _is_value(text: Column) -> Column:
    return F.length(text).between(2, 90) & text.rlike(r"[\p{L}\p{N}]")


def cover_fields(lines: DataFrame, pages: int = 3) -> DataFrame:
    """doc_id and the five cover fields, null where not found: one row per document with a line on its first pages.

    lines: doc_id, ord, page, line, repeated (page headers and footers, which are left out; null: kept). A label is what
    the last three words before a line's first colon end with; its value stands behind the colon or, if none does, on the
    next line that is not blank, unless that holds a label. Blanks to fill in are no values. The first value of a field
    counts. One document's first pages are sorted at a time, never a corpus.
    """
    t = lines.where((F.col("page") <= pages) & ~F.coalesce("repeated", F.lit(False))).select("doc_id", "ord", T.repair(F.col("line")).alias("t"))
    t = t.where("t != ''").withColumn("next", F.coalesce(F.lead("t").over(Window.partitionBy("doc_id").orderBy("ord")), F.lit("")))
    colon = F.locate(":", "t")
    three = F.regexp_extract(F.expr("left(t, greatest(locate(':', t) - 1, 0))"), r"((?:\S+\s+){0,2}\S*\s*)$", 1)
    own = F.trim(F.expr("substring(t, locate(':', t) + 1)"))
    below = F.when(_field(T.fold(F.substring_index("next", ":", 1))).isNull(), F.trim("next")).otherwise("")
    v = t.withColumn("field", F.when(colon > 0, _field(T.fold(three)))).withColumn("value", F.when(_is_value(own), own).otherwise(below))
    v = v.withColumn("field", F.when(_is_value(F.col("value")) & ~F.col("value").rlike(r"^\{.*\}$"), F.col("field")))
    first = lambda f: F.min_by("value", F.when(F.col("field") == f, F.col("ord"))).alias(f)
    return v.groupBy("doc_id").agg(*[first(f) for f in COVER_LABELS])


def leaks(published: DataFrame, texts: DataFrame, approved: DataFrame) -> DataFrame:
    """group_id, text: the model's texts that stand in their group's published text without having been approved.

    published: group_id, page. texts, approved: group_id, text. Texts are trimmed; those under 25 characters are passed
    over. A text only ever meets the page of its own group, and equal texts of a group meet it once.
    """
    t = texts.select("group_id", F.trim("text").alias("text")).where(F.length("text") >= LEAK_LENGTH).distinct()
    t = t.join(approved.select("group_id", F.trim("text").alias("text")), ["group_id", "text"], "left_anti")
    return t.join(published, "group_id").where(F.contains("page", "text")).select("group_id", "text")


def new_numbers(asked: DataFrame, taken: DataFrame, prefix: str = "TF", digits: int = 5) -> DataFrame:
    """`asked` (id, year; no others) with a number `prefix-year-digits` that neither `taken` (number) nor another row has.

    The free numbers of a year are dealt in scattered order, to its rows by id; rows beyond the last free number get null.
    Ids are distinct; without a year there is no number. A year has 10^digits numbers at most, so both sides of a year are
    cut to that before they are numbered.
    """
    n = 10**digits
    years = asked.select("year").distinct()
    grid = years.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    number = F.concat_ws("-", F.lit(prefix), F.col("year").cast("string"), F.lpad(F.col("n").cast("string"), digits, "0"))
    free = grid.withColumn("number", number).join(taken.select("number"), "number", "left_anti")
    # 73939 shares no factor with a power of ten, so the order is one of all numbers.
    free = free.withColumn("k", F.row_number().over(Window.partitionBy("year").orderBy((F.col("n").cast("long") * 73939) % n)))
    rank = F.row_number().over(Window.partitionBy("year").orderBy("id"))
    dealt = asked.withColumn("k", rank).where(F.col("k") <= n).join(free, ["year", "k"]).select("id", "year", "number")
    return asked.join(dealt, ["id", "year"], "left")


def new_codes(asked: DataFrame, *taken: DataFrame, attempts: int = 4) -> DataFrame:
    """`asked` (id; no others) with an access code XXXX-XXXX that no table of `taken` (code) nor another row has.

    A row tries `attempts` codes made from its id and takes the first that nobody else tries and that is free, however it
    is spelled there; if none is, the code is null. Reruns agree. Ids are told apart by their text and must be distinct.
    """
    digest = F.md5(F.concat_ws(":", F.col("id").cast("string"), F.col("attempt").cast("string")).cast("binary"))
    letters = [F.substring(F.lit(CODE_LETTERS), (F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("int") % len(CODE_LETTERS)) + 1, F.lit(1)) for i in range(8)]
    tried = asked.select("id", F.explode(F.array(*[F.lit(a) for a in range(attempts)])).alias("attempt"))
    tried = tried.select("id", "attempt", F.concat(*letters).alias("plain"))
    one = tried.groupBy("plain").agg(F.min(F.struct("id", "attempt")).alias("x"), F.count(F.lit(1)).alias("n")).where("n = 1")
    for t in taken:
        one = one.join(t.select(T.access_code(F.col("code")).alias("plain")), "plain", "left_anti")
    first = one.groupBy(F.col("x.id").alias("id")).agg(F.min_by("plain", "x.attempt").alias("p"))
    return asked.join(first, "id", "left").select("id", F.expr("concat(left(p, 4), '-', right(p, 4))").alias("code"))
