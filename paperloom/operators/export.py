"""Semicolon-separated exports, one column per criterion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.numbers import round_up_half
from paperloom.operators.review import score_columns

#: Labels of a category's sheet: fixed values, before and after the columns of its criteria.
FRONT = ["Başvuru No", "Takım", "Takım ID", "Proje", "Durum", "Sayfa", "Kelime"]
BACK = [
    "Nihai Puan", "Azami Puan", "Yapay Zekâ Önerisi", "Fark", "Hakem Puanları", "Hakem Sayısı", "Hakemler Arası Ayrışma", "Hakem Notları",
    "Otomatik Bulgular", "Kaynak Doğrulama", "Benzerlik", "Tamamlanma",
]

def cell(x: Column) -> Column:
    """A cell: line breaks become blanks, trimmed; quoted only if it holds a quote or a semicolon."""
    s = F.coalesce(x.cast("string"), F.lit(""))
    t = F.trim(F.regexp_replace(s, r"[\r\n]+", " "))
    quoted = F.when(t.rlike('[";]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)
    # Most cells hold none of the four and need no pattern.
    return F.when(s.contains('"') | s.contains(";") | s.contains("\r") | s.contains("\n"), quoted).otherwise(F.trim(s))


def line(columns: list[Column]) -> Column:
    return F.concat_ws(";", *[cell(c) for c in columns])


def score_sheet(scores: DataFrame, means: DataFrame, assignments: DataFrame, criteria: list[str]) -> DataFrame:
    """report_id and its line: final score, the mean of each criterion (blank if none), and "name: total" of all scorers.

    The criteria are given, so that the pivot needs no pass to find them.
    """
    wide = means.where(F.col("criterion").isin(criteria)).groupBy("report_id").pivot("criterion", criteria).agg(F.first("mean"))
    done = assignments.where(F.col("state") == "completed")
    who = F.struct("referee_id", F.concat(F.lit("R"), "referee_id", F.lit(": "), F.col("total").cast("long")).alias("t"))
    names = done.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(who)), lambda x: x["t"]), " | ").alias("names"))
    all_ = scores.join(wide, "report_id", "left").join(names, "report_id", "left")
    return all_.select("report_id", line([F.col("report_id"), F.col("final"), *[F.col(c) for c in criteria], F.col("names")]).alias("line"))


def plain(x: Column) -> Column:
    """A number without the point of whole ones."""
    s = x.cast("string")
    return F.when(s.endswith(".0"), F.left(s, F.length(s) - 2)).otherwise(s)


def category_sheets(reports: DataFrame, rubric: DataFrame, means: DataFrame, assignments: DataFrame) -> DataFrame:
    """sheet (the category), head, ord (the report), line: a row for each report, with a column for each criterion of its category.

    reports: report_id, category, number, team, team_code, project, state, pages, words, model_total, findings, sources,
    similarity, done_on. rubric: category, ord, criterion, name, points. means: report_id, criterion, mean.
    assignments: report_id, referee, state, total, note. Nulls are empty cells: a criterion that nobody scored is not 0.
    Only those who have finished are scorers, notes are those of all who have begun; "k/n" tells how many of the assigned they are. Categories without a rubric have
    no criteria columns; an empty table of reports gives no sheets. A rubric is a few rows, and its head is made once; nothing
    else is gathered by category, so one that holds most reports is no hot group. Numbers need no quotes.
    """
    number = lambda x: F.coalesce(plain(x), F.lit(""))
    criterion = F.struct("ord", "criterion", "name", "points")
    rubrics = rubric.groupBy("category").agg(F.array_sort(F.collect_list(criterion)).alias("criteria"), F.sum("points").alias("most"))
    titles = F.transform("criteria", lambda c: cell(F.concat(c["name"], F.lit(" ("), plain(c["points"]), F.lit(")"))))
    head = F.array_join(F.concat(F.array(*[F.lit(x) for x in FRONT]), titles, F.array(*[F.lit(x) for x in BACK])), ";")
    rubrics = rubrics.select("category", F.col("criteria.criterion").alias("codes"), head.alias("head"), number(F.col("most")).alias("most"))
    scored = means.where("mean IS NOT NULL").select("report_id", F.struct("criterion", number(F.col("mean")).alias("mean")).alias("m"))
    of = scored.groupBy("report_id").agg(F.map_from_entries(F.collect_list("m")).alias("means"))
    done = F.col("state") == "completed"
    said = lambda c, who: F.when(who & (F.trim(c) != ""), F.struct("referee", F.concat("referee", F.lit(": "), c).alias("t")))
    joined = lambda c, who: F.array_join(F.transform(F.array_sort(F.collect_list(said(c, who))), lambda x: x["t"]), " | ")
    who = assignments.groupBy("report_id").agg(
        joined(plain(F.col("total")), done).alias("names"), joined(F.col("note").cast("string"), F.col("state").isNotNull()).alias("notes"),
        F.concat(F.count_if(done), F.lit("/"), F.count(F.lit(1))).alias("scorers"), *score_columns(),
    )
    r = reports.join(F.broadcast(rubrics), "category", "left").join(of, "report_id", "left").join(who, "report_id", "left")
    own = F.coalesce(F.concat(F.array_join(F.transform("codes", lambda c: F.coalesce(F.try_element_at("means", c), F.lit(""))), ";"), F.lit(";")), F.lit(""))
    front = [cell(F.col(c)) for c in ("number", "team", "team_code", "project", "state", "pages", "words")]
    gap = round_up_half(F.col("final") - F.col("model_total"))
    back = [number(F.col("final")), F.coalesce("most", F.lit("")), number(F.col("model_total")), number(gap), *[cell(F.col(c)) for c in ("names", "scorers")], number(F.col("spread"))]
    back += [cell(F.col(c)) for c in ("notes", "findings", "sources", "similarity", "done_on")]
    line = F.concat(F.concat_ws(";", *front), F.lit(";"), own, F.concat_ws(";", *back))
    head = F.coalesce("head", F.lit(";".join(FRONT + BACK)))
    return r.select(F.col("category").alias("sheet"), head.alias("head"), F.col("report_id").alias("ord"), line.alias("line"))


def titled(sheets: DataFrame) -> DataFrame:
    """Sheets whose head begins with a line of their name (semicolons as commas) and number of rows, if there are several."""
    n = sheets.groupBy(F.col("sheet").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    several = n.agg((F.count(F.lit(1)) > 1).alias("_several"))
    title = F.concat(F.translate(F.coalesce("sheet", F.lit("")), ";", ","), F.lit(" — "), F.col("_n"), F.lit(" rapor\n"), F.col("head"))
    # `several` is the one row of a global aggregate, and `n` has one for each sheet.
    all_ = sheets.join(F.broadcast(n), F.col("sheet").eqNullSafe(F.col("_s"))).join(F.broadcast(several))
    return all_.withColumn("head", F.when(F.col("_several"), title).otherwise(F.col("head"))).drop("_s", "_n", "_several")
