"""Category sheets as rows, and as files."""

import csv
import io
import os

import pytest
from pyspark.sql import functions as F

from paperloom.operators import export
from paperloom.sources import sheets

REPORTS = (
    "report_id long, category string, number string, team string, team_code string, project string, state string, pages int, words int, "
    "model_total double, findings string, sources string, similarity string, done_on date"
)
ROW = "sheet string, head string, ord long, line string"


def made(spark, reports, rubric, means=(), assignments=()):
    return export.category_sheets(
        spark.createDataFrame(reports, REPORTS),
        spark.createDataFrame(rubric, "category string, ord int, criterion string, name string, points double"),
        spark.createDataFrame(list(means), "report_id long, criterion string, mean double"),
        spark.createDataFrame(list(assignments), "report_id long, referee string, state string, total double, note string"),
    )


def report(i, category="A", **other):
    return {"report_id": i, "category": category, "number": f"TF-{i}", "team": "Ege", "team_code": "TKM-1", "project": "Robot", "state": "completed", "pages": 10, "words": 2000} | other


RUBRIC = [("A", 1, "ozet", "Proje Özeti", 20.0), ("A", 2, "yontem", "Yöntem", 30.0), ("B", 1, "x", 'Ad; "özel"', 12.5)]


def test_columns_follow_the_rubric_and_blanks_are_not_zero(spark):
    rows = made(spark, [report(1, model_total=34.5)], RUBRIC, [(1, "ozet", 18.0), (1, "other", 3.0)], [(1, "Ada", "completed", 40.0, "good"), (1, "Ece", "draft", 10.0, "wait"), (1, "Can", None, None, None)])
    (r,) = rows.collect()
    got = dict(zip(*csv.reader(io.StringIO(r["head"] + "\n" + r["line"]), delimiter=";"), strict=True))
    assert list(got)[7:10] == ["Proje Özeti (20)", "Yöntem (30)", "Nihai Puan"]
    assert (got["Proje Özeti (20)"], got["Yöntem (30)"], got["Nihai Puan"], got["Azami Puan"], got["Fark"]) == ("18", "", "40", "50", "5.5")
    assert (got["Hakem Puanları"], got["Hakem Sayısı"], got["Hakem Notları"]) == ("Ada: 40", "1/3", "Ada: good | Ece: wait")
    assert (got["Hakemler Arası Ayrışma"], got["Tamamlanma"], got["Benzerlik"]) == ("0", "", "")


def test_cells_with_semicolons_quotes_and_breaks(spark):
    rows = made(spark, [report(1, "B", project='say "so"; then', team=" a\r\nb "), report(2, "none"), report(3, None)], RUBRIC).orderBy("ord").collect()
    assert rows[0]["line"].startswith('TF-1;a b;TKM-1;"say ""so""; then";completed;10;2000;;;12.5;')
    assert '"Ad; ""özel"" (12.5)"' in rows[0]["head"]
    assert [r["head"] for r in rows[1:]] == [";".join(export.FRONT + export.BACK)] * 2


def test_titles_only_over_several_sheets(spark):
    one = made(spark, [report(1), report(2)], RUBRIC)
    assert [r["head"] for r in export.titled(one).collect()] == [r["head"] for r in one.collect()]
    two = export.titled(made(spark, [report(1), report(2), report(3, "B;C"), report(4, None)], RUBRIC))
    assert sorted({r["head"].split("\n")[0] for r in two.collect()}) == [" — 1 rapor", "A — 2 rapor", "B,C — 1 rapor"]


def files(path):
    return {f: open(f"{path}/{f}", encoding="utf-8", newline="").read() for f in sorted(os.listdir(path)) if f.endswith(".csv")}


def sheet_rows(spark, n, name="A"):
    return spark.range(n).select(F.lit(name).alias("sheet"), F.lit("k;v").alias("head"), F.col("id").alias("ord"), F.concat(F.col("id"), F.lit(";é")).alias("line")).repartition(5)


def test_files_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sheets.write_sheets(sheet_rows(spark, 500).unionByName(sheet_rows(spark, 3, "B/ç")), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = files(path)
    assert len(found) > 2 and sorted(os.listdir(path)) == list(found)
    assert all(t.startswith("﻿k;v\n") and t.count("k;v") == 1 and t.endswith("\n") for t in found.values())
    lines = [x for name, t in found.items() if name.startswith("A-") for x in t.splitlines()[1:]]
    assert lines == [f"{i};é" for i in range(500)]
    assert [t.splitlines()[1:] for name, t in found.items() if name.startswith("B%2F")] == [["0;é", "1;é", "2;é"]]


def test_overwrite_replaces_and_append_adds(spark, tmp_path):
    path = str(tmp_path / "out")
    sheets.write_sheets(sheet_rows(spark, 5), path)
    sheets.write_sheets(sheet_rows(spark, 2, "B"), path, "append")
    sheets.write_sheets(sheet_rows(spark, 2, "B"), path, "append")
    assert [n[0] for n in files(path)] == ["A", "B", "B"]
    sheets.write_sheets(sheet_rows(spark, 1, "C"), path)
    assert list(files(path).values()) == ["﻿k;v\n0;é\n"]
    sheets.write_sheets(sheet_rows(spark, 0), path)
    assert files(path) == {}


def test_a_failed_job_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    sheets.write_sheets(sheet_rows(spark, 5), path)
    before = files(path)
    bad = sheet_rows(spark, 50).withColumn("line", F.when(F.col("ord") == 40, F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no"):
        sheets.write_sheets(bad, path)
    assert files(path) == before and os.listdir(path) == list(before)


def test_missing_columns(spark, tmp_path):
    sheets.register(spark)
    with pytest.raises(Exception, match="head"):
        spark.range(1).selectExpr("'a' AS sheet", "'x' AS line").write.format("sheets").mode("append").option("path", str(tmp_path)).save()


def test_notes_stay_as_they_are(spark):
    (r,) = made(spark, [report(1)], RUBRIC, [], [(1, "Ada", "completed", 40.0, "as in 2.0"), (1, "Ece", "draft", 7.0, 'a;\nb "c"')]).collect()
    got = dict(zip(*csv.reader(io.StringIO(r["head"] + "\n" + r["line"]), delimiter=";"), strict=True))
    assert (got["Hakem Puanları"], got["Hakem Notları"]) == ("Ada: 40", 'Ada: as in 2.0 | Ece: a; b "c"')
