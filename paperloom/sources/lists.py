"""Pasted lists, document formats and archives as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.text import repair

# Words that only a header holds, and what looks like an application number.
HEADER = "(?i)basvuru|takim|proje|eposta|e-posta|mail"
NUMBER = r"^[A-Za-z]{0,4}-?\d{2,}[-\d]*$"


def parse_list(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and rejects of a pasted list (row from 1, text).

    Cells are parted by tabs, else semicolons, else commas, and repaired one by one. A first cell that looks like an
    application number is one; lists without numbers begin with the team. Then come a team id (no blank, 16 characters at
    most) and a project; an e-mail address may stand anywhere. A header (the first line, with such words and no three
    digits in a row) and blank lines are passed over; lines without a team are rejected with the reason.
    """
    t = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    mark = F.when(F.contains(t, F.lit("\t")), "\t").when(F.contains(t, F.lit(";")), ";").otherwise(",")
    head = (F.col("row") == 1) & t.rlike(HEADER) & ~t.rlike(r"\d{3}")
    n = lines.where((t != "") & ~head).withColumn("_t", t)
    # A cell has no tab of its own left, so the whole line is repaired at once with its cells on lines of their own.
    cells = F.transform(F.split(F.col("_t"), mark), lambda x: F.regexp_replace(F.trim(x), r'^"|"$', ""))
    n = n.withColumn("_c", F.transform(F.split(repair(F.array_join(cells, "\n")), "\n"), lambda x: F.trim(x)))
    first = F.get("_c", F.lit(0))
    numbered = first.rlike(NUMBER)
    n = n.withColumn("_no", F.when(numbered, first)).withColumn("_k", F.when(numbered, F.slice("_c", 2, F.greatest(F.lit(1), F.size("_c")))).otherwise(F.col("_c")))
    at = lambda i: F.nullif(F.get("_k", F.lit(i)), F.lit(""))
    n = n.withColumns({"_team": at(0), "_third": at(1), "_fourth": at(2), "_mail": F.get(F.filter("_c", lambda x: F.contains(x, F.lit("@")) & F.contains(x, F.lit("."))), F.lit(0))})
    short = F.coalesce(~F.contains("_third", F.lit(" ")) & (F.length("_third") <= 16), F.lit(False))
    project = F.when(short, F.col("_fourth")).otherwise(F.col("_third"))
    rows = n.where(F.col("_team").isNotNull()).select(
        "row", F.col("_no").alias("application_no"), F.col("_team").alias("team"), F.when(short, F.col("_third")).alias("team_id"),
        F.nullif(project, F.coalesce("_mail", F.lit(""))).alias("project"), F.col("_mail").alias("email"),
    )
    reason = F.when(numbered & (F.size("_c") == 1), "no team").otherwise("unreadable team")
    return rows, n.where(F.col("_team").isNull()).select("row", F.col("_t").alias("text"), reason.alias("reason"))


def text_format(content: Column) -> Column:
    """pdf, docx (a zip archive) or unknown, by the first bytes."""
    start = F.hex(F.substring(content, 1, 4))
    return F.when(start == "25504446", "pdf").when(start == "504B0304", "docx").otherwise("unknown")


_PARAGRAPHS = "path string, ord int, style string, text string, bold double, in_table boolean, page int"


def docx_paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs of .docx files (path, content): style, text, share of bold characters, whether in a table, page.

    Files are parsed where they are read; a damaged file gives no rows.
    """

    def run(batches):
        import io
        import re
        import zipfile
        from html import unescape

        import pandas as pd

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode()
                except (zipfile.BadZipFile, KeyError, UnicodeDecodeError):
                    continue
                tables = [m.span() for m in re.finditer(r"<w:tbl>.*?</w:tbl>", xml, re.S)]
                page = 1
                for i, m in enumerate(re.finditer(r"<w:p[ >].*?</w:p>", xml, re.S)):
                    style = re.search(r'<w:pStyle w:val="([^"]*)"', m[0])
                    runs = [(r[0], "".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", r[0]))) for r in re.finditer(r"<w:r[ >].*?</w:r>", m[0], re.S)]
                    text = "".join(t for _, t in runs)
                    bold = sum(len(t) for r, t in runs if re.search(r"<w:b(?: w:val=\"(?:1|true)\")?/>", r))
                    rows.append((path, i, style[1] if style else None, unescape(text).strip(), bold / len(text) if text else 0.0, any(a <= m.start() < b for a, b in tables), page))
                    page += len(re.findall(r'<w:br w:type="page"/>|<w:lastRenderedPageBreak/>', m[0]))
            yield pd.DataFrame(rows, columns=["path", "ord", "style", "text", "bold", "in_table", "page"])

    return files.select("path", "content").mapInPandas(run, _PARAGRAPHS)


def json_directory(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a directory of JSON files; damaged ones are left out."""
    columns = [c.strip().split()[0] for c in schema.split(",")]
    raw = spark.read.schema(f"{schema}, _damaged string").option("multiLine", True).option("columnNameOfCorruptRecord", "_damaged").json(path)
    return raw.cache().where("_damaged is null").select(*columns)
