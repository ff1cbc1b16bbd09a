"""Images, cover fields, codes and leaks against plain versions and on rows made by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import images as I
from paperloom.functions import text as T
from paperloom.operators import catalog, intake


def plain_hash(gray):
    """The hash of rows of gray values by sums over single pixels."""
    h, w = len(gray), len(gray[0])
    span = lambda b, size: range(b * size // 32, max(b * size // 32 + 1, (b + 1) * size // 32))
    small = [[sum(gray[y][x] for y in span(i, h) for x in span(j, w)) / (len(span(i, h)) * len(span(j, w))) for j in range(32)] for i in range(32)]
    wave = lambda k, i: math.cos((2 * i + 1) * k * math.pi / 64)
    low = [sum(small[i][j] * wave(v, i) * wave(u, j) for i in range(32) for j in range(32)) for v in range(8) for u in range(8)][1:]
    middle = sorted(low)[31]
    return "".join("1" if x > middle else "0" for x in low) + "0"


@pytest.mark.parametrize("size", [(48, 48), (61, 50), (130, 97)])
def test_image_hash(size):
    w, h = size
    values = random.Random(w)
    gray = [[values.randrange(256) for _ in range(w)] for _ in range(h)]
    got = I.image_hash(bytes(v for row in gray for v in row), w, h, 1)
    assert format(got & (1 << 64) - 1, "064b") == plain_hash(gray)
    colours = [[(v, 255 - v, v // 2) for v in row] for row in gray]
    got = I.image_hash(bytes(c for row in colours for p in row for c in p), w, h, 3)
    assert format(got & (1 << 64) - 1, "064b") == plain_hash([[0.299 * r + 0.587 * g + 0.114 * b for r, g, b in row] for row in colours])


def test_descriptions(spark):
    clear = bytes([0, 0, 0, 0] * 4 + [10, 20, 31, 255] * 4)
    rows = [(1, 4, 2, 4, clear), (2, 47, 60, 1, bytes(range(47)) * 60), (3, 4, 4, 1, b"short"), (4, None, 2, 3, None), (5, 2, 1, 3, bytes([0, 0, 0, 1, 1, 1])), (5, 0, 0, 1, b"")]
    found = I.describe(spark.createDataFrame(rows, "image_id long, width int, height int, channels int, pixels binary"), (1, 2)).collect()
    assert sorted((r["image_id"], r["hash"] is None, r["thumb"] and bytes(r["thumb"]), r["says_something"]) for r in found[:3]) == [
        (1, True, bytes([255, 255, 255, 10, 20, 31]), True),
        (2, True, bytes([23] * 6), False),
        (3, True, None, None),
    ]
    # Both pixels of a row count in its box; halves go up. Missing pixels give nulls.
    assert [(r["image_id"], r["thumb"] and bytes(r["thumb"])) for r in found[3:]] == [(4, None), (5, bytes([1] * 6)), (5, None)]


def test_hashes_are_those_of_descriptions_without_thumbnails(spark):
    rows = [(n, 48 + n % 3, 50, 1, bytes((n * x * x + x) % 251 for x in range((48 + n % 3) * 50))) for n in range(6)] + [(7, 4, 2, 1, b"short"), (8, None, 2, 3, None)]
    pixels = spark.createDataFrame(rows, "image_id long, width int, height int, channels int, pixels binary")
    found = I.hashes(pixels)
    assert found.columns == ["image_id", "hash"]
    assert {tuple(r) for r in found.collect()} == {(r["image_id"], r["hash"]) for r in I.describe(pixels, (2, 2)).collect()}


def test_cover_fields(spark):
    lines = [
        (1, 1, 1, "Takım Adı:", False), (1, 2, 1, "Proje Adı:", False), (1, 3, 1, "Uçan  Araba", None), (1, 4, 1, "TAKIM ISMI: Göktürk", False),
        (1, 5, 1, "Seviye: Lise", True), (1, 6, 2, "Başvuru ID: {no}", False), (1, 7, 3, "Başvuru Kodu: AB12", False), (1, 8, 4, "Seviye: Lise", False),
        (2, 1, 1, None, False), (2, 2, 1, ": no label", False), (2, 3, 1, "Seviye: " + "x" * 91, False), (3, 1, 9, "Seviye: Lise", False),
    ]
    found = intake.cover_fields(spark.createDataFrame(lines, "doc_id long, ord int, page int, line string, repeated boolean"))
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == [(1, "Göktürk", None, "AB12", "Uçan Araba", None), (2, None, None, None, None, None)]
    assert intake.cover_fields(spark.createDataFrame([], "doc_id long, ord int, page int, line string, repeated boolean")).count() == 0


def test_category_names(spark):
    known = {
        "2025 TEKNOFEST Roket Yarışması A4 - Uluslararası Kategori": "A4 - Uluslararası",
        "Şartnamesi - Tanımlı Problem Kategorisi": "Tanımlı Problem",
        "2- Performans KATEGORİSİ": "Performans",
        "/ Katılım Bankacılığı Kategorisi": "Katılım Bankacılığı",
        "A2-A3 Kategorisi": "A2-A3",
        "Tüm Kategoriler Şartnamesi": None,
        "Yarışma Şartnamesi": None,
        "Kategori": None,
        "12 Kategorisi": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in known], "label string")
    assert [r[0] for r in df.select(catalog.category_name(F.col("label"))).collect()] == list(known.values())


def test_leaks(spark):
    secret, plain = "the model thought this was very weak", "a remark that the referee has approved"
    page = spark.createDataFrame([(1, f"TOTAL. {secret}. {plain}."), (2, "nothing of that"), (3, None)], "group_id long, page string")
    texts = [(1, f" {secret} "), (1, secret), (1, plain), (1, "TOTAL"), (2, secret), (3, secret), (None, secret), (1, None)]
    texts = spark.createDataFrame(texts, "group_id long, text string")
    approved = spark.createDataFrame([(1, plain + " "), (2, secret)], "group_id long, text string")
    assert [tuple(r) for r in intake.leaks(page, texts, approved).collect()] == [(1, secret)]


def test_new_numbers(spark):
    asked = spark.createDataFrame([(i, 2024) for i in range(9)] + [(50, 2025), (60, None)], "id long, year int")
    taken = spark.createDataFrame([("TF-2024-0",), ("TF-2024-7",), ("TF-2025-1",), (None,)], "number string")
    found = {r["id"]: r["number"] for r in intake.new_numbers(asked, taken, digits=1).collect()}
    given = [n for n in found.values() if n]
    assert len(found) == 11 and len(set(given)) == len(given) == 9 and not {"TF-2024-0", "TF-2024-7", "TF-2025-1"} & set(given)
    assert found[8] is None and found[60] is None and found[50].startswith("TF-2025-")


def test_new_codes(spark):
    asked = spark.range(500)
    first = intake.new_codes(asked)
    assert [tuple(r) for r in first.orderBy("id").collect()] == [tuple(r) for r in intake.new_codes(asked.repartition(7)).orderBy("id").collect()]
    codes = [r["code"] for r in first.collect()]
    assert len(set(codes)) == 500 and all(len(c) == 9 and c[4] == "-" and set(c) <= set(intake.CODE_LETTERS + "-") for c in codes)
    spelled = first.select(F.lower(F.replace("code", F.lit("-"), F.lit(" "))).alias("code"))
    again = intake.new_codes(asked, spelled)
    assert again.join(spelled, T.access_code(again.code) == T.access_code(spelled.code)).count() == 0 and again.where("code IS NULL").count() == 0
    assert intake.new_codes(asked, spelled, attempts=1).where("code IS NOT NULL").count() == 0
