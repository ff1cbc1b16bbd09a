"""Lines, furniture, headings and sections from positioned items."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import structure

SCHEMA = "doc_id long, page int, item long, x double, y double, width double, size double, font string, text string, other string"


def frame(spark, rows, seed=0):
    rows = [(*r, "x") for r in rows]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def page(doc, no, texts, size=10.0, font="Serif", top=700.0):
    return [(doc, no, k, 50.0, top - 20 * k, 100.0, size, font, t) for k, t in enumerate(texts)]


def found(spark, rows):
    return [(r["page"], r["line"], r["text"]) for r in structure.lines(frame(spark, rows)).orderBy("doc_id", "page", "line").collect()]


def test_distance_counts_from_the_first_item_of_the_line(spark):
    # 100, 97, 94: the third is within reach of the second, not of the first.
    rows = [(1, 1, 0, 10.0, 100.0, 8.0, 8.0, "f", "a"), (1, 1, 1, 30.0, 97.0, 8.0, 8.0, "f", "b"), (1, 1, 2, 50.0, 94.0, 8.0, 8.0, "f", "c")]
    assert found(spark, rows) == [(1, 1, "a b"), (1, 2, "c")]


def test_tolerance_is_two_at_least_and_half_of_the_items_size(spark):
    rows = [(1, 1, 0, 0.0, 100.0, 5.0, 2.0, "f", "a"), (1, 1, 1, 9.0, 98.0, 5.0, 2.0, "f", "b"), (1, 1, 2, 20.0, 95.0, 5.0, 10.0, "f", "c"), (1, 1, 3, 30.0, 94.9, 5.0, 10.0, "f", "d")]
    assert found(spark, rows) == [(1, 1, "a b c"), (1, 2, "d")]


def test_blank_only_over_a_gap_and_items_from_left_to_right(spark):
    rows = [(1, 1, 0, 30.0, 100.0, 10.0, 10.0, "f", "c"), (1, 1, 1, 0.0, 100.0, 10.0, 10.0, "f", "a"), (1, 1, 2, 11.5, 100.0, 10.0, 10.0, "f", "b")]
    assert found(spark, rows) == [(1, 1, "ab c")]
    assert found(spark, [(1, 1, 0, 0.0, 9.0, 1.0, 10.0, "f", ""), (1, 1, 1, 50.0, 9.0, 1.0, 10.0, "f", "b")]) == [(1, 1, "b")]


def test_ties_nulls_and_blank_lines(spark):
    rows = [(1, 1, 1, 5.0, 9.0, 1.0, 10.0, "f", "second"), (1, 1, 0, 5.0, 9.0, 1.0, 10.0, None, "first"), (1, 2, 0, 5.0, 9.0, 1.0, 10.0, "f", "  "), (1, 2, 1, 5.0, -20.0, None, 10.0, "f", None)]
    rows += [(1, 3, 0, None, 9.0, 1.0, 10.0, "f", "lost"), (None, 3, 0, 1.0, 9.0, 1.0, 10.0, "f", "lost"), (2, 1, 0, 1.0, 9.0, 1.0, 10.0, "Semibold", "kept")]
    assert found(spark, rows) == [(1, 1, "firstsecond"), (1, 1, "kept")]
    assert structure.lines(frame(spark, rows)).where("bold").select("text").collect() == [("kept",)]


def plain_lines(items):
    """Numbers of lines of one page's items (x, y, size)."""
    groups = []
    for i in sorted(range(len(items)), key=lambda i: (-items[i][1], items[i][0], i)):
        if groups and abs(items[groups[-1][0]][1] - items[i][1]) <= max(2, items[i][2] * 0.5):
            groups[-1].append(i)
        else:
            groups.append([i])
    return [sorted(g) for g in groups]


def test_many_pages_against_a_plain_scan(spark):
    rng = random.Random(4)
    pages = {(d, p): [(rng.randrange(40) * 10.0, rng.randrange(120) / 2, rng.choice([3.0, 8.0, 14.0])) for _ in range(60)] for d in range(12) for p in range(1, 5)}
    rows = [(d, p, k, x, y, 5.0, s, "f", f"w{k}") for (d, p), at in pages.items() for k, (x, y, s) in enumerate(at)]
    got = structure.lines(frame(spark, rows)).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l")).collect()
    assert len(got) == len(pages)
    for r in got:
        have = [sorted(int(w) for w in line["text"].replace("w", " ").split()) for line in r["l"]]
        assert have == plain_lines(pages[r["doc_id"], r["page"]])


def report(doc=1, pages=4):
    out = []
    for p in range(1, pages + 1):
        out += [(doc, p, 90, 50.0, 760.0, 99.0, 9.0, "Serif", f"Team Alpha | Page {p}")]
        out += page(doc, p, [f"body text of page number {p} and line {k} that goes on." for k in range(12)])
    return out


def test_furniture_is_masked_and_needs_three_pages(spark):
    def repeated(rows):
        f = frame(spark, rows)
        of = structure.furniture(structure.lines(f), f.groupBy("doc_id").agg(F.max("page").alias("pages")))
        return sorted(r["text"] for r in of.where("repeated").collect())

    assert repeated([r for r in report() if "body" not in r[8] or "line 5" in r[8] or "line 9" in r[8]]) != []
    assert [t for t in repeated(report()) if t.startswith("Team")] == [f"Team Alpha | Page {p}" for p in range(1, 5)]
    assert repeated(report(pages=2)) == []


@pytest.mark.parametrize(
    ("text", "size", "bold", "heading"),
    [
        ("1. Introduction", 10.0, False, True), ("2.1. Method and data", 10.0, False, True), ("RESULTS", 12.0, False, True), ("RESULTS", 10.0, True, True),
        ("RESULTS", 10.0, False, False), ("Results", 14.0, True, False), ("1. " + "long " * 20, 10.0, False, False), ("1. " + "long " * 20, 12.0, False, True),
        ("3. Contents ........ 7", 14.0, True, False), ("10.04.2026 Done", 14.0, True, False), ("ENDS WITH A STOP.", 14.0, True, False), ("IX", 14.0, True, False),
        ("İÇERİK ÖZETİ", 14.0, True, True), ("A" * 71, 14.0, True, False), ("1. " + "A" * 118, 14.0, True, False),
    ],
)
def test_is_heading(spark, text, size, bold, heading):
    h = T.heading_number(F.col("t"))
    row = spark.createDataFrame([(text.strip(), size, bold)], "t string, s double, b boolean")
    assert row.select(structure.is_heading(F.col("t"), h["number"], h["title"], F.col("s"), F.col("b"), F.lit(10.0))).first()[0] is heading


def test_sections(spark):
    rows = page(1, 1, ["before", "1. Aim", "one two", "three"]) + page(1, 2, ["four", "1.1 Deeper", "2. Way"]) + page(2, 1, ["no heading at all, only text"])
    got = structure.sections(frame(spark, rows)).orderBy("section").collect()
    assert [(r["doc_id"], r["section"], r["number"], r["title"], r["level"], r["page"], r["body"], r["n_words"]) for r in got] == [
        (1, 1, "1", "Aim", 1, 1, "one two\nthree\nfour", 4), (1, 2, "1.1", "Deeper", 2, 2, "", 0), (1, 3, "2", "Way", 1, 2, "", 0),
    ]


def test_body_size_is_that_of_most_characters_and_the_first_on_a_tie(spark):
    of = spark.createDataFrame([(1, 1, 1, "abc", 12.2), (1, 1, 2, "ab", 9.0), (1, 2, 1, "d", 9.1), (2, 1, 1, "abcd", 9.0), (2, 1, 2, "a", 12.0)], "doc_id long, page int, line int, text string, size double")
    assert dict(map(tuple, structure.body_sizes(of).collect())) == {1: 12.0, 2: 9.0}


def test_no_items(spark):
    assert structure.sections(spark.createDataFrame([], SCHEMA)).collect() == []


def packed(spark, rows):
    names = ["item", "x", "y", "width", "size", "font", "text"]
    return frame(spark, rows).groupBy("doc_id", "page").agg(F.collect_list(F.struct(*names)).alias("items"))


def test_rows_of_pages_give_the_lines_of_their_items(spark):
    rng = random.Random(6)
    rows = [(d, p, k, rng.choice([None, *range(90)]), rng.randrange(60) / 2, rng.choice([None, 5.0]), rng.choice([3.0, 9.0]), rng.choice(["f", None, "a BOLD one"]), rng.choice(["", None, " ", "\u00a0", "w", "ö"])) for d in (1, 2, None) for p in range(1, 9) for k in range(50)]
    rows = [(d, p, k, x if x is None else float(x), *r) for d, p, k, x, *r in rows] + report(7)
    want, got = structure.lines(frame(spark, rows)).collect(), structure.lines(packed(spark, rows)).collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert structure.last_pages(packed(spark, rows)).where("doc_id = 7").collect() == [(7, 4)]


def test_a_line_goes_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    rows = [(1, 1, k, float(k), 9.0 if k < 12000 else 1.0, 1.0, 8.0, "f", "w") for k in range(12010)] + [(2, 1, 0, 1.0, 9.0, 1.0, 8.0, "f", "x")]
    got = structure.lines(frame(spark, rows)).orderBy("doc_id", "line").collect()
    assert [(r["doc_id"], r["line"], len(r["text"])) for r in got] == [(1, 1, 12000), (1, 2, 10), (2, 1, 1)]


def test_words_never_travel_alone_and_lines_travel_once(spark):
    from paperloom.plans.structure_queries import items

    docs = spark.createDataFrame([(1, "s", "some words of a text"), (2, None, "")], "doc_id long, source string, text string")
    plan = structure.sections(items(docs))._jdf.queryExecution().executedPlan().toString()
    # The lines by document, and the number of pages of each document.
    assert plan.count("Exchange hashpartitioning") <= 2


def test_batches_of_signatures_and_images_are_bounded(spark):
    from paperloom.functions import hashing, images

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, key string")
    pixels = spark.createDataFrame([], "image_id long, width int, height int, channels int, pixels binary")
    for made in (lambda: hashing.sign(docs, "key", 4), lambda: images.describe(pixels, (2, 2))):
        spark.conf.unset(key)
        made()
        assert int(spark.conf.get(key)) <= 4 << 20


def test_pages_are_laid_out_as_counted(spark):
    from paperloom.plans import structure_queries as Q

    words = [f"w{i:03}{'x' * (i % 3)}" for i in range(301)]
    docs = spark.createDataFrame([(7, "src", " ".join(words)), (8, None, "şekil bir"), (9, "a", "x"), (10, "b", " ".join(words[:300]))], "doc_id long, source string, text string")
    pages = {(r.doc_id, r.page): r["items"] for r in Q.items(docs).collect()}
    assert {k: len(v) for k, v in pages.items()} == {(7, 1): 301, (7, 2): 2, (8, 1): 3, (10, 1): 301}
    assert {(r.doc_id, r.pages) for r in Q.last_pages(docs).collect()} == {(7, 2), (8, 1), (10, 1)}
    assert [tuple(x) for x in pages[8, 1]] == [
        (-1, 40.0, 780.0, 200.0, 9.0, "Serif", "Report of - | 1"), (0, 40.0, 701.0, 30.0, 14.0, "Serif-Bold", "1. şekil"), (1, 80.0, 703.0, 30.0, 14.0, "Serif-Bold", "bir"),
    ]
    assert tuple(pages[7, 2][1]) == (300, 40.0, 700.0, 30.0, 11.0, "Serif", "w300") and tuple(pages[7, 1][109])[-2:] == ("Serif-Bold", "2. w108")
    # Only the words are read for the number of pages.
    assert "MapInArrow" not in Q.last_pages(docs)._jdf.queryExecution().optimizedPlan().toString()
