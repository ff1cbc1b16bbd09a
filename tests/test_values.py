"""Known values of functions, and operators that no query reaches, on rows made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import hashing as H
from paperloom.functions import numbers as N
from paperloom.functions import text as T
from paperloom.operators import audit, catalog, checks, desk, review, similarity
from paperloom.session import materialize
from paperloom.sources import lists


@pytest.fixture(scope="module")
def value(spark):
    """The value of a column expression over one row with the given text."""

    def of(expression, text=""):
        return spark.createDataFrame([(text,)], "t string").select(expression.alias("v")).first()["v"]

    return of


def test_hashes(value):
    t = F.col("t")
    known = {"": 2166136261, "a": 0xE40C292C, "b": 0xE70C2DE5, "foobar": 0xBF9CF968}
    assert [value(H.fnv1a(t), k) for k in known] == list(known.values())
    assert sorted(known[k] for k in ("a", "b")) == sorted(H.run_hashes("a b", 1).tolist()) and H.run_hashes("one two", 4).tolist() == []
    runs = ("foobar foobar foobar foobar", "foobar foobar foobar x")
    assert set(H.run_hashes("foobar foobar foobar foobar x", 4).tolist()) == {value(H.fnv1a(t), r) for r in runs}
    assert (H.signature(H.run_hashes("", 4)) == H.EMPTY_SLOT).all() and len(set(H.signature(H.run_hashes("a b c d e f", 2)).tolist())) > 64


def test_numbers(value):
    t = F.col("t")
    assert str(value(N.range_end(t), "2026-02-16 → 2026-03-01")) == "2026-03-01" and value(N.range_end(t), "soon") is None
    assert value(N.shown_date(F.lit("2026-03-01").cast("date"))) == "01.03.2026"
    assert (value(N.year_of(t, F.lit(7)), "season 2025/2026"), value(N.year_of(t, F.lit(7)), "1999")) == (2025, 7)
    assert value(N.token_cost(F.lit(1_000_000), F.lit(500_000), F.lit(100_000), (3.0, 0.3, 15.0))) == pytest.approx(4.65)
    assert [value(N.round_up_half(F.lit(x))) for x in (69.95, 69.94, -0.05)] == [70.0, 69.9, 0.0]


def test_text(value):
    t = F.col("t")
    assert [value(T.heading_level(t), x) for x in ("1", "1.2", "1.2.3.")] == [1, 2, 3]
    assert value(T.phrase_count(t, F.lit("su yolu")), "su yolu su yolu suyolu su yolu") == 3
    assert value(T.author_citations(t), "(Akyon ve ark., 2022) Kaya (2019) (see 2020)") == ["Akyon 2022", "Kaya 2019"]
    assert (value(T.email(t), " A@b.Org "), value(T.email(t), "a@b")) == ("a@b.org", None)
    assert value(T.access_code(t), "ab-12 c") == "AB12C"
    assert value(T.key(t), "état şehir Å 가") == value(T.key(t, normal=True), "état şehir Å 가")
    e = value(T.reference_entry(t), "Kaya, A. Bir baslik, 2021. https://x.org")
    assert (e.year, e.surname, e.link, e.doi, e.bare_link) == (2021, "Kaya", True, False, False)


@pytest.mark.parametrize(
    ("line", "title", "author", "doi"),
    [
        ("F. C. Akyon, S. O. Altinuc, “Slicing aided hyper inference,” ICIP, 2022.", "Slicing aided hyper inference", "Akyon", None),
        ("Kaya, A., Uzun bir makale basligi burada durur, Dergi, 2020, 10.1000/abc.12.", "Uzun bir makale basligi burada durur", "Kaya", "10.1000/abc.12"),
        ("OpenCV Team, 2021", None, "OpenCV Team", None),
    ],
)
def test_source_fields(value, line, title, author, doi):
    s = value(T.source_fields(F.col("t")), line)
    assert (s.title, s.author, s.doi) == (title, author, doi)


def test_aliases_beyond_one_round(spark):
    rows = [(1, i, i) for i in range(50)] + [(2, 7, 1)]
    got = {(r.report_id, r.referee_id): r.alias for r in review.referee_alias(spark.createDataFrame(rows, "report_id long, referee_id long, assigned long")).collect()}
    assert [got[1, i] for i in (0, 13, 14, 20, 21, 22, 44)] == ["A", "O", "P", "Y", "Z", "A2", "A3"] and got[2, 7] == "A"


def plain_assignment(targets, referees, existing, k):
    load, have, out = dict(referees), {}, []
    for t, r in existing:
        have.setdefault(t, set()).add(r)
    names = list(load)
    for t in targets:
        free = sorted((r for r in names if r not in have.get(t, ())), key=lambda r: (load[r], names.index(r)))[: min(max(k, 1), len(names))]
        for r in free:
            load[r] += 1
        out += [(t, r) for r in free] or [(t, None)]
    return out


@pytest.mark.parametrize("k", [0, 1, 2, 9])
def test_assignment_with_loads(spark, k):
    referees, existing = [(5, 4), (3, 0), (8, 1), (1, 0)], [(10, 3), (11, 5), (11, 3), (11, 8), (11, 1)]
    t = spark.createDataFrame([(i, 1, i) for i in range(10, 18)] + [(99, 2, 0)], "report_id long, competition_id long, ord long")
    r = spark.createDataFrame([(1, n, i, load) for i, (n, load) in enumerate(referees)] + [(2, 70, 0, 0)], "competition_id long, referee_id long, ord long, load long")
    e = spark.createDataFrame(existing, "report_id long, referee_id long")
    got = sorted(map(tuple, review.assign(t, r, e, k).collect()), key=str)
    assert got == sorted([*plain_assignment(range(10, 18), referees, existing, k), (99, 70)], key=str)


def test_sentences_and_images_in_pairs(spark):
    words = lambda x: F.array(*[F.lit(w).cast("long") for w in x])
    s = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("doc_id"), F.lit(o).alias("ord"), words(w).alias("s")) for d, o, w in ((1, 0, [1, 2, 3, 4]), (2, 5, [1, 2, 3, 9]), (2, 6, [7, 8]), (3, 0, [1, 2, 3, 4]))])).alias("x")).select("x.*")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    assert [(r.a, r.b, r.ord_a, r.ord_b, r.jaccard) for r in similarity.sentence_matches(s, pairs).collect()] == [(1, 2, 0, 5, 0.6)]
    h = 0x0F0F0F0F0F0F0F0F
    images = spark.createDataFrame([(1, h), (2, h), (3, h ^ 0b111111), (4, h ^ 0b1111111), (5, 0)], "image_id long, hash long")
    assert {tuple(r) for r in similarity.image_matches(images).collect()} == {(1, 2, 0), (1, 3, 6), (3, 4, 1)}


def test_thresholds_count_copies(spark):
    p = [(f"c{i % 2}", i, "a b c d e f g h" if i < 6 else f"x{i} y{i} z{i} w{i} v{i}") for i in range(14)]
    prints = similarity.fingerprints(spark.createDataFrame([(d, c, k) for c, d, k in p], "doc_id long, category string, key string"))
    pairs = similarity.signature_pairs(prints)
    own = {r.category: (r.a, r.b, r.n_pairs, r.coverage) for r in pairs.where("a = b").collect()}
    assert own == {"c0": (0, 0, 3, 1.0), "c1": (1, 1, 3, 1.0)}
    t = similarity.thresholds(pairs, prints.groupBy("category").agg(F.count(F.lit(1)).alias("n"))).collect()
    assert all(r.n_pairs == 21 and r["median"] == 0.0 and r.threshold == 0.22 for r in t)


def test_unsteady_characters_are_all_that_are_not_steady():
    import re

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    steady = set(re.findall(f"[{T.STEADY}]", every))
    assert steady.isdisjoint(re.findall(f"[{T.UNSTEADY}]", every)) and len(steady) + len(re.findall(f"[{T.UNSTEADY}]", every)) == len(every)


def test_runs_of_many_keys_are_hashed_together():
    keys = ["a b c d", None, "", "one two three", "foobar foobar foobar foobar x", "w" * 300 + " a b c d e"]
    together = H.batch_run_hashes(keys, 4)
    assert [x.tolist() for x in together] == [H.run_hashes(k or "", 4).tolist() for k in keys]
    assert [len(x) for x in together] == [1, 0, 0, 0, 2, 3]


@pytest.fixture
def signed(spark):
    """Fingerprints of a category with many equal values and of one with few, with copies and equal scores, and all pairs by brute force."""
    rng, rows = np.random.default_rng(7), []
    for d in range(150):
        values = rng.integers(0, 4 if d % 3 else 4000, H.SLOTS).tolist() if d % 10 else [5] * H.SLOTS
        rows.append((d * 7 % 151, "many" if d % 3 else "few", int(rng.integers(1, 60)) if d % 10 else 9, values))
    rows.append((900, None, 3, [1] * H.SLOTS))
    prints = spark.createDataFrame(rows, "doc_id long, category string, n_shingles int, signature array<int>")
    classes = {}
    for d, c, n, v in sorted(rows[:-1]):
        classes.setdefault((c, tuple(v)), []).append((d, n))
    want = {}
    for (c, v), x in classes.items():
        for (k, w), y in classes.items():
            agree = sum(p == q for p, q in zip(v, w, strict=True))
            (a, na), (b, nb) = x[0], y[0]
            if c == k and agree and (a < b or v == w and len(x) > 1):
                j = agree / H.SLOTS
                n = len(x) * (len(x) - 1) // 2 if a == b else len(x) * len(y)
                want[c, a, b] = (agree, j, min(1.0, j * (na + nb) / (1 + j) / min(na, nb)), n)
    return prints, want


@pytest.mark.parametrize("block", [20, 1 << 15])
def test_blocks_of_classes_find_all_pairs(signed, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    prints, want = signed
    for at_least in (1, 16):
        got = similarity.signature_pairs(prints, at_least).collect()
        assert len(got) == len({(r.category, r.a, r.b) for r in got})
        assert {(r.category, r.a, r.b): (r.agree, r.jaccard, r.coverage, r.n_pairs) for r in got} == {k: v for k, v in want.items() if v[0] >= at_least}


def test_pairs_in_hand_are_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, (40, H.SLOTS)).astype(np.int32), rng.integers(0, 3, (30, H.SLOTS)).astype(np.int32)
    whole = [np.concatenate(c).tolist() for c in zip(*similarity._agreeing(x, y, 1), strict=True)]
    monkeypatch.setattr(similarity, "IN_HAND", 5000)
    parts = list(similarity._agreeing(x, y, 1))
    assert len(parts) > 10 and [np.concatenate(c).tolist() for c in zip(*parts, strict=True)] == whole


@pytest.mark.parametrize("block", [20, 1 << 15])
def test_nearest_of_blocks(signed, monkeypatch, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    prints, want = signed
    near = {}
    for (_, a, b), (_, j, cover, _) in want.items():
        if a != b:
            near.setdefault(a, []).append((-max(j, cover), b))
            near.setdefault(b, []).append((-max(j, cover), a))
    pairs = similarity.signature_pairs(prints, best=5)
    assert pairs.count() < sum(a != b for _, a, b in want)
    got = {(r.doc_id, r.place): (-r.score, r.other) for r in similarity.nearest(pairs, 5).collect()}
    assert got == {(d, k + 1): x for d, of in near.items() for k, x in enumerate(sorted(of)[:5])}


def test_limits_need_pairs_only_in_doubt(spark, signed):
    prints, want = signed
    sizes = prints.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    exact = {r.category: r.threshold for r in similarity.thresholds(similarity.signature_pairs(prints), sizes).collect() if r.category}
    limits = similarity.limits(prints)
    assert {r.category: r.threshold for r in limits.collect()} == exact and exact["few"] == 0.22 < exact["many"]
    got = {(r.category, r.a, r.b) for r in similarity.signature_pairs(prints, least=limits).collect()}
    assert got == {k for k, v in want.items() if v[2] >= exact[k[0]]} and len(got) < len(want)


def test_document_structure(spark):
    lines = spark.createDataFrame([(1, i, p, x, s, h) for i, (p, x, s, h) in enumerate([(1, "Rapor 1", 10.1, False), (1, "1. Giris", 14.0, True), (1, "metin metin", 11.9, False), (2, "Rapor 2", 10.1, False), (2, "metin metin metin", 12.0, False), (3, "Rapor 3", 10.1, False)])], "doc_id long, ord int, page int, line string, size double, is_heading boolean")
    assert [(r.doc_id, r["mask"]) for r in checks.edge_lines(lines).collect()] == [(1, "Rapor #")]
    assert checks.body_size(lines).first()["size"] == 12.0
    s = {r.section: (r.title, r.body) for r in checks.sections(lines).collect()}
    assert s == {0: (None, "Rapor 1"), 1: ("1. Giris", "metin metin\nRapor 2\nmetin metin metin\nRapor 3")}
    expected = spark.createDataFrame([(1, 0, "proje ozeti", "1"), (1, 1, "kaynakca", "2")], "doc_id long, ord int, key string, number string")
    found = spark.createDataFrame([(1, 0, "proje ozet", "9", 5), (1, 1, "proje ozeti", "8", 4), (1, 2, "kaynaklar", "2", 1)], "doc_id long, section int, key string, number string, words int")
    assert {(r.ord, r.section) for r in checks.match_headings(expected, found).collect()} == {(0, 1), (1, 2)}


def test_bibliography(spark):
    rows = [(1, 0, "[1] Kaya A. Bir baslik, 2021.", "text [1] and [3]"), (1, 1, "[2] Demir B. Baska bir baslik, 2020.", "text [1] and [3]"), (1, 2, "devami satiri", "text [1] and [3]")]
    b = checks.bibliography(spark.createDataFrame(rows, "doc_id long, ord int, line string, body string"), "body")
    r = b.first()
    assert (r.n_entries, r.unlisted, r.uncited) == (2, [3], [2])
    f = checks.bibliography_findings(b)
    assert {x.code for x in f.collect()} == {"BIBLIOGRAPHY_SHORT", "CITED_NOT_LISTED", "LISTED_NOT_CITED"}
    assert [(x.status, x.n_findings) for x in checks.worst(f).collect()] == [("error", 3)]


def test_audits(spark):
    scores = spark.createDataFrame([(1, "A", 5.0), (1, "B", 30.0), (1, "X", 1.0), (2, "A", 5.0), (2, "B", 6.0)], "report_id long, criterion string, score double")
    rubric = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "criterion string, points double")
    totals = spark.createDataFrame([(1, 36.0), (2, 12.0)], "report_id long, total double")
    assert {tuple(r) for r in audit.score_integrity(scores, rubric, totals).collect()} == {(1, 1, 1, 0, False), (2, 0, 0, 0, True)}
    stored = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "id long, v double")
    computed = spark.createDataFrame([(1, 1.01), (2, 2.2), (3, 4.0)], "id long, v double")
    assert {r.id for r in audit.drift(stored, computed, "id", "v").collect()} == {2, 3}


def test_visibility_and_specs(spark):
    m = spark.createDataFrame([(1, "all", None), (2, "own", 7), (3, "own", 8), (4, "board", None)], "id long, channel string, referee_id long")
    seen = lambda board: {r.id for r in review.visible(m, F.lit(board), F.lit(7)).collect()}
    assert seen(False) == {1, 2} and seen(True) == {1, 2, 4}
    rows = spark.createDataFrame([("a", "b", 1, 1), ("a", "b", 2, 2), ("a", "c", 3, 0)], "k string, g string, id long, v int")
    assert {tuple(r) for r in catalog.latest_version(rows, "g", "v").collect()} == {("a", "b", 2, 2), ("a", "c", 3, 0)}


def test_collated_names_keep_turkish_order(spark):
    names = ["çay", "cam", "dağ", "ışık", "iğne", "Zil", "şeker", "su"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(F.expr("collate(n, 'tr')")).collect()] == ["cam", "çay", "dağ", "ışık", "iğne", "su", "şeker", "Zil"]


def test_list_with_rejects(spark):
    rows = [(1, "Takım;Proje takim"), (2, "  "), (3, "04871"), (4, "Takim A, a@b.org"), (5, "TF-12\tÅŸeker\tT1\ta@b.c")]
    good, bad = lists.parse_list(spark.createDataFrame(rows, "row int, text string"))
    assert {tuple(r) for r in good.collect()} == {(4, None, "Takim A", "a@b.org", None, "a@b.org"), (5, "TF-12", "şeker", "T1", None, "a@b.c")}
    assert {tuple(r) for r in bad.collect()} == {(3, "04871", "no team")}


def test_desk_ties(spark):
    g = spark.createDataFrame([(1, 5, 0, None), (2, 5, 2, "1999-12-31"), (3, 5, 2, "2000-01-02"), (4, 5, 3, "2000-01-02")], "group_id long, applications long, missing long, deadline string")
    board = desk.deadline_board(g.withColumn("deadline", F.col("deadline").cast("date")), F.lit("2000-01-01").cast("date")).collect()
    assert [r.group_id for r in board] == [4, 3, 2, 1]


def test_long_titles_and_labels_are_whole(spark):
    long = "word " * 400
    html = f"<h1>{long}</h1><a href=\"/x\">{long}</a><a href=\"/y\">short</a>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert pages.select(catalog.title(F.col("html"), F.lit("some-slug"))).first()[0] == long.strip()
    assert pages.select(catalog.title(F.col("html"), F.lit("some-slug"), longest=900)).first()[0] == "Some Slug"
    assert {(r.href, r.label) for r in catalog.links(pages).collect()} == {("/x", long.strip()), ("/y", "short")}
    assert {r.href for r in catalog.links(pages, longest=500).collect()} == {"/y"}


def test_all_placeholders_are_found(spark):
    text = " ".join(f"[fill in {chr(97 + i)}]" for i in range(26))
    row = spark.createDataFrame([(text,)], "t string").select(T.placeholders(F.col("t")), T.placeholders(F.col("t"), 21)).first()
    assert len(row[0]) == 26 and len(row[1]) == 21


def test_repair_of_every_kind_of_damage(spark):
    cases = {"Ã–ÄŸrenci": "Öğrenci", "Ýstanbul": "İstanbul", "o\ufb03ce \u201cx\u201d": 'office "x"', "su\u0308re": "süre", "g\u02d8u": "ğu", "e\u0301a": "éa", "a\u200bb": "a b", "a \t b": "a b"}
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    got = [tuple(r) for r in df.select("t", T.repair(F.col("t")), T.key(F.col("t"))).collect()]
    assert {r[0]: r[1] for r in got} == cases | {None: None}
    assert {r[0]: r[2] for r in got} == {"Ã–ÄŸrenci": "ogrenci", "Ýstanbul": "istanbul", "o\ufb03ce \u201cx\u201d": "office x", "su\u0308re": "sure", "g\u02d8u": "gu", "e\u0301a": "a", "a\u200bb": "a b", "a \t b": "a b", None: None}


def test_parts_of_hashes_leave_no_pair_out_and_grow_with_their_number():
    import random

    from paperloom.operators.similarity import IMAGE_BITS, block_masks

    draw, sizes = random.Random(4), []
    for n in (0, 10, 3000, 300_000, 30_000_000):
        masks = block_masks(n)
        assert all(-(1 << 63) <= m < 1 << 63 for m in masks) and len(masks) < 300
        for _ in range(2000):
            changed = sum(1 << b for b in draw.sample(range(64), IMAGE_BITS))
            assert any(changed & m & (1 << 64) - 1 == 0 for m in masks)
        sizes.append(min((m & (1 << 64) - 1).bit_count() for m in masks))
    assert sizes == sorted(sizes) and sizes[0] >= 9 and sizes[-1] >= 24


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    before = files()
    table = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n")), "sums")
    assert not [f for f in files() - before if f.startswith("shuffle_")]
    assert table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_parts_of_image_hashes_are_not_broadcast(spark):
    images = spark.range(100).select(F.col("id").alias("image_id"), F.xxhash64("id").alias("hash"))
    plan = similarity.image_matches(images)._jdf.queryExecution().executedPlan().toString()
    met = [line for line in plan.splitlines() if "Join" in line and "part#" in line]
    assert met and all("SortMergeJoin" in line for line in met)
