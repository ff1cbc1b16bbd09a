"""Similar lines against all pairs; original texts and residue of guidance on small outlines."""

import itertools
import random
from collections import Counter

import pytest

from paperloom.functions import text as T
from paperloom.operators import originals as O

LINES = "doc_id long, ord int, text string, title string, heading boolean, section int, extra string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def like(a, b):
    return not (a or b) or 1 - distance(a, b) / max(len(a), len(b)) >= 0.8


def edited(r, text, n):
    t = list(text)
    for _ in range(n):
        at, kind = r.randrange(len(t) + 1), r.randrange(3)
        if kind == 0:
            t.insert(at, r.choice("ab c1"))
        elif t:
            at %= len(t)
            t[at : at + 1] = [r.choice("abz")] if kind == 1 else []
    return "".join(t).strip()


@pytest.mark.parametrize("letters", ["ab ", "abcdefghijklmnopqrstuvwxyz 0123456789"])
def test_alike_finds_what_all_pairs_find(spark, letters):
    r = random.Random(len(letters))
    entries = {"".join(r.choice(letters) for _ in range(n)).strip() for n in [0, 1, 2, 3, 4, 5, 5, 6, 9, 10, 12, 15, 20, 21, 40, 41, 75, 200] for _ in range(3)}
    keys = {edited(r, e, r.randrange(len(e) // 4 + 2)) for e in entries for _ in range(8)} | entries
    got = O.alike(spark.createDataFrame([(k,) for k in [*keys, *keys, None]], "key string"), spark.createDataFrame([(e,) for e in [*entries, None]], "match string")).collect()
    want = {(k, e) for k in keys for e in entries if like(k, e)}
    assert len(got) == len({tuple(p) for p in got}) and {tuple(p) for p in got} == want
    assert any(k != e for k, e in want)


def test_alike_at_the_bound_and_with_edits_that_shift(spark):
    e = "the purpose of this section is told here in ten words"
    pairs = {e: True, e[: len(e) - len(e) // 5]: True, e[: len(e) - len(e) // 5 - 1]: False, "x" * (len(e) // 4) + e: True, "x" * (len(e) // 4 + 1) + e: False, "abcd": False}
    assert pairs == {k: like(k, e) for k in pairs}
    got = O.alike(spark.createDataFrame([(k,) for k in pairs], "key string"), spark.createDataFrame([(e,)], "match string")).collect()
    assert {k for k, _ in got} == {k for k, v in pairs.items() if v}
    assert O.alike(spark.createDataFrame([(e,)], "key string"), spark.createDataFrame([], "match string")).count() == 0


def outline(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], LINES).repartition(3)


def texts(spark, rows, guidance, **kw):
    found = O.original_texts(outline(spark, rows), spark.createDataFrame([(g, "y") for g in guidance], "text string, title string"), **kw)
    return {r["doc_id"]: (r["text"], r["n_pieces"], r["whole"]) for r in found.collect()}


RULE = "Bu bölümde projenin amacı anlatılmalıdır"


def test_original_text_without_guidance_headings_bibliography_and_short_lines(spark):
    rows = [
        (1, 1, "Title page of the team", "Title page of the team", False, 0), (1, 2, "1. Purpose", "Purpose", True, 1), (1, 3, "Bu bolumde projenin amaci anlatilmalidir.", "b", False, 1),
        (1, 4, "  We measure rain over the city  ", "w", False, 1), (1, 5, "too short", "t", False, 1), (1, 6, "We measure rain over the city", "w", False, 1),
        (1, 7, "The station sends a value each hour", "t", False, 1), (1, 8, "KAYNAKÇALAR", "KAYNAKÇALAR", True, 2), (1, 9, "Somebody, Weather stations, 2020", "s", False, 2),
    ]
    rain = "We measure rain over the city"
    assert texts(spark, rows, [RULE, None]) == {1: ("\n".join([rain, rain, "The station sends a value each hour"]), 3, False)}
    # No name of a bibliography: the section counts.
    assert texts(spark, rows, [RULE], bibliography=())[1][1:] == (4, False)


def test_whole_text_where_sections_give_fewer_than_three_pieces(spark):
    plain = [(2, k, f"Line number {w} of a text", "t", False, 0) for k, w in enumerate(("one", "two", "three"))]
    few = [(3, 1, "1. A heading of length", "A heading of length", True, 1), (3, 2, "The only line below it", "t", False, 1), (3, 3, RULE, "t", False, 1)]
    same = [(4, 1, "Short", "Short", True, 1), (4, 2, "The only line below it", "t", False, 1)]
    none = [(5, 1, RULE, "t", False, 0), (5, 2, None, None, False, 0), (6, 1, "", "", False, 0)]
    got = texts(spark, plain + few + same + none, [RULE])
    assert got[2] == ("\n".join(r[2] for r in plain), 3, True)
    assert got[3] == ("1. A heading of length\nThe only line below it", 2, True)
    assert got[4] == ("The only line below it", 1, False)
    assert got[5] == got[6] == ("", 0, False)
    assert texts(spark, [], [RULE]) == {} and texts(spark, plain, [])[2][1] == 3


def test_residue_of_guidance(spark):
    own = " ".join(f"word{k}" for k in range(20))
    rows = [(1, 1, "1. A", "A", True, 1), (1, 2, RULE, "t", False, 1), (1, 3, own.rsplit(" ", 1)[0], "t", False, 1), (1, 4, "2. B", "B", True, 2), (1, 5, RULE, "t", False, 2), (1, 6, own, "t", False, 2)]
    rows += [(1, 7, "3. C", "C", True, 3), (1, 8, "few words only", "t", False, 3), (1, 9, "4. D", "D", True, 4), (2, 1, RULE, "t", False, 0), (2, 2, None, None, False, 0)]
    guidance = spark.createDataFrame([(RULE,), (RULE,), (None,)], "text string")
    got = {r["section"]: tuple(r)[2:] for r in O.residue(outline(spark, rows), guidance).collect()}
    assert got == {1: (24, 5, True), 2: (25, 5, False), 3: (3, 0, False), 4: (0, 0, False)}


def test_residue_by_the_guidance_of_the_sections_own_heading(spark):
    rows = outline(spark, [(1, 1, RULE, "t", False, 1), (1, 2, RULE, "t", False, 2)]).withColumn("wanted", O.F.col("section") + 10)
    guidance = spark.createDataFrame([(RULE, 11), ("Another rule about the budget", 12)], "text string, wanted int")
    got = {r["section"]: r["residue"] for r in O.residue(rows, guidance, ("wanted",)).collect()}
    assert got == {1: True, 2: False}


def test_keys_hold_only_what_the_index_knows(spark):
    odd = "Ğ İ ı ß 漢字 \t á _-7"
    key = spark.createDataFrame([(odd,)], "t string").select(T.key(O.F.col("t"))).collect()[0][0]
    assert set(key) <= set(O._ALPHABET)


def test_alike_in_many_groups_and_only_pairs_that_share_enough(spark, monkeypatch):
    r = random.Random(8)
    syllables = "the on er ing ti st an nd re ha".split()
    line = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(12))
    entries = sorted({line() for _ in range(30)})
    keys = sorted({line() for _ in range(300)} | {edited(r, e, 4) for e in entries})
    found = O._candidates(O.pa.table({"key": keys}), O.pa.table({"match": entries})).to_pylist()
    want = {(k, e) for k in keys for e in entries if abs(len(k) - len(e)) <= max(len(k), len(e)) // 5 and like(k, e)}
    assert len(want) >= 30 and want <= {(f["key"], f["match"]) for f in found} and len(found) < len(keys) * len(entries) // 20
    monkeypatch.setattr(O, "KEYS", 40)
    monkeypatch.setattr(O, "ENTRIES", 7)
    assert {tuple(p) for p in O.alike(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(e,) for e in entries], "match string")).collect()} == want


def test_original_texts_write_each_text_once(spark, monkeypatch):
    written, write = [], O.materialize

    def kept(df, label):
        written.append(df.columns)
        return write(df, label)

    monkeypatch.setattr(O, "materialize", kept)
    rows = [(1, k, f"line {k} of the report itself", None, False, 0) for k in range(4)] + [(None, 1, "a line of guidance here", None, False, 0), (2, 1, None, None, False, 0), (3, 1, "short", None, False, 0)]
    found = texts(spark, rows, ["a line of guidance here", "line 2 of the report itself"])
    # The lines of the first document are alike.
    assert found == {1: ("", 0, False), None: ("", 0, False), 3: ("", 0, False)}
    assert written == [["doc_id", "lines"], ["key"]]


def test_near_entries_are_all_that_share_enough(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeghiklnorst") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    runs = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [runs(60) for _ in range(6)]
    entries = [" ".join(p[k : k + 12]) for p in passages for k in range(0, 49, 3)] + ["", "ab", "x" * 300, "ab " * 120]
    keys = ["x" * 290] + [" ".join(runs(rng.randint(0, 14))) for _ in range(300)] + ["", "ab", "ab " * 130, "q" * 70]
    for e in entries:
        t = list(e)
        for _ in range(rng.randint(0, len(t) // 4)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice(["", "q", t[i] + "z"])
        keys.append("".join(t))
    keys, entries = ([x.encode() for x in dict.fromkeys(v)] for v in (keys, entries))
    grams = lambda t: Counter((b"##" + t + b"##")[i : i + 3] for i in range(len(t) + 2))
    want = set()
    for k, e in itertools.product(keys, entries):
        most = max(len(k), len(e))
        fits = len(e) >= len(k) - len(k) // O.EDITS and len(e) <= len(k) + len(k) // (O.EDITS - 1)
        if fits and (grams(k) & grams(e)).total() >= most + 2 - 3 * (most // O.EDITS):
            want.add((k, e))
    # What is needed is found once for a length, not for each key.
    asked, needed = Counter(), O._needed
    monkeypatch.setattr(O, "_needed", lambda n, m: (asked.update([(n, len(m))]), needed(n, m))[1])
    got = [(keys[k], block[i]) for k, near, block in O._near(keys, entries) for i in near]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert max(asked.values()) == 1 < len(asked)
