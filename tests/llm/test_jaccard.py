"""The similarity join against all pairs."""

import random

import pyarrow.parquet as pq
import pytest

from paperloom.llm import jaccard
from tests.llm.brute import LOWER, WORD

SCHEMA = "doc_id long, text string, node string, a long, b string, key int"


def sets_of(text):
    w = [x.translate(LOWER) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)])


def plain(rows, percent=85):
    """(doc_id, set size, component) of each row, by all pairs of sets that share an n-gram; null ids have no component."""
    sets = [(d, sets_of(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first, lists = {}, {}
    for d, s in sets:
        if d is not None and s:
            first.setdefault(s, d)
            root[max(find(d), find(first[s]))] = min(find(d), find(first[s]))
    for k, s in enumerate(first):
        for g in s:
            lists.setdefault(g, []).append(k)
    distinct, seen = list(first), set()
    for at in lists.values():
        for i, a in enumerate(at):
            for b in at[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    x, y = distinct[a], distinct[b]
                    both = len(x & y)
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        p, q = sorted((find(first[x]), find(first[y])))
                        root[q] = p
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def rows_of(got):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()), key=str)


def copies(rng, n_base, n, words, edits):
    vocabulary = [f"w{i}" for i in range(3000)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice(words))] for _ in range(n_base)]
    out = []
    for _ in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice(edits)):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_tables(spark, sf):
    rows = pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert rows_of(jaccard.query(spark, f"/root/testdata/{sf}")) == plain([(r["doc_id"], r["text"]) for r in rows])


@pytest.mark.parametrize("boundary", [None, 0, 100, 10**9])
@pytest.mark.parametrize("percent", [85, 60])
def test_copies_near_the_threshold(spark, boundary, percent, monkeypatch):
    if boundary is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda postings, percent: boundary)
    monkeypatch.setattr(jaccard, "SHARE", 20)
    rng = random.Random(percent)
    texts = copies(rng, 6, 250, [5, 9, 30, 95, 110, 400], [0, 1, 1, 2, 3, 4, 7]) + ["a b", "a b", "A b c", "x", "a b c d e f", "a b c d e f g", None, "", " \t"]
    # A passage in texts that have nothing else in common, and links between components over a third text.
    texts += [" ".join(f"u{i}.{k}" for k in range(80)) + " the same words again and again in every text" for i in range(60)]
    rows = [(1000 + 7 * i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], SCHEMA).repartition(4)
    assert rows_of(jaccard.similar(docs, percent)) == plain(rows, percent)


def test_repeated_and_null_ids(spark):
    rng = random.Random(8)
    a, b, c = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(60)) for k in "abc")
    rows = [(5, a), (5, a), (5, b), (3, b), (9, c), (None, c), (None, c), (None, None), (2, None), (2, c), (7, a + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.similar(docs).collect()}
    assert got == {(5, 57): 3, (3, 57): 3, (9, 57): 2, (None, 57): None, (None, 0): None, (2, 0): 2, (2, 57): 2, (7, 58): 3}


def test_empty_table_and_long_text(spark):
    assert jaccard.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rng = random.Random(1)
    long = [str(rng.randrange(10**9)) for _ in range(250_000)]
    rows = [(2, " ".join(long)), (1, " ".join(long[:240_000])), (3, " ".join(long[:150_000])), (4, "x" * 2_500_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(jaccard.similar(docs)) == [(1, 239_997, 1), (2, 249_997, 1), (3, 149_997, 3), (4, 1, 4)]


def test_half_equal_sets_are_refused(spark):
    with pytest.raises(ValueError, match="half"):
        jaccard.similar(spark.createDataFrame([], "doc_id long, text string"), 50)
