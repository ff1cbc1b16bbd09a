"""Hash trees and proofs against a plain version."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from paperloom.llm import merkle, ranges
from tests.llm.brute import LOWER

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, digest long, place string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row[4].translate(LOWER) if lower and row[4] is not None else row[4]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def grow(nodes, arity):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def plain(rows, arity, every=5):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = grow([leaf(r) for r in groups[s]], arity)
    top = grow([trees[s][-1][0] for s in names], arity) if names else []
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % every == 0
            node, proof = leaf(r, changed), []
            for levels, at in ((trees[s], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at // arity * arity : at // arity * arity + arity]
                    proof += [d for j, d in enumerate(run) if j != at % arity]
                    run[at % arity] = node
                    node, at = h(*run), at // arity
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[s][-1][0], root, h(*proof), node, node == root))
    return sorted(out, key=str)


def table(n, sources, seed=3):
    rng = random.Random(seed)
    rows = [(rng.randrange(n), "hot" if rng.random() < 0.4 else f"s{rng.randrange(sources)}", "en", rng.randrange(9), "Aé b" * rng.randrange(4)) for _ in range(n)]
    rows += [rows[0], rows[0], rows[0], (None, None, None, None, None), (None, "hot", None, None, ""), (4, "", "xX", 0, "\x00Q"), (4, "=", "xX", 0, "q")]
    return rows


@pytest.mark.parametrize(("n", "sources", "arity", "per_range"), [(700, 9, 2, 40), (300, 40, 3, 7), (260, 1, 16, 200_000)])
def test_manifest(spark, n, sources, arity, per_range, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", per_range)
    rows = table(n, sources)
    docs = spark.createDataFrame([(*r, "t", 1, "p") for r in rows], SCHEMA).repartition(6)
    got = merkle.proofs(*merkle.manifest(docs, arity=arity), arity)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, arity)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    rows = [(5, None, "en", 3, "Abc"), (1, None, "en", 3, "Abc")][:n]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.proofs(*merkle.manifest(docs))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 16)


def test_changed_texts_fail(spark):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = {r["doc_id"]: r["verified"] for r in merkle.proofs(*merkle.manifest(docs)).collect()}
    assert got == {i: i % 2 == 0 or zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200)}


def test_very_long_text(spark):
    rows = [(1, "s", "en", 1, "Word " * 600_000), (5, "s", "en", 1, "é" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.proofs(*merkle.manifest(docs))
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 16)
