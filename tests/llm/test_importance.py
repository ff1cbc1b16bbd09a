"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from paperloom.llm import importance
from tests.llm.brute import LOWER

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, bucket string, score string, _part int, _row string"


def features(text, max_run):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 97 for k in range(1, max_run + 1) for i in range(len(w) - k + 1))


def plain(docs, target, max_run, min_words=20, percent=10, seed="2024"):
    rows = [(d, *features(t, max_run)) for d, t in docs]
    s, t = sum((f for _, _, f in rows), Counter()), sum((features(x, max_run)[1] for x in target), Counter())
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 97) / ((s[b] + 1) * (big_t + 97)))) for b in range(97)}
    out = []
    for d, n, f in rows:
        weight = sum(gain[b] * c for b, c in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((n, d, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[0] >= min_words), key=lambda x: (-x[4], x[1] is None, x[1] or 0, x[2], x[3]))
    drawn = [(*x[1:], k + 1) for k, x in enumerate(able[: len(able) * percent // 100])]
    rest = [(*x[1:], None) for x in able[len(drawn) :]] + [(*x[1:], None) for x in out if x[0] < min_words]
    return sorted(drawn + rest, key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abÀé中Z9 -_\t") for _ in range(rng.randint(1, 12)))
    rows = [(rng.randrange(80), " ".join(word() for _ in range(rng.randint(0, 90)))) for _ in range(150)]
    rows += [rows[3], rows[3], (None, rows[3][1]), (None, rows[4][1]), (None, None), (7, ""), (8, " - "), (-5, "long" * 300_000 + " of " + "words " * 400_000)]
    return rows


@pytest.mark.parametrize("max_run", [1, 3])
def test_resample(spark, docs, max_run, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 1000)
    frame = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in docs], SCHEMA).repartition(5)
    target = spark.createDataFrame([(t,) for _, t in docs[:9]] + [(None,), ("",)], "text string")
    got = importance.resample(frame, target, max_run, buckets=97)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, [t for _, t in docs[:9]], max_run)


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], SCHEMA)
    frame = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in docs], SCHEMA)
    assert importance.resample(none, none).collect() == []
    got = importance.resample(frame, none, buckets=97)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, [], 1)


def test_crc32_of_ranges():
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(5000))
    starts = np.array([rng.randrange(4000) for _ in range(300)] + [0])
    ends = starts + np.array([rng.choice([0, 1, 3, 9, 900]) for _ in range(300)] + [5000])
    got = importance.crc32(np.frombuffer(data, np.uint8), starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends, strict=True)]


def test_matrix_holds_every_document(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    blocks = importance.matrix(frame, buckets=97).collect()
    assert sum(len(b["doc_id"]) for b in blocks) == len(docs)
    for b in blocks:
        assert len(b["starts"]) == len(b["doc_id"]) + 1 and b["starts"][-1] == len(b["bucket"]) == len(b["n"])


def test_matrices_are_read_by_few_blocks(spark, docs, monkeypatch):
    read, sums, weigh = [], importance.distribution, importance.keyed
    at = lambda f: lambda *a: (read.append(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")), f(*a))[1]
    monkeypatch.setattr(importance, "distribution", at(sums))
    monkeypatch.setattr(importance, "keyed", at(weigh))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    importance.resample(frame, frame.select("text"), buckets=97)
    assert read == ["16"] * 3 and spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "4096"
