import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import html_text, lm, mixing, near_dup, packing, quality, suffix_dedup, topk, url_filter, warc
from tests.llm import brute

TOKENIZER = pytest.importorskip("public_tokenizers").path(packing.TOKENIZER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(200)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = " ".join(words(60))
    out = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            t = words(rng.randint(50, 150))
        elif kind == 1:
            t = rng.choice(out).split(" ")
        elif kind == 2:
            t = rng.choice(out).split(" ")
            t[rng.randrange(len(t))] = "new"
        elif kind == 3:
            t = words(30) + passage.split(" ") + words(30)
        elif kind == 4:
            t = words(rng.randint(1, 6))
        else:
            t = ["the"] * 40 + words(rng.randint(60, 90))
        out.append(" ".join(t))
    return out


def table(spark, n=60):
    rows = [(i, t, "en", f"s{i % 3 if i % 2 else 0}", len(t), "x") for i, t in enumerate(texts(n=n))]
    rows += [(n, None, None, None, None, None), (n + 1, "", "en", None, 0, None), (n + 2, " \t\n\x0b ", "en", "s1", 5, "x")]
    rows += [(n + 3, "word " * 30_000, "en", "s2", 150_000, "x"), (n + 4, "aaaa" * 100, "en", "s0", 400, "x"), (n + 5, "Ab\x00c " * 40, "en", "s0", 200, "x")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return table(None)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("hot", [5000, 1])
def test_suffix_dedup(docs, rows, hot):
    got = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    assert sorted(map(tuple, got), key=str) == brute.removed([r[:2] for r in rows])


def test_suffix_dedup_over_many_buckets_and_shares(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4_000)
    got = suffix_dedup.remove_repeats(docs).collect()
    assert sorted(map(tuple, got), key=str) == brute.removed([r[:2] for r in rows])


def test_suffix_dedup_ties_and_nulls(spark):
    a, b = "x" * 10 + "0123456789" * 6, "tail " * 12
    rows = [(5, a), (5, a), (7, b + a), (None, b), (None, a), (2, b)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute.removed(rows)


def test_suffix_dedup_of_one_anchor_with_many_segments(spark):
    # A rare gram between parts that differ everywhere: one anchor, and every text's segments differ from all others.
    rng = random.Random(9)
    rare = "qzqzjxjxkvkvwywy" * 3
    rows = [(i, f"{rng.randrange(10**12):012d}{rare}{rng.randrange(10**12):012d}") for i in range(3000)]
    rows += [(3000 + i, rows[i][1] + "tail") for i in range(50)] + [(None, rows[0][1]), (None, rows[0][1] + "x"), (5, "other")]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), hot=500).collect()
    assert sorted(map(tuple, got), key=str) == brute.removed(rows)


def test_suffix_dedup_remembers_across_batches():
    seen = suffix_dedup._Remembered()
    pair, yes = np.array([3, 5, 9], np.uint64), np.array([True, True, False])
    assert not seen.settled(pair, np.array([10, 20, 30]), yes).any()
    assert list(seen.settled(pair, np.array([11, 20, 31]), yes)) == [True, False, False]
    assert list(seen.settled(pair, np.array([4, 21, 32]), yes)) == [False, True, False]
    assert list(seen.settled(pair, np.array([5, 5, 5]), yes)) == [True, False, False]


def test_suffix_dedup_tells_contexts_of_an_anchor_apart():
    # All words are frequent, some stand repeatedly: equal strings of two segments must always show in their codes.
    rng = random.Random(5)
    words = ["of the information society", "in the same way as before", "aaaaaaaaaaaaaaaaaaaaaaaa", "x", "and that is what", "\u00e9t\u00e9"]
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))).encode() for _ in range(80)]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
    anchor, _, row, first, size, code = suffix_dedup.segments(data, offsets, True)
    of = defaultdict(set)
    for i in range(len(anchor)):
        for at in range(first[i], first[i] + size[i]):
            of[data[at : at + 50].tobytes()].add(i)
    assert sum(size) == sum(max(0, len(p) - 49) for p in parts) and (code == 0).any() and (code > 0).any()
    for found in of.values():
        for i, j in itertools.combinations(found, 2):
            a, b = int(code[i]), int(code[j])
            assert not a or not b or a >> 24 == b >> 24 > 0 or a & 0xFFFFFF == b & 0xFFFFFF > 0


def test_suffix_dedup_shows_no_frequent_phrase_in_other_contexts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(6)
    other = lambda: "".join(rng.choice("abcdefgh") for _ in range(60))
    shared = other() + " of the information "
    texts = [other() + " of the information " + other() for _ in range(300)] + [shared + other() for _ in range(3)]
    batch = pa.RecordBatch.from_pydict({"d": pa.array(range(len(texts))), "tag": pa.array(range(len(texts))), "text": texts})
    dealt = list(suffix_dedup._deal(1)(iter([batch])))
    told = list(suffix_dedup._gather(suffix_dedup._settle(5_000, 1)(iter(dealt))))
    # The phrase is an anchor of all 303 texts; only those three have more than it in common.
    assert {d for t in told for d, *kinds in zip(*(t.column(c).to_pylist() for c in ("d", "shown", "hot")), strict=True) if any(kinds)} == {300, 301, 302}


def test_suffix_dedup_deals_few_bytes_to_many_buckets(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(2_000)) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"d": pa.array(range(300)), "tag": pa.array(range(300)), "text": texts})
    size = lambda n: sum(len(x) for b in suffix_dedup._deal(n)(iter([batch])) for c in ("docs", "tags", "counts", "pairs", "anchors", "codes") for x in b.column(c).to_pylist())
    assert size(500) < 1.4 * size(1)


def test_suffix_dedup_deals_evenly(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(2_000)) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"d": pa.array(range(600)), "tag": pa.array(range(600)), "text": texts * 2})
    size = Counter()
    for b in suffix_dedup._deal(20)(iter([batch])):
        for bucket, settled, pairs in zip(*(b.column(c).to_pylist() for c in ("bucket", "settled", "pairs")), strict=True):
            size[settled, bucket] += len(pairs)
    # Anchors are least hashes and copies are settled by task: neither must fill a few buckets.
    fresh = [size[False, k] for k in range(20)]
    assert max(fresh) < 1.2 * sum(fresh) / 20
    assert max(size[True, k] for k in range(20)) <= 2 * 8 * suffix_dedup.SETTLED < sum(size[True, k] for k in range(20))


def test_suffix_dedup_whole(docs, rows):
    got = suffix_dedup.remove_repeats(docs, ("doc_id", "source"), whole=True)
    assert got.columns[:2] == ["doc_id", "source"]
    for r in got.collect():
        assert sum(s["last"] - s["first"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]


def test_bwt_owners_against_all_strings():
    rng = random.Random(3)
    base = [bytes(rng.choice(b"ab") for _ in range(120)) for _ in range(4)]
    parts = [b[i : i + rng.randint(50, 90)] for b in base * 3 for i in (0, rng.randint(0, 30))]
    docs = np.array([rng.randint(0, 9) for _ in parts])
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    got = suffix_dedup.owners(np.frombuffer(b"".join(parts), np.uint8), edges, docs)
    where = defaultdict(list)
    for d, p in zip(docs, parts, strict=True):
        for i in range(len(p) - 49):
            where[p[i : i + 50]].append(d)
    for k, p in enumerate(parts):
        for i in range(len(p)):
            s = p[i : i + 50]
            want = min(where[s]) if len(s) == 50 and len(where[s]) > 1 else suffix_dedup._LAST
            assert got[edges[k] + i] == want


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    got = packing.pack(docs, TOKENIZER).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert p.length > 0 and len(ids) == p.length and p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        by_doc[p.doc_id].append((p.start, p.length))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for d, ids in want.items():
        at = 0
        for start, length in sorted(by_doc[d]):
            assert start == at
            at += length
        assert at == len(ids)
    total = sum(map(len, want.values()))
    for s, parts in by_sequence.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == min(packing.SEQUENCE, total - s * packing.SEQUENCE)


def test_packing_of_very_many_sources(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    docs = spark.createDataFrame([(i, f"doc {i} " * (i % 40), f"s{i}") for i in range(5000)], "doc_id long, text string, source string")
    got = packing.pack(docs, TOKENIZER).collect()
    assert sum(p.length for p in got) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())
    by_sequence = defaultdict(int)
    for p in got:
        by_sequence[p.sequence_id] += p.length
    assert sorted(by_sequence.values())[1:] == [packing.SEQUENCE] * (len(by_sequence) - 1)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_ids_of_other_vocabularies(name):
    enc = packing.WordIds(pytest.importorskip("public_tokenizers").path(name))
    assert enc.plain == (name == packing.TOKENIZER)
    for w in ("Hello,", "don't", "caf\u00e9s", "x12"):
        assert enc._ids(w) == enc.tokenizer.encode(w, add_special_tokens=False).ids


def test_packing_follows_proportions():
    totals = np.array([50_000, 20_000, 3_000, 1], np.int64)
    plan = packing.Rounds(totals)
    for q, n in enumerate(totals):
        served = plan.served(np.full(plan.rounds + 1, q), np.arange(plan.rounds + 1))
        assert served[0] == 0 and served[-1] == n and (np.diff(served) >= 0).all()
        assert (np.abs(served - np.arange(plan.rounds + 1) * n / plan.rounds) <= packing.QUANTUM).all()


def test_word_ids_of_odd_texts():
    enc = packing.WordIds(TOKENIZER)
    odd = ["it's 'LL don't <|endoftext|> x<|startoftext|>y", "ÀÉ İstanbul ß ª º µ ﬁ Σς", "a b é ́c", "日本語 1234 4.5,6 <| |>", "\"'s ''ve !!?", ""]
    import pyarrow as pa

    from paperloom.llm import words as W

    ids, n = enc.encode(*W.utf8(pa.array(odd)))
    for text, part in zip(odd, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert list(part) == [*enc.tokenizer.encode(text, add_special_tokens=False).ids, 1]


def test_quality(docs, rows):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for d, text, *_ in rows:
        w = brute.WORD.findall(text or "")
        r = got[d]
        lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == sum(c in quality.SYMBOLS for c in text or "")
        assert r.n_dup_lines == len(lines) - len(set(lines)) and r.n_repeat_words == brute.repeat_words(w)
        assert r.base_failed == (len(w) < 50 or 100 * brute.repeat_words(w) > 50 * len(w))
    assert all(got[d].kept == (not got[d].base_failed and not got[d].host_rejected) for d, *_ in rows)


def test_quality_rejects_hosts(spark):
    good = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, good(i), f"host{i % 20}", None) for i in range(2000)]
    rows += [(5000 + i, good(i) if i % 5 == 0 else "few words", "spam", None) for i in range(200)]
    rows += [(6000 + i, good(i) + " #$%" * 20, "signs", None) for i in range(100)]
    rows += [(7000, "few words", "tiny", None), (7001, good(7001), "tiny", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _h string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows)
    for d, _, source, _ in rows:
        assert got[d].host_rejected == (source in ("spam", "signs")) and got[d].kept == (source not in ("spam", "signs") and d != 7000)
    per = {}
    for _, text, source, _ in rows:
        x = per.setdefault(source, [0, 0])
        x[0], x[1] = x[0] + (len(text.split()) < 50), x[1] + 1
    m = sum(f for f, _ in per.values()) / sum(n for _, n in per.values())
    rate = [f / n for f, n in per.values()]
    v = sum((r - sum(rate) / len(rate)) ** 2 for r in rate) / len(rate) - m * (1 - m) * sum(1 / n for _, n in per.values()) / len(per)
    k = min(1000.0, max(20.0, m * (1 - m) / v - 1))
    measured = quality.measures(docs).select("source", "n_words", "n_repeat_words", "n_symbols", "n_dup_lines")
    for r in quality.host_rates(measured).collect():
        f, n = per[r.source]
        assert r.rate_few_words == pytest.approx((f + m * k) / (n + k)) and r.n_docs == n and r.n_few_words == f


def test_near_duplicates(docs, rows):
    want = brute.components([r[:2] for r in rows])
    for r in near_dup.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for i in range(250):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(t)))
    want = brute.components(rows)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_of_a_group_of_unlike_texts_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(150)]
    rows = []
    for i in range(200):
        t = list(base)
        for k in range(2):
            t[rng.randrange(10, 140)] = f"x{i}.{k}"
        rows.append((i, " ".join(t)))
    made, write = {}, near_dup.materialize

    def counted(df, label):
        out = write(df, label)
        made[label] = out.count() if label == "late" else None
        return out

    monkeypatch.setattr(near_dup, "materialize", counted)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.components(rows)
    assert made["late"] < 1000  # of 19,900 pairs


def test_cores_bound_what_sets_share(spark):
    rng = random.Random(9)
    sets = {n: (n % 3, set(rng.sample(range(-50, 50), rng.randrange(40)))) for n in range(30)}
    rows = [(n, label, np.array(sorted(s), np.int64).tobytes()) for n, (label, s) in sets.items()]
    core = {r.node: r.core for r in near_dup.cores(spark.createDataFrame(rows, "node long, label long, shingles binary")).collect()}
    for n, (label, s) in sets.items():
        others = set().union(*(t for k, t in sets.values() if k != label))
        assert sum(core.get(n, [0])) == len(s & others)
        for m, (k, t) in sets.items():
            most = sum(map(min, core[n], core[m])) if n in core and m in core else 0
            assert k == label or most >= len(s & t)


def test_near_duplicates_of_short_documents(spark):
    rng = random.Random(11)
    rows = []
    for i in range(0, 8000, 2):
        n = 11 if i % 4 else 24
        t = [f"w{rng.randrange(10**9)}" for _ in range(n)]
        rows += [(i, " ".join(t)), (i + 1, " ".join(t[: n - (1 if n == 11 else 3)]))]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: c for d, c in got.items() if c != d - d % 2} == {}


def test_top_k(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (750, [1.0] * 15 + [float("nan")]), (800, [1.0, None] * 8), (850, [float("inf")] * 16), (900, [])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.scaled(F.col("embedding")).alias("x")).where("x is not null")
    assert e.count() == 700
    old = topk.SHARD
    topk.SHARD = 200
    try:
        got = topk.top_k(e, e.where("vec_id % 50 = 0")).collect()
    finally:
        topk.SHARD = old
    ints = np.floor(256 * x.astype(float)).astype(np.int64)
    for q in range(0, 700, 50):
        score = ints @ ints[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [(r.rank, r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(k + 1, i, score[i]) for k, i in enumerate(best)]


def test_top_k_small(spark):
    e = spark.createDataFrame([(0, [1.0, 2.0]), (50, [3.0, 1.0]), (1, [1.0])], "vec_id long, x array<double>")
    assert {(r.query_id, r.rank, r.vec_id) for r in topk.top_k(e, e.where("vec_id % 50 = 0")).collect()} == {(0, 1, 50), (50, 1, 0)}


def test_mixing(docs, rows):
    got = mixing.taken(docs).collect()
    size = {r[0]: len(brute.WORD.findall(r[1] or "")) for r in rows}
    own = Counter()
    for r in rows:
        own[r[3]] += size[r[0]]
    names = sorted(own, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(own.values()), set(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * own[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * own[s]
            left -= target[s]
            open_.discard(s)
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == own[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 2 * mixing.PIECE
    assert sum(taken.values()) == sum(size.values()) * 3 // 2
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.taken(docs).collect()), key=str)


def test_mix_takes_the_first_of_the_range_sorted_finish_times(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 20)
    sized = mixing._sized(docs)
    m = mixing.mix(sized).collect()
    assert len({r._part for r in m}) > 3
    m.sort(key=lambda r: (r.virtual_finish, r.source is None, r.source or "", r.place, r["size"], r["pass"], r.piece))
    assert [r._part for r in m] == sorted(r._part for r in m)
    left = m[0].budget
    for r in m:
        assert r.words == min(r.length, left)
        left -= r.words
    assert left == 0


def test_mixing_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "d e", "s"), (None, "f", None), (None, "f", None), (2, "", "s"), (3, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(docs).collect()
    assert len(got) == 7 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    out = Counter((r.doc_id, r.text) for r in mixing.stage(spark, docs, "").collect())
    assert all(n <= 2 * sum((d, t) == (x, y) for x, y, _ in rows) for (d, t), n in out.items()) and out[1, "a b c"] >= 2


def test_warc(spark, tmp_path):
    mark = warc.MARK
    htmls = ["<p>a</p>", "<p>a</p>", None, "", "x" * 200_000, mark + "y" + mark, "tail\r\n\r\n", "é" * 70_000, "WARC/1.1", "\n"]
    rows = [(i, f"http://a.b/{i}\r\nX: y", h, "extra") for i, h in enumerate(htmls)] + [(9, None, "\n", "extra"), (4, "http://again", htmls[4], "extra"), (None, "http://n", "only", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    got = warc.archive(pages, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    top = {}
    for i, _, h, _ in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    by_id = defaultdict(list)
    for r in got:
        assert r.whole
        by_id[r.page_id].append(r)
    for i, _, h, _ in rows:
        data = (h or "").encode()
        for r in by_id[i]:
            assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            first = i is None or top[h or ""] == i
            assert r.record_type == ("response" if first else "revisit") and r.refers_to == (None if first else top[h or ""])
    import gzip

    found = [x for f in (tmp_path / "w").glob("*.gz") for x in warc.parse(gzip.decompress(f.read_bytes()))]
    assert Counter(h["WARC-Type"] for h, _ in found)["continuation"] > 3
    named = Counter(h["WARC-Record-ID"] for h, _ in found)
    assert max(named.values()) == 1 and all(named[h["WARC-Refers-To"]] for h, _ in found if "WARC-Refers-To" in h)
    assert all(h[""] == "WARC/1.1" and len(b) == int(h["Content-Length"]) for h, b in found)
    assert all(h["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode() for h, b in found)


def test_lm(docs, rows):
    got = {r.doc_id: r for r in lm.score(docs).collect()}
    words = {r[0]: [w.translate(brute.LOWER) for w in brute.WORD.findall(r[1] or "")] + [None] for r in rows}
    out = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in words}
    c = Counter(w for d, ws in words.items() if not out[d] for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in words.items():
        r = got[d]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_lm_does_not_depend_on_the_layout(spark, docs, rows):
    more = spark.createDataFrame([(1000 + i, t, None, None, None, None) for i, t in enumerate(texts(seed=4, n=300))], SCHEMA)
    all_docs = docs.unionByName(more)
    want = None
    for parts in (2, 8, 50):
        got = sorted((str(r.doc_id), r.base_score, r.score) for r in lm.score(all_docs.repartition(parts, "doc_id").sortWithinPartitions("doc_id")).collect())
        want = want or got
        assert [x[0] for x in got] == [x[0] for x in want]
        assert np.allclose([x[1:] for x in got], [x[1:] for x in want], rtol=1e-9)


def test_lm_steps_against_plain_ones():
    rng = np.random.default_rng(6)
    n = 4000
    one, two = rng.integers(0, 12, n).astype(np.uint32), rng.integers(0, 9, n).astype(np.uint32)
    y, held = (one + rng.integers(0, 3, n)) % 7, rng.random(n) < 0.2
    prior = np.log(np.full(lm.CLASSES, 1 / lm.CLASSES)).astype(np.float32)
    got = lm.fit_and_score(one, two, y.astype(np.int64), held, prior)
    # The same model as a dictionary of weights, one context after another; all of them fit into one step.
    pairs = sorted(set(zip(one.tolist(), two.tolist(), strict=True)))
    times = Counter(zip(one[~held].tolist(), two[~held].tolist(), y[~held].tolist(), strict=True))
    of = [lambda a, b: ("one", a), lambda a, b: ("both", a, b), lambda a, b: ("two", b)]
    total = Counter()
    for (a, b, _), k in times.items():
        for f in of:
            total[f(a, b)] += k

    def hashed(values):
        often = [v for v in values if total[v] > 1]
        size = 1 << len(often).bit_length()
        number = lambda v: v[1] if len(v) == 2 else (v[1] << 32) | v[2]
        return {v: int(lm.W.mix(np.array([number(v)], np.uint64))[0]) % size if v in often else None for v in values}

    row = {}
    for k in range(3):
        row |= {v: None if r is None else (v[0], r) for v, r in hashed({of[k](a, b) for a, b in pairs}).items()}
    weights, seen = defaultdict(lambda: np.zeros(lm.CLASSES)), Counter()

    def softmax(a, b):
        z = prior + sum(weights[row[f(a, b)]] for f in of if row[f(a, b)] is not None)
        e = np.exp(z - z.max())
        return e / e.sum()

    for _ in range(lm.EPOCHS):
        gradient, m = defaultdict(lambda: np.zeros(lm.CLASSES)), Counter()
        for a, b in pairs:
            counts = np.array([times[a, b, c] for c in range(lm.CLASSES)])
            g = counts.sum() * softmax(a, b) - counts
            for f in of:
                if (r := row[f(a, b)]) is not None:
                    gradient[r] += g
                    m[r] += counts.sum()
        for r, g in gradient.items():
            weights[r] -= lm.RATE / math.sqrt(1 + seen[r] / (4 * lm.STEP)) * g / (m[r] + lm.DAMP)
            seen[r] += m[r]
    for i in range(0, n, 37):
        assert got[i] == pytest.approx(math.log10(softmax(int(one[i]), int(two[i]))[int(y[i])]), abs=1e-4)


def test_lm_shares_of_all_words_add_up(spark, docs):
    seen = docs.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1").select("text")
    counts = seen.mapInArrow(lm._count(3), lm._DEALT).groupBy("bucket").applyInArrow(lm._add_counts, lm._COUNTS)
    model = lm.prepare(counts)
    t = counts.toArrow()
    h, c = t["key"].to_numpy().view(np.uint64), t["c"].to_numpy()
    y = model.classes(h, t["grp"].to_numpy().astype(np.int64), model.place(h))
    share = np.bincount(y, weights=c + 0.5, minlength=lm.CLASSES) + 0.5
    assert np.allclose(np.log10(share), model.log_totals) and abs(np.exp(model.prior).sum() - 1) < 1e-5


def test_lm_splits_common_words():
    h = np.array([7, 7, 8, 7, 7, 8] * 500, np.uint64)
    model = lm.Model(np.array([7, 8], np.uint64), np.array([lm.COMMON * 9, 5]), np.array([7], np.uint64), np.zeros(lm.GROUPS, np.int64), np.ones(lm.CLASSES))
    row = np.repeat(np.arange(1000), 3)
    doc = np.random.default_rng(1).integers(0, 1 << 60, 1000).astype(np.uint64)
    shard, one, two = model.shard(h, model.place(h), row, doc, 100)
    both = (h == 8) & (np.arange(3000) % 3 == 2)
    assert len(set(shard[both])) > 1 and len(set(zip(one[both], two[both], strict=True))) == 1


def test_lm_beats_unigrams_on_held_out_documents(spark):
    rng = random.Random(5)
    prose = {k: [f"{p}{i}" for i in range(300)] for k, p in enumerate(("tha", "éle", "sch"))}
    rows = [(i, " ".join(rng.choice(prose[i % 3]) for _ in range(150))) for i in range(400)]
    r = lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert r[1] > r[0] + 0.05 * abs(r[0])


def test_lm_without_training_rows(spark):
    d = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.score(spark.createDataFrame([(d, "a b")], "doc_id long, text string")).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0)


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header><nav><li>Home</nav>"
    "<div class=ad>Buy</div>%s<aside>More</aside><div id='comments'><p>First!</div><footer>&copy; x</footer>"
)


def test_html_text(spark):
    bodies = [f"<article><h1>Head {i}</h1><p>One {i} &amp; two&nbsp;<b>bold<br><p>Three &am {i}</p><p>Follow us</p><form><p>Mail</form></article>" for i in range(9)]
    rows = [(i, "http://h.org/a", PAGE % b, 1) for i, b in enumerate(bodies)]
    rows += [(20, None, None, 1), (21, "no scheme", "", 1), (22, "http://q.org", "plain <p>text", 1), (23, "http://r.org", PAGE % "<div>A<p>B</p>C</div>", 1)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()}
    for i in range(9):
        assert got[i].text == f"Head {i}\nOne {i} & two bold\nThree &am {i}"
    assert [got[i].text for i in (20, 21, 22, 23)] == ["", "", "plain\ntext", "A\nB\nC"]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_html_copies_keep_their_text(spark):
    rows = [(i, "http://h.org/a", PAGE % "<article><h1>Same</h1><p>Text</p></article>") for i in range(20)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Same\nText"}


def test_html_template_of_neutral_names(spark):
    page = "<html><body><div class=x1><p>Welcome to our site, read on</div><div class=x2><h1>Head {i}</h1><p>One {i} text that is long enough, so that the page says more of its own than of its site</p>{more}<p>Subscribe to our letter today</p></div><div class=x3>Made by us</div>"
    rows = [(i, "http://h.org/a", page.format(i=i, more="<p>More</p>" * (i % 3)), 0) for i in range(40)]
    rows += [(40 + i, "http://small.org/a", page.format(i=i, more=""), 0) for i in range(3)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, shapes long")).collect()}
    for i in range(40):
        kept = got[i].split("\n")
        assert kept[:2] == [f"Head {i}", f"One {i} text that is long enough, so that the page says more of its own than of its site"] and set(kept[2:]) <= {"More"}
    assert all("Welcome to our site, read on" in got[40 + i] for i in range(3))


def test_html_articles_in_many_copies_keep_their_text(spark):
    article = "<article><h1>Title</h1>" + "".join(f"<p>Paragraph {k} of the long article</p>" for k in range(6)) + "</article>"
    rows = [(i, "http://h.org/a", PAGE % article) for i in range(20)]
    rows += [(100 + i, "http://h.org/b", PAGE % f"<article><h1>Short {i}</h1><p>Text {i}</p></article>") for i in range(12)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].count("\n") == 6 for i in range(20)) and all(got[100 + i] == f"Short {i}\nText {i}" for i in range(12))


def test_html_template_of_any_length_and_on_small_hosts(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    rows, own = [], {}
    for h, (n_pages, n_words) in enumerate([(40, 30), (40, 60), (40, 90), (5, 60)]):
        around = [words(n_words // 2) for _ in range(2)]
        for _ in range(n_pages):
            text = f"{words(6)}\n{words(54)}"
            body = "".join(f"<p>{x}</p>" for x in text.split("\n"))
            own[len(rows)] = text
            rows.append((len(rows), f"http://h{h}.org/a", f"<html><body><div class=x1><p>{around[0]}</p></div><div class=x2>{body}</div><div class=x3><p>{around[1]}</p></div>"))
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == own


def test_html_names():
    dropped = ("ad", "site-footer", "ad-box-2", "cookieBanner", "main_nav", "comments", "share-buttons")
    kept = ("related-work", "menu-of-the-day", "has-sidebar", "share-price", "adventure", "comment-on-law", "")
    one = lambda c: html_text.Page(f"<article><p>a</p><div class='{c}'>b</div><section id='{c}'>c</section></article>").content()
    assert [len(one(c)) for c in dropped] == [1] * len(dropped) and [len(one(c)) for c in kept] == [3] * len(kept)


def test_html_deep_and_broken_pages(spark):
    deep = "<div>" * 8000 + "deep" + "</div>" * 7000
    broken = "<b>" * 3000 + "<p>x" * 3000 + "</i></td></li>" * 3000 + "<" * 100 + "<p a='" + "&#x110000; &bogus; <p>end"
    rows = [(0, "http://h.org", deep), (1, "http://h.org", "<div>" * 5000 + "<p>one</p><p>two"), (2, "http://h.org", broken), (3, "http://h.org", "<article>" + "<p>word</p>" * 20_000)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "deep" and got[1] == "one\ntwo" and got[2].startswith("x\nx") and got[3].count("word") == 20_000


def plain_matching(a, b):
    """Value of simple tree matching of two nested (tag, children) trees, by the textbook recursion."""
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain_matching(x, y))
    return 1 + best[-1][-1]


@pytest.mark.parametrize("whole", [1 << 20, 1])
def test_tree_matching_against_the_recursion(monkeypatch, whole):
    monkeypatch.setattr(html_text, "WHOLE", whole)
    html_text.align.cache_clear()
    rng = random.Random(8)

    def tree(depth):
        return (rng.choice(["div", "p", "ul"]), [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else [])

    def nodes(t, depth=0):
        return [(depth, t[0]), *(x for k in t[1] for x in nodes(k, depth + 1))]

    for _ in range(150):
        trees = [("", [tree(3) for _ in range(rng.randint(0, 3))]) for _ in range(2)]
        flat = [nodes(t)[1:] for t in trees]
        found = html_text.align(*(";".join(f"{d - 1}{t}" for d, t in f) for f in flat))
        assert len(found) + 1 == plain_matching(*trees)
        assert all(flat[0][a] == flat[1][b] for a, b in found.items()) and len(set(found.values())) == len(found)
        assert [b for _, b in sorted(found.items())] == sorted(found.values())


def test_tree_matching():
    a, b = html_text.Page("<div><h1>x</h1><p>1<p>2<ul><li>3</ul></div>").shape(), html_text.Page("<div><p>1<p>2<p>3<ul><li>4<li>5</ul></div>").shape()
    m = html_text.align(a, b)
    assert len(m) == 5 and m[0] == 0 and m[4] == 4


def test_url_filter(spark):
    urls = {
        "http://a.NET/x": ("a.net", "/x", "net/", "block"), "http://www.example.net/en/1": ("www.example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://net": ("net", "", None, "allow"),
        "http://x.org/fr/a?b": ("x.org", "/fr/a", "org/fr/", "allow"), "http://planet/": ("planet", "/", None, "allow"), "mailto:x": ("", "", None, "allow"),
        "http://m.ads-track.example.org/q#a": ("m.ads-track.example.org", "/q", None, "block"), "http://ads-track.example.org/fr/": ("ads-track.example.org", "/fr/", "org/fr/", "allow"),
        "http://notads-track.example.org/": ("notads-track.example.org", "/", None, "allow"), None: ("", "", None, "allow"),
    }
    rules = spark.createDataFrame([(*r, False) for r in url_filter.RULES] + [(h, p, "block", True) for h, p in url_filter.LISTED], "host string, path string, action string, listed boolean")
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string")
    got = url_filter.judge(pages, rules).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.url_host, r.url_path, r.url_rule, r.url_verdict) == urls[r.url]
    assert {r.url_verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("blocks", [1 << 20, 0])
def test_url_filter_of_a_long_list(spark, monkeypatch, blocks):
    monkeypatch.setattr(url_filter, "ARRAY_BLOCKS", blocks)
    rules = spark.createDataFrame([(f"h{i}.org", "/" + "p" * (i % 9), "block", True) for i in range(3000)] + [("h7.org", "/ppp/x", "allow", False)], "host string, path string, action string, listed boolean")
    urls = [f"http://x@a.h{i}.org.:80/{'p' * (i % 9 - i % 2)}" for i in range(4000)] + ["http://h7.org/ppp/x", "http://h0.org", "http://", ":80"]
    pages = spark.createDataFrame([(i, u, 1, 2, 3, 4) for i, u in enumerate(urls)], "u long, url string, best long, key long, host long, _u long")
    got = url_filter.judge(pages, rules).collect()
    assert len(got) == len(urls)
    for r in got[:0] + [x for x in got if x.u < 4000]:
        assert (r.url_verdict == "block") == (r.u < 3000 and (r.u % 2 == 0 or r.u % 9 == 0))
    last = {r.url: r.url_verdict for r in got}
    assert [last[u] for u in urls[4000:]] == ["allow", "block", "allow", "allow"]


def test_bloom_passes_every_listed_key(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    b = url_filter.bloom(keys, 1024)
    h = F.xxhash64("key")
    asked = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    hit = asked.withColumn("block", F.pmod(h, F.lit(1024))).join(b, "block").where(F.col("bits").bitwiseAND(url_filter._mask(h)) == url_filter._mask(h))
    assert hit.where("id < 5000").count() == 5000 and hit.where("id >= 5000").count() < 3000


def test_empty_tables(spark, none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert packing.pack(none, TOKENIZER).count() == 0
    assert quality.judge(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert mixing.taken(none).count() == 0
    assert lm.score(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_text(pages).count() == 0 and warc.archive(pages).count() == 0
    v = spark.createDataFrame([], "vec_id long, x array<double>")
    assert topk.top_k(v, v).count() == 0
