import random
import zlib

import corpus_pipeline
from paperloom.llm import mixing, near_dup, quality, suffix_dedup
from tests.llm import brute
from tests.llm.test_ops import SCHEMA, TOKENIZER, table


def test_stages_follow_one_another(spark, tmp_path):
    rows = table(None, 90)
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = quality.stage(spark, docs, "")
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good
    one = near_dup.stage(spark, kept, "")
    want = {c for _, c in brute.components([r[:2] for r in rows if r[0] in good]).values()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == want
    cut = suffix_dedup.stage(spark, one, "").cache()
    assert cut.columns == docs.columns
    lengths = {d: n - gone for d, n, gone, *_ in brute.removed([r[:2] for r in rows if r[0] in want])}
    for r in cut.collect():
        assert len(r.text.encode()) <= lengths[r.doc_id] <= len(r.text.encode()) + 6 and r.n_chars == len(r.text)
    mixed = mixing.stage(spark, cut, "").collect()
    taken = {r.doc_id: (r.taken, r["size"]) for r in mixing.taken(cut).collect()}
    for d, (t, n) in taken.items():
        assert sum(r.doc_id == d for r in mixed) == (-(-t // n) if t else 0)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in packed} == {r.doc_id for r in mixed}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    assert sum(p.length for p in packed) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert all(p.ids_crc32 <= 0xFFFFFFFF for p in packed) and zlib.crc32(b"") == 0


def test_stages_tell_rows_apart(spark):
    rng = random.Random(4)
    w = [[f"w{rng.randrange(10**9)}" for _ in range(60)] for _ in range(4)]
    near = [*w[0][:30], "new", *w[0][31:]]
    rows = [(5, w[0]), (7, near), (None, w[1]), (None, w[2]), (9, w[3]), (9, w[3]), (None, w[3]), (None, ["short"])]
    docs = spark.createDataFrame([(d, " ".join(t), "en", "s", 1, "x") for d, t in rows], SCHEMA)
    good = quality.stage(spark, docs, "")
    assert good.count() == 7
    one = near_dup.stage(spark, good, "")
    want = sorted((str(d), " ".join(t)) for d, t in (rows[0], rows[2], rows[3], rows[4]))
    assert sorted((str(r.doc_id), r.text) for r in one.collect()) == want
    taken = mixing.taken(one).collect()
    assert mixing.stage(spark, one, "").count() == sum(-(-r.taken // r["size"]) for r in taken if r.taken)


def test_stages_of_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(1, long, "en", None, 9, "a"), (1, long, "en", None, 9, "b"), (None, None, None, None, None, None), (None, "", "en", "s", 0, "x"), (2, "too few", "en", "s", 7, "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, "").count() == 0 and stage(spark, none, "").columns == docs.columns
        out = stage(spark, docs, "").collect()
        assert {r.text for r in out} <= {r[1] for r in rows} and out[0].asDict().keys() == set(docs.columns)
    assert corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0
    assert [r.text for r in quality.stage(spark, docs, "").collect()] == [long] * 2
    assert sorted(str(r.text)[:3] for r in near_dup.stage(spark, docs, "").collect()) == ["", "None"[:3], "too", "v0 "]


def test_mixing_of_equal_rows(spark):
    rows = [(7, "a b c d", "en", "s", 1, str(i)) for i in range(3)] + [(8, "e f g h i", "en", "t", 1, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    times = sum(-(-r.taken // r["size"]) for r in mixing.taken(docs).collect() if r.doc_id == 7)
    out = [r for r in mixing.stage(spark, docs, "").collect() if r.doc_id == 7]
    assert len(out) == times and max(sum(r.kept == str(i) for r in out) for i in range(3)) <= times


def test_stages_leave_columns_of_any_name(spark):
    names = ["_h", "_g", "_place", "_source", "_N", "_each", "_more", "__h", "kept", "name"]
    text = [" ".join(f"t{i % 3}w{k}" for k in range(80)) for i in range(4)]
    rows = [(i, text[i], "en", f"s{i % 2}", 9, *[f"{n}{i}" for n in names]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for stage in (quality.stage, near_dup.stage, mixing.stage):
        out = stage(spark, docs, "")
        assert out.schema == docs.schema
        assert {tuple(r) for r in out.collect()} <= set(rows) and out.count() > 0
