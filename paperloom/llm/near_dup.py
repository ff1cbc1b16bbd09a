"""Near-duplicate documents: b-bit MinHash over word shingles, confirmed on the full sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.components import components
from paperloom.session import materialize

SHINGLE_WORDS, MIN_PERCENT = 5, 85
#: Bands of 4 minima by the least percentage: sets that similar share no band with probability (1 - (percent / 100)^4)^bands < 1e-10.
BANDS, ROWS = {85: 32, 80: 44}, 4
#: Least percentage and estimate of the pipeline's stage; the loss at 0.80 is as small as that of MIN_ESTIMATE at 0.85.
STAGE_PERCENT, STAGE_ESTIMATE = 80, 0.705
#: Minima of a signature; the first of them also make the bands.
SLOTS = 1024
#: Low bits that are kept of a mixed minimum, and the estimate under which a pair of large sets is not confirmed. Each
#: slot of a pair at 0.85 agrees with p = 0.85 + 0.15 / 2^BITS; the binomial tail of SLOTS below this estimate is under 2e-9.
BITS, MIN_ESTIMATE = 2, 0.766
#: Sets up to this size travel whole beside their signature; two of them are compared exactly, never by an estimate.
SMALL = 48
_WORDS = [f"s{i}" for i in range(SLOTS // 64 * BITS)]

_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, small array<long>, " + ", ".join(f"{s} long" for s in _WORDS)
_SETS = "node long, shingles binary"
#: Parts, by hash, in which the shingles that a set shares with other components are counted.
PARTS = 64


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of rows: first row, its number of rows, distinct shingle hashes and their rows."""
    data, offsets = W.utf8(texts)
    for i, j in W.slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, rows = W.spans(part, at)
        h, r = W.shingles(W.hashes(part, starts, ends), rows, j - i, SHINGLE_WORDS)
        yield i, j - i, h, r


def _sign(batches: Iterator[pa.RecordBatch], n_bands: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(5)
    mult = rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, SLOTS, dtype=np.uint64)
    for batch in batches:
        ids = batch.column("doc_id")
        for i, n, h, r in _sets(batch.column("text")):
            counts = np.bincount(r, minlength=n)
            full = np.flatnonzero(counts)
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])[full] if len(full) else np.zeros(0, int)
            minima = np.empty((n_bands * ROWS, len(full)), np.uint64)
            bits = np.zeros((BITS, SLOTS // 64, len(full)), np.uint64)
            both = np.empty((2, n), np.uint64)
            if len(full):
                for k in range(SLOTS):
                    low = np.minimum.reduceat(h * mult[k] + add[k], first)
                    if k < len(minima):
                        minima[k] = low
                    # Low bits of h * mult + add depend on low bits of h alone, alike in all slots; mixed ones collide by chance in each.
                    low = W.mix(low)
                    for b in range(BITS):
                        bits[b, k // 64] |= ((low >> np.uint64(b)) & np.uint64(1)) << np.uint64(k % 64)
                for k in range(2):
                    both[k][full] = np.add.reduceat(W.mix(h + np.uint64(k + 1)), first)
            band = np.zeros((n_bands, len(full)), np.uint64)
            for k in range(ROWS):
                band = band * np.uint64(0xD6E8FEB86659FD93) + minima[k::ROWS]
            band = W.mix(band + np.arange(n_bands, dtype=np.uint64)[:, None]).view(np.int64).T
            planes = dict(zip(_WORDS, bits.view(np.int64).reshape(len(_WORDS), -1) if len(full) else [np.zeros(0, np.int64)] * len(_WORDS), strict=True))
            some = counts > 0
            spread = np.cumsum(some) - 1
            # Rows without shingles have no digest, bands and signature.
            take = pa.array(np.where(some, spread, 0), mask=~some)
            digest = [both[:, k].tobytes() if some[k] else None for k in range(n)]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * n_bands, pa.int32()), pa.array(np.ascontiguousarray(band).reshape(-1)))
            small = [h[f : f + c].view(np.int64) if 0 < c <= SMALL else None for f, c in zip(np.cumsum(counts) - counts, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(i, n), pa.array(counts.astype(np.int64)), pa.array(digest, pa.binary()), bands.take(take), pa.array(small, pa.list_(pa.int64()))]
                + [pa.array(planes[s], pa.int64()).take(take) for s in _WORDS],
                names=["doc_id", "n_shingles", "digest", "bands", "small", *_WORDS],
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, n, h, r in _sets(batch.column("text")):
            cut = np.searchsorted(r, np.arange(n + 1))
            sets = [h[cut[k] : cut[k + 1]].tobytes() for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, n), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], names=["a", "b"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column("shingles")]
        row = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
        grams = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
        yield pa.RecordBatch.from_arrays([batch.column("node").take(row), batch.column("label").take(row), grams], names=["node", "label", "gram"])


def cores(sets: DataFrame) -> DataFrame:
    """node, core: for each of `sets` (node, label, shingles), how many of its shingles other labels have too, in PARTS parts by hash.

    Two sets of different labels share at most the sum of the lesser counts of each part; what only one label has counts for
    none. Sets without such a shingle have no row.
    """
    grams = sets.select("node", "label", "shingles").mapInArrow(_spread, "node long, label long, gram long")
    across = grams.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("gram")
    n = grams.join(across, "gram").groupBy("node", F.pmod("gram", F.lit(PARTS)).cast("int").alias("part")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    n = n.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("n"))
    return n.select("node", F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.coalesce(F.try_element_at("n", i), F.lit(0))).alias("core"))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda n, k: n + k)


def estimate(x: str, y: str) -> Column:
    """Similarity from the kept bits of two signatures: equal slots by bit counts, less chance collisions."""
    n = SLOTS // 64
    differ = [
        F.bit_count(reduce(Column.bitwiseOR, (F.col(f"{x}.s{b * n + k}").bitwiseXOR(F.col(f"{y}.s{b * n + k}")) for b in range(BITS))))
        for k in range(n)
    ]
    chance = 2.0**-BITS
    return (1 - sum(differ) / SLOTS - chance) / (1 - chance)


def possible(x: str, y: str, percent: int, min_estimate: float) -> Column:
    """Whether the sets of two sketches can be similar enough: exact on sizes and between small sets, else by the estimate."""
    least, most = F.least(f"{x}.n_shingles", f"{y}.n_shingles"), F.greatest(f"{x}.n_shingles", f"{y}.n_shingles")
    both = F.size(F.array_intersect(f"{x}.small", f"{y}.small"))
    exact = 100 * both >= percent * (least + most - both)
    small = F.col(f"{x}.small").isNotNull() & F.col(f"{y}.small").isNotNull()
    return (100 * least >= percent * most) & F.when(small, exact).otherwise(estimate(x, y) >= min_estimate)


def _full_sets(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """`nodes` (node, others) with the full sets of these documents, which only now are shingled again."""
    sets = docs.join(nodes, F.col("doc_id") == F.col("node")).select("node", "text").mapInArrow(_shingle_sets, _SETS)
    return materialize(sets, "sets")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough; each carries two sets to one task, never a group."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return materialize(pairs.select("a", "b").join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(lambda t: _linked(t, percent), "a long, b long"), "links")


def _labelled(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    c = comp.select(F.col("node").alias("_n"), "root")
    return nodes.join(c, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("root", "node")).drop("_n", "root")


def near_duplicates(docs: DataFrame, percent: int = MIN_PERCENT, min_estimate: float = MIN_ESTIMATE) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept: one row per row of `docs` (doc_id, text; others play no part).

    Documents of equal sets form a class, named by its smallest doc_id; classes are linked from `percent` similarity on.
    Null and empty texts have empty sets and are linked with nothing. Rows that repeat a doc_id count as one node, so
    their sets' classes meet. Null doc_ids link with nothing and are not kept. An empty table gives an empty result.

    1. One pass signs every text; only fixed-size signatures go on, and one per class to the bands.
    2. In each bucket of a band, every class pairs with one pivot, so pairs grow with the bucket, not its square.
    3. Pairs that the signatures do not rule out are confirmed on the full sets; the links give first components.
    4. Buckets that still hold several components pair what is outside the largest with all the rest, so that no link
       between components is lost. Only pairs go on whose shingles in common with other components, counted exactly,
       suffice for a link; those are confirmed as well.
    """
    W.bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = materialize(docs.mapInArrow(lambda t: _sign(t, BANDS[percent]), _SIGNED), "signed")
    usable = signed.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    best = F.min_by(F.struct("bands", "n_shingles", "small", *_WORDS), "doc_id").alias("best")
    classes = materialize(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), best), "classes")
    sketch = classes.select("node", F.struct(*[F.col(f"best.{s}").alias(s) for s in _WORDS], "best.bands", "best.n_shingles", "best.small").alias("sketch"))
    banded = classes.select("node", F.explode("best.bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(banded.join(sizes, "key"), "shared")
    # The pivot is the member that meets most others over all bands: the text that the others of a group are copies of.
    meets = shared.groupBy("node").agg(F.sum(F.col("n") - 1).alias("meets"))
    pick = shared.join(meets, "node").groupBy("key").agg(F.max_by("node", F.struct("meets", "node")).alias("pivot"))
    members = materialize(shared.join(pick, "key").select("key", "node", "pivot"), "members")

    def estimated(pairs: DataFrame) -> DataFrame:
        x = sketch.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
        y = sketch.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
        return pairs.join(y, "b").join(x, "a").where(possible("x", "y", percent, min_estimate)).select("a", "b")

    stars = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = materialize(estimated(stars), "stars")
    ends = materialize(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    links = _confirm(stars, _full_sets(ends, docs), percent)
    comp = components(links)
    label = materialize(_labelled(members.select("node").distinct(), comp), "labels")
    with_label = members.select("key", "node").join(label, "node")
    sizes = with_label.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    open_ = materialize(with_label.join(main.where("labels > 1"), "key"), "open")
    outside = open_.where("label != main").select("key", F.col("node").alias("a"), F.col("label").alias("la"))
    inside = open_.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), "main")
    sets = _full_sets(materialize(open_.select("node").distinct(), "nodes"), docs)
    # A set that shares too little with all other components together has no link to any of them.
    core = cores(sets.join(label, "node")).join(sketch, "node").withColumn("n", _total(F.col("core")))
    core = materialize(core.where(100 * F.col("n") >= percent * F.col("sketch.n_shingles")), "cores")
    carried = lambda t, c, s: t.join(core.select(F.col("node").alias("_n"), F.struct("sketch.*", "core", F.col("n").alias("total")).alias(s)), F.col(c) == F.col("_n")).drop("_n")
    x, y = carried(outside, "a", "x"), carried(inside, "b", "y")
    apart = (F.col("la") != F.col("lb")) & ((F.col("lb") == F.col("main")) | (F.col("a") < F.col("b")))
    # A pair that shares several buckets comes from the first of them only.
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == x["key"]
    enough = lambda most: (100 + percent) * most >= percent * (F.col("x.n_shingles") + F.col("y.n_shingles"))
    shared = _total(F.zip_with("x.core", "y.core", lambda i, j: F.least(i, j)))
    late = x.join(y, (x["key"] == y["key"]) & apart & enough(F.least("x.total", "y.total")) & possible("x", "y", percent, min_estimate) & once & enough(shared)).select("a", "b")
    seen = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    late = late.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    late = materialize(late.join(seen, ["a", "b"], "left_anti"), "late")
    links = links.unionByName(_confirm(late, sets, percent))
    comp = components(links)
    named = classes.select(F.col("digest").alias("_d"), "node")
    named = _labelled(named, comp).withColumnsRenamed({"node": "class_id", "label": "component_id"})
    out = signed.select("doc_id", "n_shingles", "digest").join(named, F.col("digest") == F.col("_d"), "left")
    known = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        known.alias("component_id"),
        F.coalesce(F.col("doc_id") == known, F.lit(False)).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each group of near duplicates, the document of the smallest doc_id stays (null: last).

    Documents are named by a 64-bit hash of doc_id and text, so rows of a null or repeated doc_id go only as near copies of
    another, and no copy of the texts is written. Of rows that are equal in both, one stays. Null and empty texts stay; an
    empty table gives an empty one; other columns pass through, whatever their names.
    """
    (h,) = W.free(docs.columns, "_h")
    rows = docs.withColumn(h, F.xxhash64("doc_id", "text"))
    near = near_duplicates(rows.select(F.col(h).alias("doc_id"), "text"), STAGE_PERCENT, STAGE_ESTIMATE)
    near = near.select(F.col("doc_id").alias("_near"), "component_id").distinct()
    ids = materialize(rows.groupBy(h).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "names")
    first = F.min_by(h, F.struct(F.col("doc_id").isNull(), "doc_id", h)).alias(h)
    kept = ids.join(near, F.col(h) == F.col("_near")).groupBy("component_id").agg(first).select(h)
    kept = materialize(kept, "kept")
    again = ids.where("n > 1").select(h).join(kept, h, "left_semi")
    if again.isEmpty():
        return rows.join(kept, h, "left_semi").select(*docs.columns)
    # Equal rows, one for each name, are picked where they are before anything travels.
    one = rows.join(again, h, "left_semi").groupBy(h).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_r"))
    single = rows.join(kept, h, "left_semi").join(again, h, "left_anti").select(*docs.columns)
    return single.unionByName(one.select("_r.*"))
