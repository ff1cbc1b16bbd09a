"""Exact similarity join of word n-gram sets: pairs of frequent prefixes for small sets, inverted lists for large ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.components import components
from paperloom.session import discard, materialize

NGRAM_WORDS, MIN_PERCENT = 4, 85
#: Slots, by hash, of the levels of frequent n-grams: these bytes are sent to all tasks, whatever the input. At most an eighth
#: is taken, so what counts as frequent rises with the input, from MIN_FREQUENT texts on. Levels only give the order of
#: n-grams, rarest first; a clash of hashes costs time, never a link.
SLOTS, SLOT_BLOCK, MIN_FREQUENT = 1 << 23, 1 << 13, 4
#: Documents a part of the n-grams' hashes, in which these are counted, and hashes that a task gathers before it parts them.
PART_DOCS, GATHERED = 1000, 1 << 21
#: Size classes of sets in an octave, between which the boundary of small and large sets is chosen.
PER_OCTAVE = 8
#: Rows of a pair that a place in a list costs as much as.
LIST_ROWS = 2
#: Keys of up to this many members have no pivots.
SMALL_KEY = 16
#: Pairs that one node's set meets in one task.
SHARE = 2000

_SIGNED = "doc_id long, n_shingles long, digest binary, part long, grams binary"
_FREQUENT = "slot long, n long"
_LEVELS = "block long, levels binary"
_PREFIX = "doc_id long, digest binary, size long, prefix array<long>"
_SETS = "node long, shingles binary"


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice of rows: first row, number of rows, distinct n-gram hashes, their rows, and each row's first of them."""
    data, offsets = W.utf8(texts)
    for i, j in W.slices(offsets):
        starts, ends, rows = W.spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        h, r = W.shingles(W.hashes(data[offsets[i] : offsets[j]], starts, ends), rows, j - i, NGRAM_WORDS)
        yield i, j - i, h, r, np.searchsorted(r, np.arange(j - i + 1))


def _digests(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits of each row's set; None for the empty set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(W.mix(h + np.uint64(k + 1)), dtype=np.uint64)]) for k in range(2)]
    both = np.stack([s[first[1:]] - s[first[:-1]] for s in sums], 1)
    return [both[k].tobytes() if first[k + 1] > first[k] else None for k in range(len(both))]


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _slot(part, h: np.ndarray) -> np.ndarray:
    """The slot of n-grams by part and low 32 bits of hashes, all that is known of them where they are counted."""
    return (W.mix((part << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))) % np.uint64(SLOTS)).astype(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and now and then one for each part of the hashes of n-grams, with the hashes seen in it."""
    names, kept = [f.split(" ")[0] for f in _SIGNED.split(", ")], []

    def parted() -> pa.RecordBatch:
        h = np.sort(np.concatenate([np.zeros(0, np.uint64), *kept]))
        part = _part(h, parts)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])[: len(h)])
        some = part[first].astype(np.int64)
        blobs = [b.tobytes() for b in np.split(h.astype(np.uint32), first[1:])][: len(some)]
        none = [pa.nulls(len(some), t) for t in (pa.int64(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(some), pa.array(blobs, pa.binary())], names=names)

    for batch in batches:
        for i, n, h, _, first in _sets(batch.column("text")):
            none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, n), pa.array(np.diff(first)), pa.array(_digests(h, first), pa.binary()), *none], names=names)
            kept.append(h)
            if sum(map(len, kept)) > GATHERED:
                yield parted()
                kept.clear()
    yield parted()


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots and counts of the n-grams of one part that lie in MIN_FREQUENT texts or more."""
    blobs, part = [], 0
    for batch in batches:
        part = batch.column("part")[0].as_py()
        blobs += [np.frombuffer(b.as_buffer(), np.uint32) for b in batch.column("grams")]
    h, n = np.unique(np.concatenate(blobs), return_counts=True)
    often = n >= MIN_FREQUENT
    yield pa.RecordBatch.from_arrays([pa.array(_slot(np.uint64(part), h[often].astype(np.uint64))), pa.array(n[often])], names=["slot", "n"])


def _level_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, block = np.zeros(SLOT_BLOCK, np.uint8), 0
    for batch in batches:
        slot = batch.column("slot").to_numpy()
        block = int(slot[0]) // SLOT_BLOCK
        out[slot % SLOT_BLOCK] = batch.column("level").to_numpy()
    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([out.tobytes()], pa.binary())], names=["block", "levels"])


def levels(signed: DataFrame) -> np.ndarray:
    """For each slot, 0 or the binary logarithm of how many texts hold the most frequent n-gram in it, where it is frequent."""
    parts = signed.where(F.col("part").isNotNull()).select("part", "grams")
    found = materialize(parts.groupBy("part").applyInArrow(_frequent, _FREQUENT), "frequent")
    log = F.floor(F.log2("n"))
    least, room = 64, SLOTS // 8
    for r in sorted(found.groupBy(log.alias("log")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        room -= r["n"]
        least = r["log"] if room >= 0 else least
    top = found.where(log >= least).groupBy("slot").agg(F.max(log).cast("int").alias("level"))
    blocks = top.groupBy(F.expr(f"slot div {SLOT_BLOCK}").alias("block")).applyInArrow(_level_block, _LEVELS)
    out = np.zeros(SLOTS, np.uint8)
    for r in blocks.collect():
        out[r["block"] * SLOT_BLOCK :][:SLOT_BLOCK] = np.frombuffer(r["levels"], np.uint8)
    return out


def need(n, percent: int):
    """Least overlap of a set of size n with any that is similar enough."""
    return -(-percent * n // 100)


def _prefixes(batches: Iterator[pa.RecordBatch], level: Broadcast, parts: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The n-grams of each set, rarest first, up to the one that must be its second common one with a similar set."""
    for batch in batches:
        for i, n, h, r, first in _sets(batch.column("text")):
            order = np.lexsort((h, level.value[_slot(_part(h, parts), h)], r))
            size = np.diff(first)
            length = np.minimum(size, size - need(size, percent) + 2)
            taken = h[order][np.arange(len(h)) - first[r] < length[r]].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(taken))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, n), pa.array(_digests(h, first), pa.binary()), pa.array(size), lists], names=["doc_id", "digest", "size", "prefix"]
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, n, h, _, first in _sets(batch.column("text")):
            sets = [h[first[k] : first[k + 1]].tobytes() for k in range(n)]
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, n), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])


def joined(pairs: DataFrame, end: str, values: DataFrame) -> DataFrame:
    """`pairs` with the columns of `values` (node, others) for the node in their column `end`.

    The values of a node with many pairs are copied to as many shares as its pairs need, so no node is a hot key.
    """
    hot = pairs.groupBy(F.col(end).alias("_n")).agg(F.expr(f"count(*) div {SHARE} + 1").alias("_k")).where("_k > 1")
    hot = materialize(hot, "hot")
    if hot.isEmpty():
        return pairs.join(values, F.col(end) == F.col("node")).drop("node")
    p = pairs.join(hot, F.col(end) == F.col("_n"), "left").withColumn("_s", F.coalesce(F.pmod(F.xxhash64("a", "b"), "_k"), F.lit(0))).drop("_n", "_k")
    v = values.join(hot, F.col("node") == F.col("_n"), "left").withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_k", F.lit(1)) - 1)))
    v = v.drop("_n", "_k").withColumnRenamed("node", "_m")
    return p.join(v, (F.col(end) == F.col("_m")) & (F.col("_s") == F.col("_t"))).drop("_m", "_s", "_t")


def possible(x: Column, y: Column, percent: int) -> Column:
    """Whether sets with such sizes and prefixes can be similar enough.

    A prefix holds all of its set up to its last n-gram in the common order. What both sets have up to the lesser of the two
    last n-grams is in both prefixes; beyond it, the set of that prefix has no more than its rest.
    """
    sizes = 100 * F.least(x["size"], y["size"]) >= percent * F.greatest(x["size"], y["size"])
    shared = F.size(F.array_intersect(x["prefix"], y["prefix"]))
    rest = F.greatest(x["size"] - F.size(x["prefix"]), y["size"] - F.size(y["prefix"]))
    return sizes & ((100 + percent) * (shared + rest) >= percent * (x["size"] + y["size"]))


def boundary(postings: DataFrame, percent: int) -> int:
    """The greatest size of a small set: where pairs of prefix n-grams cost no more than reading lists, over all sets.

    `postings`: node, size, at (place in the prefix). A pair costs a row; a place in a list costs LIST_ROWS, as lists hold
    more sets that turn out unlike. Costs are summed by classes of sizes, of which there are PER_OCTAVE for each doubling,
    so these few rows may pass through the driver.
    """
    last = F.col("at") == F.col("size") - need_column(percent) + 1
    per = postings.groupBy("node", "size").agg(F.count(F.lit(1)).alias("m"), F.sum(F.when(~last, F.lit(LIST_ROWS))).alias("scan"))
    kind = F.floor(F.log2("size") * PER_OCTAVE)
    rows = per.groupBy(kind.alias("kind")).agg(F.max("size").alias("most"), F.sum(F.expr("m * (m - 1) div 2")).alias("pairs"), F.sum("scan").alias("scan"))
    found = sorted((r["kind"], r["most"], r["pairs"] or 0, r["scan"] or 0) for r in rows.collect())
    costs = [(sum(r[2] for r in found[:k]) + sum(r[3] for r in found[k:]), k) for k in range(len(found) + 1)]
    _, k = min(costs)
    return found[k - 1][1] if k else 0


def need_column(percent: int) -> Column:
    return F.ceil(F.col("size") * percent / 100)


def keys(prefixes: DataFrame, percent: int) -> DataFrame:
    """key, node, size, left: every two sets (node, size, prefix) that can be similar enough share a key that `fits` them.

    Similar sets share two n-grams at least within their prefixes (one, if the last place is left out). Small sets give a
    key for each pair of prefix n-grams, large ones read the list of each single n-gram; small ones that are large enough
    to be similar to a large one enter these lists too. N-grams that lie in one prefix only are left out before. `left` is
    the most that the set can share with another whose first common n-grams are the key's.
    """
    posted = prefixes.select("node", "size", F.posexplode("prefix").alias("at", "gram"))
    lists = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    postings = materialize(posted.join(lists, "gram"), "postings")
    most = boundary(postings, percent)
    large = postings.where((100 * F.col("size") >= percent * (most + 1)) & (F.col("at") <= F.col("size") - need_column(percent)))
    large = large.select(F.col("gram").alias("key"), "node", "size", (F.col("size") - F.col("at")).alias("left"))
    small = postings.where(F.col("size") <= most).groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("gram", "at"))).alias("g"))
    pair = lambda x, y: F.struct(F.xxhash64(x["gram"], y["gram"]).alias("key"), F.greatest(x["at"], y["at"]).alias("at"))
    both = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda y: pair(x, y))))
    small = small.where(F.size("g") > 1).select("node", "size", F.explode(both).alias("p"))
    return small.select("p.key", "node", "size", (F.col("size") - F.col("p.at") + 1).alias("left")).unionByName(large)


def fits(percent: int) -> Column:
    """Whether two members of a key, of columns size, left and size_b, left_b, can be similar if it holds their first common n-grams."""
    sizes = 100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b")
    return sizes & ((100 + percent) * F.least("left", "left_b") >= percent * (F.col("size") + F.col("size_b")))


def _labelled(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    c = comp.select(F.col("node").alias("_n"), "root")
    return nodes.join(c, F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("root", "node")).drop("_n", "root")


def similar(docs: DataFrame, percent: int = MIN_PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id: one row per row of `docs` (doc_id, text; others play no part).

    The set of a document is its distinct runs of four words, or its whole sequence of fewer words. Documents of equal sets
    form a class, named by its smallest doc_id; sets are linked from `percent` similarity on (over 50). component_id is
    the smallest doc_id that can be reached. Null and empty texts have empty sets and are linked with nothing. Rows that
    repeat a doc_id are one document, so the classes of their sets meet; null doc_ids link with nothing, and have no
    component. An empty table gives an empty result. Sets are compared by 64-bit hashes of their n-grams, classes by 128 bits.

    All that can be linked shares a key (see `keys`). Each set first meets one pivot of its largest key only; then, in keys
    of many members that still lie in several components, these meet a second one; pairs of what is left in different
    components come last, so no link between components is lost and pairs of a group of copies do not grow with its square.
    A pair goes on only where sizes and prefixes allow a link, and counts only once the full sets are compared.
    """
    if percent <= 50:
        raise ValueError("sets that are half equal or less need share no two n-grams")
    spark = docs.sparkSession
    W.bound_batches(spark)
    docs = docs.select("doc_id", "text")
    parts = docs.count() // PART_DOCS + 1
    both = materialize(docs.mapInArrow(lambda t: _sign(t, parts), _SIGNED), "grams")
    sent = spark.sparkContext.broadcast(levels(both))
    signed = materialize(both.where(F.col("part").isNull()).select("doc_id", "n_shingles", "digest"), "signed")
    discard(both)
    usable = signed.where(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = materialize(usable.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    prefixes = docs.where(F.col("doc_id").isNotNull()).mapInArrow(lambda t: _prefixes(t, sent, parts, percent), _PREFIX)
    rep = classes.select(F.col("node").alias("doc_id"), "digest")
    prefixes = materialize(prefixes.where("size > 1").join(rep, ["doc_id", "digest"], "left_semi").select(F.col("doc_id").alias("node"), "size", "prefix"), "prefixes")
    found = keys(prefixes, percent)
    sizes = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(found.join(sizes, "key").select("key", "node", "size", "left", "n"), "members")
    sketch = prefixes.select("node", F.struct("size", "prefix").alias("p"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The linked ones of pairs (a, b); only texts of pairs that sizes and prefixes allow travel."""
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        pairs = joined(joined(pairs, "b", sketch.withColumnRenamed("p", "q")), "a", sketch)
        pairs = materialize(pairs.where(possible(F.col("p"), F.col("q"), percent)).select("a", "b").distinct(), "possible")
        if pairs.isEmpty():
            return pairs
        ends = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
        sets = docs.join(ends, F.col("doc_id") == F.col("node")).select("node", "text").mapInArrow(_shingle_sets, _SETS)
        sets = materialize(sets, "sets")
        pairs = joined(joined(pairs, "b", sets.withColumnRenamed("shingles", "y")), "a", sets.withColumnRenamed("shingles", "x"))
        return materialize(pairs.mapInArrow(lambda t: _linked(t, percent), "a long, b long").distinct(), "links")

    # The pivot is the member that meets most others over all keys: the text that the others of a group are copies of.
    many = members.where(F.col("n") > SMALL_KEY)
    nodes = materialize(members.groupBy("node").agg(F.sum("n").alias("meets")), "nodes")
    met = many.join(nodes, "node")
    pick = met.groupBy("key").agg(F.max_by(F.struct("node", "size", "left"), F.struct("meets", "node")).alias("p"))
    pick = pick.select("key", F.col("p.node").alias("a"), F.col("p.size").alias("size_b"), F.col("p.left").alias("left_b"))
    largest = many.groupBy("node").agg(F.max_by(F.struct("key", "size", "left"), F.struct("n", "key")).alias("k")).select("node", "k.*")
    links = confirmed(largest.join(pick, "key").where((F.col("node") != F.col("a")) & fits(percent)).select("a", F.col("node").alias("b")))
    for last in (False, True):
        label = materialize(_labelled(nodes, components(links)), "labels")
        labelled = (members if last else many).drop("n").join(label, "node")
        n = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
        main = n.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
        apart = materialize(labelled.join(main.where("labels > 1"), "key"), "apart")
        x = apart.where("label != main").select("key", F.col("node").alias("a"), F.col("label").alias("la"), "meets", "size", "left")
        y = apart.select("key", F.col("node").alias("b"), F.col("label").alias("lb"), "main", F.col("size").alias("size_b"), F.col("left").alias("left_b"))
        if last:
            # Of two nodes outside of the main component, the lesser comes from this side.
            pairs = x.join(y, "key").where(F.expr("la != lb AND (lb = main OR a < b)") & fits(percent))
        else:
            x = x.groupBy("key").agg(F.max_by(F.struct("a", "la", "size", "left"), F.struct("meets", "a")).alias("p")).select("key", "p.*")
            pairs = x.join(y, "key").where((F.col("la") != F.col("lb")) & fits(percent))
        links = links.unionByName(confirmed(pairs.select("a", "b")))
    named = materialize(usable.join(classes, "digest").select("doc_id", "node").distinct(), "named")
    least = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("m")).where("a != m")
    links = links.unionByName(named.join(least, "doc_id").where("a != node").select("a", F.col("node").alias("b")).distinct())
    known = _labelled(classes.select(F.col("digest").alias("_d"), "node"), components(links))
    out = signed.join(known, F.col("digest") == F.col("_d"), "left")
    some = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return out.select("doc_id", "n_shingles", some("node").alias("class_id"), some("label").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("class_id")
