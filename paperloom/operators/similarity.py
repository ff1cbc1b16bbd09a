"""Similarity of documents, sentences, titles and images, against each other and against per-category baselines."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import hashing as H
from paperloom.functions import text as T
from paperloom.session import materialize

SHINGLE = 4
SENTENCE_JACCARD, IMAGE_BITS, BASE_THRESHOLD, MIN_SENTENCES, MIN_SPREAD = 0.55, 6, 0.22, 3, 0.08
#: Most blocks of a hash that make a key together.
MOST_BLOCKS = 4


def shingles(key: Column, size: int = SHINGLE) -> Column:
    """64-bit hashes of the distinct runs of `size` words of a comparison key."""
    runs = lambda w: F.when(
        F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
    ).otherwise(F.array().cast("array<long>"))
    # The array of words is bound once.
    return F.array_distinct(F.element_at(F.transform(F.array(F.split(key, " ")), runs), 1))


def overlap_with(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """item_id, doc_id, shared, containment, jaccard of every passage and document that share a shingle.

    docs: doc_id, key; passages: item_id, key. Shingles are numbers before they are dealt out; of a document's only those
    travel that some passage has. Pairs are counted with a pre-aggregation. Passages are a stated query set; pairs grow
    with true overlaps only.
    """
    d = docs.select("doc_id", shingles(F.col("key")).alias("s")).select("doc_id", "s", F.size("s").alias("nd"))
    p = passages.select("item_id", shingles(F.col("key")).alias("s")).select("item_id", "s", F.size("s").alias("np"))
    left, right = d.select("doc_id", "nd", F.explode("s").alias("g")), p.select("item_id", "np", F.explode("s").alias("g"))
    left = left.join(right.select("g").distinct(), "g", "left_semi")
    both = left.join(right, "g").groupBy("item_id", "doc_id", "np", "nd").agg(F.count(F.lit(1)).alias("shared"))
    return both.select("item_id", "doc_id", "shared", (F.col("shared") / F.least("np", "nd")).alias("containment"), (F.col("shared") / (F.col("np") + F.col("nd") - F.col("shared"))).alias("jaccard"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, category, key) as doc_id, category, n_shingles, signature; empty documents have no fingerprint.

    Written once: pairs and thresholds read fingerprints several times, and none of them may sign texts again.
    """
    return materialize(H.sign(docs.select("doc_id", "category", "key"), "key", SHINGLE).where("n_shingles > 0"), "fingerprints")


def classes(prints: DataFrame) -> DataFrame:
    """doc_id, category, class_id (the smallest doc_id of the category with the same signature), copies (of the class)."""
    c = prints.groupBy("category", "signature").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return prints.join(c, ["category", "signature"]).select("doc_id", "category", "class_id", "copies")


#: Classes of a block at most, more or less, and pairs of equal slots that a task has in hand at once.
BLOCK, IN_HAND = 1 << 15, 1 << 22
_PAIR = "category string, a long, b long, agree long, na int, nb int, ca long, cb long"


def _agreeing(x: np.ndarray, y: np.ndarray, at_least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i of `x` and j of `y` (signatures) that agree in `at_least` slots, and in how many; rows i ascend, each in one part."""
    first, many, order = (np.empty((len(z), H.SLOTS), np.int32) for z in (x, x, y))
    for s in range(H.SLOTS):
        order[:, s] = o = np.argsort(y[:, s])
        first[:, s] = np.searchsorted(y[o, s], x[:, s])
        many[:, s] = np.searchsorted(y[o, s], x[:, s], "right") - first[:, s]
    rows = np.flatnonzero((many > 0).sum(axis=1) >= at_least)
    cost = np.cumsum(many[rows].sum(axis=1, dtype=np.int64) + len(y) // 8)
    begin = 0
    while begin < len(rows):
        end = max(begin + 1, int(np.searchsorted(cost, (cost[begin - 1] if begin else 0) + IN_HAND)))
        row = rows[begin:end]
        i, s = np.nonzero(many[row])
        n, at = many[row][i, s], first[row][i, s]
        up = np.cumsum(n, dtype=np.int64)
        at = np.repeat(at - (up - n), n) + np.arange(up[-1])
        key = np.repeat(i * len(y), n) + order[at, np.repeat(s, n)]
        if len(key) * 32 > len(row) * len(y):
            count = np.bincount(key, minlength=len(row) * len(y))
            key = np.flatnonzero(count >= at_least)
            count = count[key]
        else:
            key, count = np.unique(key, return_counts=True)
            key, count = key[count >= at_least], count[count >= at_least]
        yield row[key // len(y)], key % len(y), count
        begin = end


def _best(i: np.ndarray, score: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores of each i (which ascend), ties to the smaller `other`."""
    left, keep = score.copy(), np.zeros(len(i), bool)
    begin = np.flatnonzero(np.diff(i, prepend=-1))
    n = np.diff(np.append(begin, len(i)))
    for _ in range(k):
        hit = (left == np.repeat(np.maximum.reduceat(left, begin), n)) & ~keep
        keep |= hit
        left[hit] = -1
    at = np.flatnonzero(keep)
    at = at[np.lexsort((other[at], -score[at], i[at]))]
    begin = np.flatnonzero(np.diff(i[at], prepend=-1))
    return at[np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at)))) < k]


def _meet(group: pa.Table, at_least: int, best: int | None) -> Iterator[pa.RecordBatch]:
    """The pairs of classes of two blocks of one category, see `signature_pairs`."""
    block, doc, n, copies = (group[c].combine_chunks().to_numpy() for c in ("block", "doc_id", "n_shingles", "copies"))
    least = float(group["least"][0].as_py())
    signs = group["signature"].combine_chunks().flatten().to_numpy().reshape(-1, H.SLOTS)
    halves = [np.flatnonzero(block == v) for v in np.unique(block)]
    one, other = halves[0], halves[-1]
    if len(halves) == 1 and group["u"][0].as_py() != group["v"][0].as_py():
        return  # The other block is empty.
    found = []
    for x, y in [(one, other)] if best is None or len(halves) == 1 else [(one, other), (other, one)]:
        for i, j, agree in _agreeing(signs[x], signs[y], at_least):
            i, j = x[i], y[j]
            keep = doc[i] != doc[j] if best is not None else (doc[i] < doc[j] if len(halves) == 1 else np.ones(len(i), bool))
            i, j, agree = i[keep], j[keep], agree[keep]
            if len(i) and (best is not None or least > 0):
                jaccard, small = agree / H.SLOTS, np.minimum(n[i], n[j])
                coverage = np.minimum(1.0, jaccard * (n[i] + n[j]) / (1 + jaccard) / small)
                keep = coverage >= least if best is None else _best(i, np.maximum(coverage, jaccard), doc[j], best)
                i, j, agree = i[keep], j[keep], agree[keep]
            i, j = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
            if best is None:
                yield _pairs(group, doc, n, copies, i, j, agree)
            else:
                found.append((i, j, agree))
    if found:
        i, j, agree = (np.concatenate(c) for c in zip(*found, strict=True))
        _, once = np.unique(i * len(doc) + j, return_index=True)
        yield _pairs(group, doc, n, copies, i[once], j[once], agree[once])


def _pairs(group: pa.Table, doc: np.ndarray, n: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
    category = group["category"].combine_chunks().slice(0, 1).take(pa.array(np.zeros(len(i), np.int32)))
    columns = [category, *(pa.array(c) for c in (doc[i], doc[j], agree.astype(np.int64), n[i], n[j], copies[i], copies[j]))]
    return pa.RecordBatch.from_arrays(columns, names=["category", "a", "b", "agree", "na", "nb", "ca", "cb"])


def signature_pairs(prints: DataFrame, at_least: int = 1, least: DataFrame | None = None, best: int | None = None) -> DataFrame:
    """Pairs a <= b of classes of one category that agree in `at_least` slots: agree, jaccard, coverage (containment from
    it), and n_pairs, the pairs of documents that a row stands for.

    Documents of equal signatures form a class, see `classes`, which tells the members; a class of several documents is a
    pair with itself. The classes of a category are dealt to blocks of BLOCK, and every two blocks meet in one task, which
    counts the slots that two classes share: no pair travels but those that are asked for.
    least: category, threshold; of its categories alone, the pairs of that coverage. best: only pairs that are, by the
    larger of coverage and jaccard, among the `best` of one of their classes in the other's block, so that `nearest` finds
    all it looks for; classes are no pairs with themselves then.
    """
    c = prints.where("category IS NOT NULL").groupBy("category", "signature")
    c = c.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"))
    c = c if least is None else c.join(least.select("category", F.col("threshold").alias("least")), "category")
    c = materialize(c if least is not None else c.withColumn("least", F.lit(0.0)), "classes")
    size = c.groupBy("category").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = c.join(size, "category").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    meets = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("category", F.least("block", "with").alias("u"), F.greatest("block", "with").alias("v"), "block", F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", "copies", "least", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _meet(pa.Table.from_batches(list(batches)), at_least, best)

    n = meets.groupBy("category", "u", "v").applyInArrow(run, _PAIR)
    if best is None:
        own = c.where("copies > 1 AND least <= 1").select("category", F.col("doc_id").cast("long").alias("a"), F.col("doc_id").cast("long").alias("b"), F.lit(H.SLOTS).cast("long").alias("agree"), F.col("n_shingles").alias("na"), F.col("n_shingles").alias("nb"), F.col("copies").alias("ca"), F.col("copies").alias("cb"))
        n = n.unionByName(own)
    j = F.col("agree") / H.SLOTS
    weight = F.when(F.col("a") == F.col("b"), F.col("ca") * (F.col("ca") - 1) / 2).otherwise(F.col("ca") * F.col("cb")).cast("long")
    return n.select("category", "a", "b", "agree", j.alias("jaccard"), H.containment(j, F.col("na"), F.col("nb")).alias("coverage"), weight.alias("n_pairs"))


def nearest(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The `k` nearest other classes of each class (thresholds don't count): doc_id, place, other, score."""
    both = pairs.where("a <> b").select(F.greatest("coverage", "jaccard").alias("score"), F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("doc_id"), F.col("a").alias("other")))).alias("p"))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "other")
    return both.select("p.*", "score").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def thresholds(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per category: n_pairs, median and MAD of coverage over all pairs, and the threshold max(.22, median + max(3 MAD, .08)).

    pairs (n_pairs: how many pairs of documents a row stands for) holds only those above zero; sizes (category, n
    documents) tells how many there are in all. Zeros are never made:
    ranks are shifted by their number. For the MAD, each zero stands for one deviation of the size of the median.
    """
    total = sizes.select("category", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n_pairs"))
    some = pairs.groupBy("category").agg(F.sum("n_pairs").alias("nz"))
    t = total.join(some, "category", "left").fillna(0, ["nz"]).withColumn("zeros", F.col("n_pairs") - F.col("nz"))

    def middle(values: DataFrame, zero_at: Column | None) -> DataFrame:
        """Median per category of `v` in values with weight `w` (rows of equal value count w times)."""
        w = Window.partitionBy("category").orderBy("v")
        run = values.groupBy("category", "v").agg(F.sum("w").alias("w")).withColumn("upto", F.sum("w").over(w))
        lo, hi = F.floor((F.col("n_pairs") + 1) / 2), F.floor((F.col("n_pairs") + 2) / 2)
        at = run.join(total, "category").withColumn("lo", lo).withColumn("hi", hi)
        pick = lambda r: F.min(F.when(F.col("upto") >= F.col(r), F.col("v")))
        return at.groupBy("category").agg(((pick("lo") + pick("hi")) / 2).alias("m"))

    zeros = t.select("category", F.lit(0.0).alias("v"), F.col("zeros").alias("w")).where("w > 0")
    values = pairs.select("category", F.col("coverage").alias("v"), F.col("n_pairs").alias("w")).unionByName(zeros)
    med = middle(values, None).withColumnRenamed("m", "median")
    gaps = values.join(med, "category").select("category", F.abs(F.col("v") - F.col("median")).alias("v"), "w")
    mad = middle(gaps, None).withColumnRenamed("m", "mad")
    limit = F.greatest(F.lit(BASE_THRESHOLD), F.col("median") + F.greatest(3 * F.col("mad"), F.lit(MIN_SPREAD)))
    return total.join(med, "category").join(mad, "category").withColumn("threshold", limit)


#: Parts that the values of a slot fall into where pairs of equal ones are only bounded.
PARTS = 1 << 12


def limits(prints: DataFrame) -> DataFrame:
    """category, threshold as in `thresholds`, of fingerprints.

    Where less than half of a category's pairs can agree in any slot, median and MAD are zero and no pair is made. That is
    bounded by the pairs of different classes with values in the same part of a slot; the pairs of the other categories
    are counted.
    """
    c = prints.where("category IS NOT NULL").groupBy("category", "signature").agg(F.count(F.lit(1)).alias("copies"))
    own = c.groupBy("category").agg(F.sum("copies").alias("n"), F.sum(F.expr("copies * (copies - 1) div 2")).alias("alike"))
    part = c.select("category", "copies", F.posexplode("signature").alias("slot", "value")).groupBy("category", "slot", F.col("value").bitwiseAND(F.lit(PARTS - 1)).alias("part"))
    part = part.agg(F.sum("copies").cast("double").alias("all"), F.sum(F.col("copies").cast("double") * F.col("copies")).alias("own"))
    bound = part.groupBy("category").agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2).alias("most"))
    every = F.col("n") * (F.col("n") - 1.0) / 2
    judged = own.join(bound, "category").select("category", "n", ((F.col("alike") + F.col("most")) * 2.000001 < every).alias("zero"))
    judged = materialize(judged, "bounds")
    doubt = judged.where("NOT zero")
    counted = thresholds(signature_pairs(prints.join(doubt.select("category"), "category", "left_semi")), doubt.select("category", "n"))
    plain = judged.where("zero").select("category", F.lit(max(BASE_THRESHOLD, MIN_SPREAD)).alias("threshold"))
    return materialize(counted.select("category", "threshold").unionByName(plain), "limits")


def sentence_matches(sentences: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sentence pairs of set similarity .55 or more, within candidate pairs (a, b) of documents only.

    sentences: doc_id, ord, s (array of shingles). Returns a, b, ord_a, ord_b, jaccard.
    """
    e = sentences.where(F.size("s") > 0).select("doc_id", "ord", F.size("s").alias("n"), F.explode("s").alias("g"))
    x = pairs.select("a", "b").join(e.select(F.col("doc_id").alias("a"), F.col("ord").alias("ord_a"), F.col("n").alias("na"), "g"), "a")
    y = e.select(F.col("doc_id").alias("b"), F.col("ord").alias("ord_b"), F.col("n").alias("nb"), "g")
    n = x.join(y, ["b", "g"]).groupBy("a", "b", "ord_a", "ord_b", "na", "nb").agg(F.count(F.lit(1)).alias("both"))
    return n.withColumn("jaccard", F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).where(F.col("jaccard") >= SENTENCE_JACCARD).drop("na", "nb", "both")


def block_masks(n: int) -> list[int]:
    """Parts of a 64-bit hash, as signed masks, one of which any two hashes within IMAGE_BITS bits have in common.

    Of IMAGE_BITS + m blocks, as many changed bits leave m alone, so every m of them are a part. The more hashes there are
    (`n`), the more bits a part has: m is what costs least, counting a row for each hash and part and one for each pair that
    meets by chance.
    """

    def cost(m: int) -> float:
        return math.comb(IMAGE_BITS + m, m) * (n + n * n / 2 ** (64 * m / (IMAGE_BITS + m)))

    m = min(range(1, MOST_BLOCKS + 1), key=cost)
    cut = [64 * i // (IMAGE_BITS + m) for i in range(IMAGE_BITS + m + 1)]
    blocks = [(1 << end) - (1 << at) for at, end in zip(cut, cut[1:], strict=False)]
    return [(mask ^ 1 << 63) - (1 << 63) for mask in map(sum, combinations(blocks, m))]


def image_matches(images: DataFrame) -> DataFrame:
    """Pairs of hashes (image_id, hash) within 6 of 64 bits: a, b, distance. Hashes that say nothing are left out.

    Equal hashes form a class, named by its smallest image; each other member is linked to it at distance 0, and classes
    a < b meet each other in the parts they have in common, see `block_masks`: no pair is left out.
    """
    good = materialize(images.select("image_id", "hash").where(H.informative(F.col("hash"))), "hashes")
    c = good.groupBy("hash").agg(F.min("image_id").alias("image_id"))
    copies = good.join(c.select("hash", F.col("image_id").alias("a")), "hash").where("image_id <> a").select("a", F.col("image_id").alias("b"), F.lit(0).alias("distance"))
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(c.count())])
    e = c.select("image_id", "hash", F.posexplode(masks).alias("part", "mask")).select("image_id", "hash", "part", F.col("hash").bitwiseAND(F.col("mask")).alias("bits"))
    x = e.select(F.col("image_id").alias("a"), F.col("hash").alias("ha"), "part", "bits")
    y = e.select(F.col("image_id").alias("b"), F.col("hash").alias("hb"), "part", "bits")
    near = (F.col("a") < F.col("b")) & (H.hamming(F.col("ha"), F.col("hb")) <= IMAGE_BITS)
    # A row for each part is made of a table that the planner knows as small: without the hint it sends them all to the driver.
    return x.join(y.hint("merge"), ["part", "bits"]).where(near).select("a", "b", H.hamming(F.col("ha"), F.col("hb")).alias("distance")).distinct().unionByName(copies)


def flag(pairs: DataFrame, limits: DataFrame) -> DataFrame:
    """Pairs that reach the threshold of their category, or have a shared image or three shared sentences, largest first."""
    p = pairs.join(limits.select("category", "threshold"), "category", "left").fillna(BASE_THRESHOLD, ["threshold"])
    keep = (F.col("n_images") > 0) | (F.col("coverage") >= F.col("threshold")) | (F.col("n_sentences") >= MIN_SENTENCES)
    return p.where(keep)


def comment(pairs: DataFrame) -> DataFrame:
    """The first remark that holds: same team, text and images, images only, text, an image, little."""
    c, i = F.col("coverage"), F.col("n_images")
    remark = (
        F.when(F.col("same_team"), "same_team")
        .when((c >= 0.8) & (i >= 2), "text_and_images")
        .when((i >= 2) & (F.col("jaccard") < 0.35), "images")
        .when(c >= 0.55, "text")
        .when(i >= 1, "image")
        .otherwise("little")
    )
    return pairs.withColumn("remark", remark)


#: Length from which on titles of .55 similarity share two neighbouring characters: an edit spoils two at most.
LONG_TITLE = 20


def best_titles(titles: DataFrame, index: DataFrame, least: float = 0.55) -> DataFrame:
    """For each title the most similar other title of the index, of `least` similarity (.55 or more).

    Candidates share two neighbouring characters if one of them is long, one character if both are short, and their
    lengths allow the similarity: no pair that is similar enough is left out.
    """

    def grams(df: DataFrame, column: str) -> DataFrame:
        n = F.length(column)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.substring(column, i, F.lit(2)))
        ones = F.when(n < LONG_TITLE, F.transform(F.split(column, ""), lambda c: F.concat(F.lit("="), c))).otherwise(F.array().cast("array<string>"))
        return df.select(column, F.explode(F.array_distinct(F.concat(pairs, ones))).alias("_g"))

    longest = F.greatest(F.length("title"), F.length("match"))
    fits = (F.col("title") != F.col("match")) & (F.abs(F.length("title") - F.length("match")) <= longest * (1 - least))
    pairs = grams(titles, "title").join(grams(index, "match"), "_g").where(fits).select("title", "match").distinct()
    s = pairs.withColumn("similarity", T.similarity(F.col("title"), F.col("match"))).where(F.col("similarity") >= least)
    w = Window.partitionBy("title").orderBy(F.col("similarity").desc(), "match")
    top = s.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return top.select("title", "match", (F.floor(F.col("similarity") * 1000 + 0.5) / 1000).alias("similarity"))


def asof(rows: DataFrame, marks: DataFrame, key: str, at: str, mark: str) -> DataFrame:
    """`rows` with the value of the last mark (key, at, mark) at or before each: one union and one window, no theta join.

    Of marks at the same place the largest counts.
    """
    marks = marks.groupBy(key, at).agg(F.max(mark).alias(mark))
    both = rows.withColumn(mark, F.lit(None).cast(dict(marks.dtypes)[mark])).withColumn("_m", F.lit(1))
    both = both.unionByName(marks.withColumn("_m", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_m").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(mark, F.last(mark, ignorenulls=True).over(w)).where("_m = 1").drop("_m")
