"""A document's own text: without what its template says, its bibliography and short lines; sections left as the template has them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.session import materialize

#: Lines of .8 similarity to guidance count as guidance: a fifth of the longer one's length in edits at most.
EDITS = 5
#: Shortest line of an original text, and the pieces from which on the sections are trusted.
MIN_LINE, MIN_PIECES = 12, 3
#: Keys that meet the dictionary in one group, entries that do, and entries and trigrams of these that are counted at once.
KEYS, ENTRIES, BLOCK, BLOCK_GRAMS = 20_000, 8192, 1024, 75_000
#: Tasks that groups are dealt to at most, where the session has no more.
MOST_TASKS = 2000
#: Words a section has beside its guidance if it is filled in.
OWN_WORDS = 20
BIBLIOGRAPHY = ("Kaynakça", "Kaynaklar", "References")
_ALPHABET = " abcdefghijklmnopqrstuvwxyz0123456789"
_BASE = len(_ALPHABET) + 1
_CODES = np.zeros(256, np.int64)
_CODES[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(1, _BASE)


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of texts with two marks at either end, and at which each text's begin (one more at the end).

    The second of equal ones in a text is another than the first, and so on: what two texts share is then a count.
    """
    data = _CODES[np.frombuffer(b"".join(b"##" + t + b"##" for t in texts), np.uint8)]
    length = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 2
    begin = np.concatenate([[0], np.cumsum(length)])
    text = np.repeat(np.arange(len(texts)), length)
    at = np.arange(begin[-1]) + 2 * text
    code = (data[at] * _BASE + data[at + 1]) * _BASE + data[at + 2]
    both, k = np.sort(text * _BASE**3 + code), np.arange(len(code))
    new = np.concatenate([[True], both[1:] != both[:-1]])[: len(k)]
    again = k - np.maximum.accumulate(np.where(new, k, 0))
    return again * _BASE**3 + both - text * _BASE**3, begin


def _blocks(entries: list[bytes]) -> Iterator[list[bytes]]:
    """Entries by length, in blocks that bound the table of their trigrams."""
    block, size = [], 0
    for e in sorted(entries, key=len):
        if block and (len(block) == BLOCK or size + len(e) > BLOCK_GRAMS):
            yield block
            block, size = [], 0
        block.append(e)
        size += len(e) + 2
    if block:
        yield block


#: More trigrams than texts share where they are counted in a byte, and more than any do.
_NEVER, _NONE = 255, np.iinfo(np.int64).max


def _needed(n: int, m: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The trigrams that a key of `n` characters and entries of `m` share if they are alike, _NONE where the entry's length is
    not within a quarter: the least, all, and all as a byte."""
    longer = np.maximum(n, m)
    most = np.where((m >= n - n // EDITS) & (m <= n + n // (EDITS - 1)), longer + 2 - 3 * (longer // EDITS), _NONE)
    return int(most.min()), most, np.minimum(most, _NEVER).astype(np.uint8)


def _near(keys: list[bytes], entries: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """For each block and key: the key's number, the entries that may be alike, and the block.

    An edit spoils three trigrams at most, so texts within a fifth of the longer one's length share all others. For each
    trigram of a block there is a row that tells which of its entries have it; the sum of a key's rows is what it shares.
    """
    grams, begin = _grams(keys)
    n = np.diff(begin) - 2
    for block in _blocks(entries):
        own, first = _grams(block)
        m = np.diff(first) - 2
        known, row = np.unique(own, return_inverse=True)
        has = np.zeros((len(known) + 1, len(block)), np.uint8)
        has[row, np.repeat(np.arange(len(block)), m + 2)] = 1
        place = np.searchsorted(known, grams)
        found = known[np.minimum(place, len(known) - 1)] == grams
        # What is known of a key's trigrams, key by key; what its entries have to share follows from its length.
        part, ends = place[found], np.concatenate([[0], np.cumsum(found)])[begin]
        need: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for k, (size, i, j) in enumerate(zip(n.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            if size not in need:
                need[size] = _needed(size, m)
            least, most, small = need[size]
            if j - i < least:
                continue
            rows = has.take(part[i:j], axis=0)
            near = np.flatnonzero(rows.sum(0, dtype=np.uint8) >= small if j - i < _NEVER else rows.sum(0, dtype=np.int64) >= most)
            if len(near):
                yield k, near, block


def _candidates(left: pa.Table, right: pa.Table) -> pa.Table:
    keys, entries = ([t.encode() for t in t[c].to_pylist()] for t, c in ((left, "key"), (right, "match")))
    found = [(keys[k], block[i]) for k, near, block in (_near(keys, entries) if keys and entries else ()) for i in near]
    return pa.table({c: pa.array([f[i] for f in found], pa.binary()).cast(pa.string()) for i, c in enumerate(("key", "match"))})


def alike(keys: DataFrame, dictionary: DataFrame, about: int | None = None) -> DataFrame:
    """key, match: every pair of a comparison key and an entry of similarity .8 or more, each pair once.

    keys: key; dictionary: match; both as `text.fold` leaves them; about: how many keys there may be, else they are counted.
    Empty keys are like empty entries only; nulls are like nothing. Groups of about KEYS keys meet groups of about ENTRIES
    entries; there trigrams are counted in one table, and only pairs that share as many as such similarity leaves go on
    to have their distance taken: no other pair is made, and none that is similar is left out. What is shuffled are
    distinct keys, once for each group of entries, and entries, once for each group of keys.
    """
    keys = keys.select("key").where("key IS NOT NULL").distinct()
    dictionary = dictionary.select("match").where("match IS NOT NULL").distinct()
    groups = lambda n, most: max(1, math.ceil(n / most))
    x, y = groups(keys.count() if about is None else about, KEYS), groups(dictionary.count(), ENTRIES)
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = keys.withColumn("_x", hashed("key", x)).withColumn("_y", every(y))
    right = dictionary.withColumn("_y", hashed("match", y)).withColumn("_x", every(x))
    # The groups are small and their work is large, so their number decides over the tasks, not their bytes.
    tasks = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(x * y, MOST_TASKS))
    left, right = (t.repartition(tasks, "_x", "_y").groupBy("_x", "_y") for t in (left, right))
    met = left.cogroup(right).applyInArrow(_candidates, "key string, match string")
    most = f"cast(greatest(length(key), length(match)) div {EDITS} AS int)"
    return met.where(F.expr(f"levenshtein(key, match, {most}) >= 0"))


def original_texts(of: DataFrame, guidance: DataFrame, bibliography: tuple[str, ...] = BIBLIOGRAPHY) -> DataFrame:
    """doc_id, text, n_pieces, whole: the lines of each document that are its own, joined by a line feed.

    of: doc_id, ord, text, title, heading, section (0: before the first heading), as `structure.outline` gives them;
    guidance: text. Lines of MIN_LINE characters that are not like any guidance count, headings and sections whose title
    begins with one of `bibliography` left out. Where that leaves fewer than MIN_PIECES, all lines that are not guidance are
    taken if they are more (`whole`): a document without headings must not end up with nothing to compare. A document with
    no line of its own has an empty text. Null texts are no lines; copies of a line all stay.
    """
    lines = of.where("text IS NOT NULL").select("doc_id", "ord", F.trim("text").alias("text"), "title", "heading", "section")
    over = F.max(F.when(F.col("heading"), F.col("title"))).over(Window.partitionBy("doc_id", "section"))
    named = F.coalesce(T.fold(F.col("over")), F.lit(""))
    listed = reduce(lambda a, b: a | F.startswith(named, T.fold(F.lit(b))), bibliography, F.lit(False))
    own = (F.col("section") > 0) & ~F.col("heading") & ~(listed & (F.col("section") > 0))
    line = F.when(F.length("text") >= MIN_LINE, F.struct("ord", "text", F.coalesce(own, F.lit(False)).alias("own")))
    # Texts are gathered by document where the outline has them, and travel no more but as distinct keys.
    docs = materialize(lines.withColumn("over", over).groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("lines")), "originals")
    keys = docs.select("doc_id", F.posexplode("lines").alias("at", "line")).select("doc_id", "at", T.fold(F.col("line.text")).alias("key"))
    n = docs.agg(F.sum(F.size("lines"))).first()[0] or 0
    known = materialize(alike(keys, guidance.select(T.key(F.col("text")).alias("match")), n).select("key").distinct(), "known")
    guided = keys.join(known, "key", "left_semi").groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list("at").alias("guided"))
    found = docs.join(guided, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    told = F.coalesce("guided", F.array().cast("array<int>"))
    kept = found.select("doc_id", F.filter("lines", lambda r, i: ~F.array_contains(told, i)).alias("lines"))
    n_own = F.size(F.filter("lines", lambda r: r["own"]))
    kept = kept.withColumn("whole", (n_own < MIN_PIECES) & (F.size("lines") > n_own))
    taken = kept.withColumn("lines", F.filter("lines", lambda r: F.col("whole") | r["own"]))
    return taken.select("doc_id", F.array_join(F.transform("lines", lambda r: r["text"]), "\n").alias("text"), F.size("lines").alias("n_pieces"), "whole")


def residue(of: DataFrame, guidance: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, section, n_words, guidance_words, residue: which sections hold little beside the guidance of their template.

    of: doc_id, section, text, heading and the columns `on`; guidance: text and `on`, which say whose guidance a section is
    held against (none: all of it). A section is residue if it has lines of guidance and fewer than OWN_WORDS words beside.
    Sections without lines have no words. What comes before the first heading is no section.
    """
    body = of.where("section > 0").withColumns({"key": T.fold(F.trim("text")), "n": F.when(F.col("heading"), 0).otherwise(F.coalesce(F.size(T.tokens(F.col("text"))), F.lit(0)))})
    body = materialize(body.select("doc_id", "section", "text", "heading", "key", "n", *on), "lines")
    rules = guidance.select(*on, T.key(F.col("text")).alias("match"))
    line = ~F.col("heading") & (F.length(F.trim("text")) > 0)
    pairs = alike(body.where(line), rules, body.count())
    known = pairs.join(rules, "match").select("key", *on).distinct().withColumn("guided", F.lit(True))
    told = F.sum(F.when(line & F.col("guided"), F.col("n")).otherwise(0))
    out = body.join(known, ["key", *on], "left").groupBy("doc_id", "section").agg(F.sum("n").alias("n_words"), told.alias("guidance_words"))
    return out.withColumn("residue", (F.col("guidance_words") > 0) & (F.col("n_words") - F.col("guidance_words") < OWN_WORDS))
