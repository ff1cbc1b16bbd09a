"""Language-model scores: unigrams, and a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) * P(word | class). The class model is a softmax over CLASSES whose logits add the
weights of three hashed features: the word before, the two words before, and the word before the last (a skip). Within a
class, words keep their smoothed shares. The commonest words have classes of their own; the others are grouped by their
first letters, which any word has, seen or not, into classes of about equal weight.

Contexts are dealt to shards by the word before (where that is very common, by both words, and by documents where both
are), so that all tokens of a context meet in one task. A shard has weights of its own, as many rows as its training
contexts need: what the model knows grows with the corpus, and no task or driver holds it whole. Shards and the order of
their gradient steps follow from words alone, so scores don't depend on how the texts are spread over files or tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.session import materialize

FOLDS, HELD_OUT = 5, 1
#: Classes, how many of them are single words (class 0: the end), and groups of first letters that the others are made of.
CLASSES, SINGLE, GROUPS = 64, 32, 4096
#: Contexts of a gradient step, passes over a shard, the rate of a step, and what damps rare features.
STEP, EPOCHS, RATE, DAMP = 4096, 2, 1.5, 2.0
#: Commonest words whose counts every task knows; the counts of all others are joined.
HEAD = 1 << 16
#: Text bytes for each bucket of words, and for each shard of contexts.
BUCKET_BYTES, SHARD_BYTES = 24 << 20, 8 << 20
#: Occurrences from which on a word's contexts are dealt by the word before it as well.
COMMON = 1 << 17

_U = np.uint64
_END = np.array([0x51A7E4D00DFEED5], np.uint64)
_START = _U(0x3B9ACA07)

_DEALT = "bucket int, keys binary, groups binary, counts binary"
_COUNTS = "bucket int, key long, grp int, c long"
#: What travels: packed columns of a batch of texts. Their meaning depends on the kind.
_DOCS, _TAIL, _CONTEXTS, _TAIL_SUMS, _SCORES = range(5)
_PACKED = "bucket int, kind int, base long, a binary, b binary, c binary, d binary, e binary"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, context double"
_BINARY = 5


def held_out(doc_id) -> F.Column:
    """crc32 of the doc_id as text, mod FOLDS, is HELD_OUT; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hash, row and letter group of each token: the lower-cased words of each row, then its end."""
    starts, ends, row = W.spans(data, offsets)
    h = W.hashes(data, starts, ends)
    rows = len(offsets) - 1
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    letters = np.zeros(len(starts), np.uint64)
    for k in range(3):
        inside = starts + k < ends
        letters |= np.where(inside, W._LOWER[padded[starts + k]], 0).astype(np.uint64) << _U(8 * k)
    group = (W.mix(letters + _U(1)) % _U(GROUPS)).astype(np.int64)
    at = np.arange(len(h)) + row
    n = len(h) + rows
    counts = np.bincount(row, minlength=rows) + 1
    out_h, out_r, out_g = np.empty(n, np.uint64), np.repeat(np.arange(rows), counts), np.zeros(n, np.int64)
    out_h[at], out_g[at] = h, group
    out_h[np.cumsum(counts) - 1] = _END[0]
    return out_h, out_r, out_g


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> _U(40)) * _U(buckets)) >> _U(24)).astype(np.int64)


def _sums(keys: np.ndarray, *values: np.ndarray):
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return (keys[first], order[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def _count(buckets: int):
    """Counts of the training words of each batch, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            got = []
            for i, j in W.slices(offsets):
                h, _, g = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key, at, c = _sums(h, np.ones(len(h), np.int64))
                got.append((key, g[at], c))
            if not got:
                continue
            h, g, c = (np.concatenate(x) for x in zip(*got, strict=True))
            key, at, c = _sums(h, c)
            g, b = g[at], _bucket(key, buckets)
            edge = np.searchsorted(b, np.arange(buckets + 1))
            for k in range(buckets):
                s = slice(edge[k], edge[k + 1])
                if edge[k] < edge[k + 1]:
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32()), "keys": [key[s].tobytes()], "groups": [g[s].astype(np.int32).tobytes()], "counts": [c[s].tobytes()]})

    return run


def _add_counts(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [[], [], []]
    for batch in batches:
        for k, (c, kind) in enumerate((("keys", np.uint64), ("groups", np.int32), ("counts", np.int64))):
            got[k] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(c)]
    h, at, c = _sums(np.concatenate(got[0]), np.concatenate(got[2]))
    g = np.concatenate(got[1])[at]
    n = len(h)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key[0].as_py(), np.int32)), pa.array(h.view(np.int64)), pa.array(g), pa.array(c)], names=["bucket", "key", "grp", "c"])


class Model:
    """What every task knows: counts of the head, classes, and the classes' logarithmic shares."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, single: np.ndarray, class_of: np.ndarray, totals: np.ndarray):
        order = np.argsort(head)
        self.head, self.counts = head[order], counts[order]
        self.single_of = np.zeros(len(head), np.int64)
        self.single_of[np.searchsorted(self.head, single)] = np.arange(1, len(single) + 1)
        self.class_of = class_of
        self.prior, self.log_totals = np.log(totals / totals.sum()).astype(np.float32), np.log10(totals)

    def place(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the head, -1 outside."""
        if not len(self.head):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        return np.where(self.head[at] == h, at, -1)

    def classes(self, h: np.ndarray, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        single = np.where(place >= 0, self.single_of[place] if len(self.head) else 0, 0)
        return np.where(h == _END[0], 0, np.where(single > 0, single, self.class_of[group]))

    def shard(self, h: np.ndarray, place: np.ndarray, row: np.ndarray, doc: np.ndarray, shards: int):
        """Shard, word before and word before that (32-bit hashes) of each token; `doc`: a hash of each row."""
        before = [np.full(len(h), _START), np.full(len(h), _START)]
        times = [np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)]
        count = np.where(place >= 0, self.counts[place] if len(self.head) else 0, 0)
        for k in (1, 2):
            same = np.flatnonzero(row[k:] == row[:-k]) if len(h) > k else np.zeros(0, int)
            before[k - 1][same + k], times[k - 1][same + k] = h[same], count[same]
            # Every text has a start, so starts are as common as texts.
            times[k - 1][before[k - 1] == _START] = COMMON
        one, two = before
        key = W.mix(one)
        common = times[0] >= COMMON
        key = np.where(common, W.mix(key + two), key)
        both = np.minimum(times[0], times[1]) // COMMON
        key = np.where(both > 1, W.mix(key + doc[row] % np.maximum(both, 1).astype(np.uint64)), key)
        return (key % _U(shards)).astype(np.int64), (W.mix(one) >> _U(32)).astype(np.uint32), (W.mix(two) >> _U(32)).astype(np.uint32)


def _rows(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, int]:
    """Row of each feature in a table with a power of two of rows; features seen once in training have none, but the last."""
    distinct, back = np.unique(key, return_inverse=True)
    often = np.bincount(back, weights=times, minlength=len(distinct)) > 1
    size = 1 << int(often.sum()).bit_length()
    return np.where(often, W.mix(distinct) & _U(size - 1), size).astype(np.int64)[back], size


class Softmax:
    """The class model of a shard: `features` are rows of the contexts in three tables, `prior` the logits without them."""

    def __init__(self, features: list[tuple[np.ndarray, int]], prior: np.ndarray):
        self.rows, self.prior = [f for f, _ in features], prior
        self.weights = [np.zeros((size + 1, len(prior)), np.float32) for _, size in features]
        self.seen = [np.zeros(size + 1) for _, size in features]

    def probabilities(self, at: slice) -> np.ndarray:
        z = np.tile(self.prior, (len(self.rows[0][at]), 1))
        for w, f in zip(self.weights, self.rows, strict=True):
            z += w[f[at]]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z

    def step(self, at: slice, times: np.ndarray, context: np.ndarray, y: np.ndarray, n: np.ndarray) -> None:
        """One step over the contexts `at`, seen `times`; of which `context` was followed `n` times by class `y`. Each
        feature's row moves against its mean gradient, ever less as its steps add up."""
        g = self.probabilities(at) * times[:, None].astype(np.float32)
        g[context, y] -= n
        for w, seen, f in zip(self.weights, self.seen, self.rows, strict=True):
            order = np.argsort(f[at], kind="stable")
            row = f[at][order]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            m = np.add.reduceat(times[order], first)
            row = row[first]
            mean = np.add.reduceat(g[order], first, axis=0) / (m + DAMP)[:, None]
            w[row] -= (RATE / np.sqrt(1 + seen[row] / (4 * STEP)))[:, None].astype(np.float32) * mean.astype(np.float32)
            seen[row] += m
            w[-1] = 0


def fit_and_score(one: np.ndarray, two: np.ndarray, y: np.ndarray, held: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """log10 P(class | context) of every token of a shard, after gradient steps over those not held out.

    Equal contexts are one, with the counts of their classes; their order is that of a hash.
    """
    context, back = np.unique((one.astype(np.uint64) << _U(32)) | two, return_inverse=True)
    order = np.argsort(W.mix(context))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    context, back = context[order], rank[back]
    times = np.bincount(back[~held], minlength=len(context))
    cells, cell_of = np.unique(back * CLASSES + y, return_inverse=True)
    n = np.bincount(cell_of[~held], minlength=len(cells)).astype(np.float32)
    model = Softmax([_rows(context >> _U(32), times), _rows(context, times), _rows(context & _U(0xFFFFFFFF), times)], prior)
    edge = np.searchsorted(cells, np.arange(0, len(context) + STEP, STEP) * CLASSES)
    for _ in range(EPOCHS):
        for k in range(0, len(context), STEP):
            at, c = slice(k, k + STEP), slice(edge[k // STEP], edge[k // STEP + 1])
            model.step(at, times[at], cells[c] // CLASSES - k, cells[c] % CLASSES, n[c])
    logs = np.empty(len(cells))
    for k in range(0, len(context), STEP):
        c = slice(edge[k // STEP], edge[k // STEP + 1])
        p = model.probabilities(slice(k, k + STEP))
        logs[c] = np.log10(np.maximum(p[cells[c] // CLASSES - k, cells[c] % CLASSES], 1e-30))
    return logs[cell_of]


def _row(bucket: int, kind: int, base: int, *columns: np.ndarray) -> pa.RecordBatch:
    names = [x.split()[0] for x in _PACKED.split(", ")]
    blobs = [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns] + [pa.nulls(1, pa.binary())] * (_BINARY - len(columns))
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([base], pa.int64()), *blobs], names=names)


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Buckets of a sorted array, and where each lies."""
    if len(bucket):
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        yield from zip(bucket[first].tolist(), map(slice, first, [*first[1:], len(bucket)]), strict=True)


def _emit(model: Model, buckets: int, shards: int):
    """Of each batch of texts: a row of what is known of them at once, their tail words by bucket, their contexts by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        log_counts = np.log10(model.counts + 0.5) if len(model.counts) else np.zeros(1)
        for turn, batch in enumerate(batches):
            base = (part << 32) | turn
            data, offsets = W.utf8(batch.column("text"))
            if len(offsets) < 2:
                continue
            doc = batch.column("doc").to_numpy().view(np.uint64)
            held = np.asarray(batch.column("held_out"))
            got = []
            for i, j in W.slices(offsets):
                h, r, g = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                place = model.place(h)
                shard, one, two = model.shard(h, place, r, doc[i:j], shards)
                got.append((h, r + i, place, shard, one, two, model.classes(h, g, place).astype(np.uint8)))
            h, r, place, shard, one, two, y = (np.concatenate(x) for x in zip(*got, strict=True))
            del got
            n, inside = batch.num_rows, place >= 0
            sums = lambda v: np.bincount(r, weights=v, minlength=n)  # noqa: E731, B023
            ids = batch.column("doc_id")
            flags = held.astype(np.uint8) | (np.asarray(ids.is_null()).astype(np.uint8) << 1)
            logs = sums(np.where(inside, log_counts[place], 0))
            at = int(W.mix(np.array([base], np.uint64))[0] % _U(buckets + shards))
            yield _row(at, _DOCS, base, ids.fill_null(0).to_numpy(), flags, sums(np.ones(len(r))).astype(np.int64), sums(inside).astype(np.int64), np.stack([logs, -sums(model.log_totals[y])]))
            tail = np.flatnonzero(~inside)
            key, row, b = h[tail], r[tail], _bucket(h[tail], buckets)
            order = np.lexsort((key, row, b))
            key, row, b = key[order], row[order], b[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))) if len(key) else np.zeros(0, int)
            times = np.diff(np.append(first, len(key))).astype(np.uint32)
            key, row, b = key[first], row[first].astype(np.uint16), b[first]
            for k, s in _dealt(b):
                yield _row(k, _TAIL, base, row[s], key[s], times[s])
            order = np.argsort(shard, kind="stable")
            row, one, two, y = r[order].astype(np.uint16), one[order], two[order], y[order] | (held[r[order]].astype(np.uint8) << 7)
            for k, s in _dealt(shard[order]):
                yield _row(buckets + k, _CONTEXTS, base, row[s], one[s], two[s], y[s])

    return run


def _look_up(row: np.ndarray, key: np.ndarray, times: np.ndarray, known: np.ndarray, c: np.ndarray):
    """Logs of the counts of a batch's tail words and how many are known, summed by text."""
    at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
    hit = known[at] == key if len(known) else np.zeros(len(key), bool)
    logs = np.where(hit, np.log10((c[at] if len(known) else 0) + 0.5), np.log10(0.5)) * times
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    return row[first], np.add.reduceat(logs, first), np.add.reduceat(hit * times.astype(np.int64), first)


def _answer(prior: np.ndarray):
    """A bucket's counts answer its tail words; a shard's contexts are fitted and scored; both answer by batch of texts."""

    def run(packed: pa.Table, counts: pa.Table) -> pa.Table:
        names, out, contexts = packed.column_names, [], []
        known, c = counts["key"].to_numpy().view(np.uint64), counts["c"].to_numpy()
        order = np.argsort(known)
        known, c = known[order], c[order]
        for batch in packed.to_batches():
            for i in range(batch.num_rows):
                bucket, kind, base = (batch.column(k)[i].as_py() for k in range(3))
                blob = lambda k, t: np.frombuffer(batch.column(3 + k)[i].as_buffer(), t)  # noqa: E731, B023
                if kind == _DOCS:
                    out.append(batch.slice(i, 1))
                elif kind == _TAIL:
                    out.append(_row(bucket, _TAIL_SUMS, base, *_look_up(blob(0, np.uint16), blob(1, np.uint64), blob(2, np.uint32), known, c)))
                else:
                    contexts.append((bucket, base, blob(0, np.uint16), blob(1, np.uint32), blob(2, np.uint32), blob(3, np.uint8)))
        if contexts:
            one, two, y = (np.concatenate([x[k] for x in contexts]) for k in (3, 4, 5))
            logs = fit_and_score(one, two, (y & 127).astype(np.int64), y > 127, prior)
            end = 0
            for bucket, base, row, *_ in contexts:
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                out.append(_row(bucket, _SCORES, base, row[first], np.add.reduceat(logs[end : end + len(row)], first)))
                end += len(row)
        return pa.Table.from_batches(out, packed.schema if not out else out[0].schema).rename_columns(names)

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """The texts of one batch with the sums of all answers to it, added in the order of the buckets."""
    table = table.sort_by([("kind", "ascending"), ("bucket", "ascending")])
    out = {}
    for kind, *blobs in zip(*(table[c].to_pylist() for c in ("kind", "a", "b", "c", "d", "e")), strict=True):
        blob = lambda k, t: np.frombuffer(blobs[k], t)  # noqa: E731, B023
        if kind == _DOCS:
            ids, flags = blob(0, np.int64), blob(1, np.uint8)
            n, known, (logs, context) = blob(2, np.int64), blob(3, np.int64).copy(), blob(4, np.float64).copy().reshape(2, -1)
        elif kind == _TAIL_SUMS:
            logs[blob(0, np.uint16)] += blob(1, np.float64)
            known[blob(0, np.uint16)] += blob(2, np.int64)
        else:
            context[blob(0, np.uint16)] += blob(1, np.float64)
    out = [pa.array(ids, mask=flags > 1), pa.array((flags & 1) > 0), pa.array(n), pa.array(known), pa.array(logs), pa.array(logs + context)]
    return pa.Table.from_arrays(out, names=[x.split()[0] for x in _SCORED.split(", ")])


def prepare(counts: DataFrame) -> Model:
    """What every task has to know. The driver gets the HEAD commonest words and one total per letter group: fixed sizes."""
    end = F.lit(int(_END.view(np.int64)[0]))
    words = counts.where(F.col("key") != end)
    top = words.orderBy(F.col("c").desc(), "key").limit(HEAD - 1).select("key", "c", "grp").toArrow()
    at_end = counts.where(F.col("key") == end).select("key", "c").toArrow()
    head = np.concatenate([top["key"].to_numpy(), at_end["key"].to_numpy()]).view(np.uint64)
    known = np.concatenate([top["c"].to_numpy(), at_end["c"].to_numpy()])
    totals = np.full(CLASSES, 0.5)
    totals[0] += at_end["c"].to_numpy().sum() + 0.5 * at_end.num_rows
    single = head[: min(SINGLE - 1, top.num_rows)]
    totals[1 : len(single) + 1] += known[: len(single)] + 0.5
    weight = np.zeros(GROUPS)
    for r in words.groupBy("grp").agg((F.sum("c") + 0.5 * F.count(F.lit(1))).alias("t")).collect():
        weight[r["grp"]] = float(r["t"])
    np.subtract.at(weight, top["grp"].to_numpy()[: len(single)], known[: len(single)] + 0.5)
    # The heaviest groups first, each to the class that is lightest so far.
    class_of = np.zeros(GROUPS, np.int64)
    for g in np.lexsort((np.arange(GROUPS), -weight)):
        class_of[g] = SINGLE + int(totals[SINGLE:].argmin())
        totals[class_of[g]] += weight[g]
    return Model(head, known, single, class_of, totals)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of `docs` (doc_id, text).

    Null and empty texts are their end alone. Words are compared by 64-bit hashes. Null doc_ids are trained on; rows that
    repeat a doc_id are scored each; without training rows every base probability is 1; an empty table gives an empty
    result; other columns play no part. A word that all texts share is in the head, which is counted where the text is;
    what is dealt by word are counts per batch, tail words, each a tiny share of the corpus, and contexts, see above.

    Rows of `docs` must come in one order whenever they are read, as they do from files: a lost task is then rerun alike.
    """
    W.bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("doc_id", "text").alias("doc"))
    seen = docs.where("NOT held_out").select("text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, shards = total // BUCKET_BYTES + 1, total // SHARD_BYTES + 1
    counts = materialize(seen.mapInArrow(_count(buckets), _DEALT).groupBy("bucket").applyInArrow(_add_counts, _COUNTS), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    model = prepare(counts)
    packed = docs.mapInArrow(_emit(model, buckets, shards), _PACKED)
    answers = packed.groupBy("bucket").cogroup(counts.select("bucket", "key", "c").groupBy("bucket")).applyInArrow(_answer(model.prior), _PACKED)
    return answers.groupBy("base").applyInArrow(_add_up, _SCORED).select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.log10(F.lit(n + 0.5 * (v + 1)))).alias("base_score"),
        F.col("context").alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
