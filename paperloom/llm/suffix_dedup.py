"""Removal of repeated passages: common prefixes from a Burrows-Wheeler transform, expanded up to a minimum length.

Every string of MIN_BYTES bytes is named by the smallest hash among its 16-byte grams, its anchor. Neighbouring strings
of one anchor form a segment, so equal strings always lie in segments of one anchor, wherever they stand.

1. Each text becomes 64-bit fingerprints of its segments, packed and dealt by anchor. Of segments of equal anchor and
   fingerprint only the smallest document's may hold anything new: all others are covered whole.
2. Where different segments of one anchor have 17 bytes before it or 18 behind it in common, as equal strings do, one copy
   of each is laid out in a shard with its document's number.
3. A shard's Burrows-Wheeler transform is expanded breadth-first: intervals of strings of 1, 2, 3 ... bytes come from
   those one byte shorter by backward extension, until only intervals of MIN_BYTES are left. Each is one string, with
   all its places; the smallest document among them owns it, and its other places are covered.
4. Covered ranges go back to their documents, where they are merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.session import discard, materialize

MIN_BYTES, GRAM = 50, 16
#: Text bytes for each bucket of anchors, bytes of a shard, and bytes of text that the kernels work on at once.
BUCKET_BYTES, SHARD_BYTES, SLICE = 16 << 20, 1 << 19, 1 << 17
#: Settled segments that go to one bucket.
SETTLED = 1 << 14
#: Buckets for each share of the documents that replies are gathered for.
SHARED = 4
#: Places of the anchor in a string from which on LEFT bytes stand before it; at all others RIGHT stand behind it.
LEFT = (MIN_BYTES - GRAM) // 2
RIGHT = MIN_BYTES - GRAM - LEFT + 1
#: Segments to compare of an anchor from which on each string is dealt by itself, so that no shard grows with an anchor.
HOT = 5_000
#: Repeated segments that a task remembers, so that of their later copies only smaller documents' travel.
REMEMBERED = 1 << 17
#: Stands for a null doc_id, which counts as the largest.
_LAST = (1 << 63) - 1

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Largest code of a context, and what the three parts of 16 bits that two codes travel in count.
_CODE, _PARTS = 0xFFFFFF, np.array([1, 1 << 16, 1 << 32])
#: A random number for each byte, for fingerprints.
_BYTE = np.random.default_rng(1).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

_DEALT = "bucket int, settled boolean, base long, docs binary, tags binary, counts binary, pairs binary, anchors binary, codes binary"
_REPLY = "share int, base long, docs binary, tags binary, counts binary, pairs binary"
_TOLD = "d long, tag long, covered binary, shown binary, hot binary"
_FOUND = "k long, d long, starts binary, ends binary, key long, at long, content binary"
_SPANS = "k long, starts binary, ends binary"


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    np.multiply.accumulate(p, out=p)
    return p


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` neighbours."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (width - k)], x[width - k :]) if k < width else x


def _contexts(gram: np.ndarray, wide: np.ndarray, anchor: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Codes (24 bits each, from 1) of the LEFT bytes before the anchor of each segment and, in the lower 24 bits, of the RIGHT
    ones behind it; 0 where no string of the segment has so many. Both are 0 where the anchor stands several times.

    `anchor`: of each place, with `first` and `size` of the segments. Equal strings of two segments have their anchor at
    one place, so the segments agree in one code that is not 0, or one of them has none.
    """
    reach = MIN_BYTES - GRAM
    # A gram is an anchor if the largest anchor of the strings that hold it is no other.
    most = ~_least(~np.concatenate([np.zeros(reach, np.uint64), anchor, np.zeros(reach, np.uint64)]), reach + 1)
    places = np.flatnonzero(gram == most)
    low, high = np.searchsorted(places, first), np.searchsorted(places, first + size + reach)
    n = high - low
    at = places[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    owner = np.repeat(np.arange(len(first)), n)
    same = gram[at] == anchor[first[owner]]
    at, owner = at[same], owner[same]
    once = np.bincount(owner, minlength=len(first)) == 1
    place = np.zeros(len(first), np.int64)
    place[owner] = at
    left, right = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    code = lambda p, a, b, c: W.mix(W.mix(W.mix(wide[p + a]) ^ wide[p + b]) ^ wide[p + c]) % _U(_CODE) + _U(1)
    has = once & (place - first >= LEFT)
    left[has] = code(place[has], -LEFT, 8 - LEFT, -8)
    has = once & (place - first - size + 1 < LEFT)
    right[has] = code(place[has], GRAM, GRAM + 8, GRAM + RIGHT - 8)
    return left << _U(24) | right


def segments(data: np.ndarray, offsets: np.ndarray, contexts: bool = False) -> tuple[np.ndarray, ...]:
    """Anchor and fingerprint (64 bits each), row, first byte and number of strings of each segment, and its `_contexts`."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.uint64)[: 5 + contexts])
    if len(data) < MIN_BYTES:
        return none
    x = data.astype(np.uint64)
    wide = x
    for k in (1, 2, 4):
        wide = wide[:-k] | (wide[k:] << _U(8 * k))
    gram = wide[:-8] * _MUL + wide[8:] * _U(0xD6E8FEB86659FD93)
    gram ^= gram >> _U(31)
    gram *= _U(0xBF58476D1CE4E5B9)
    gram ^= gram >> _U(29)
    anchor = _least(gram, MIN_BYTES - GRAM + 1)
    n = len(anchor)
    inside = np.ones(n, bool)
    for end in offsets[1:-1]:
        inside[max(0, end - MIN_BYTES + 1) : end] = False
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1] | ~inside[1:]
    edges = np.flatnonzero(new)
    size = np.diff(np.append(edges, n))
    ok = inside[edges]
    first, size = edges[ok], size[ok]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers(_MUL, len(x)))])
    length = size + MIN_BYTES - 1
    print_ = W.mix((sums[first + length] - sums[first]) * _powers(_INV, int(first.max()) + 1)[first] ^ length.astype(np.uint64)) if len(first) else none[1]
    more = (_contexts(gram, wide, anchor, first, size),) if contexts else ()
    return anchor[first], print_, np.searchsorted(offsets, first, "right") - 1, first, size, *more


def _blobs(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary column with one row for each range between `edges`."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer((np.asarray(edges) * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())]
    )


def _narrow(x: np.ndarray) -> np.ndarray:
    """`x`, not negative, in as few bytes a number as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max())))


def _grouped(group: np.ndarray, doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """First entry of each document of a group (entries are in this order), the groups' edges among these, and their columns:
    documents as distances from the least one, and tags."""
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
    edges = np.append(np.flatnonzero(np.append(True, np.diff(group[first]) != 0)), len(first))
    base = doc.min()
    docs = _narrow(doc[first].view(np.uint64) - base.view(np.uint64))
    return first, edges, {"base": pa.array(np.full(len(edges) - 1, base)), "docs": _blobs(docs, edges), "tags": _blobs(tag[first], edges)}


def _documents(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    tags = _numbers(batch, "tags", i, np.uint32)
    apart = _numbers(batch, "docs", i, len(tags))
    return (apart.astype(np.uint64) + np.array([batch.column("base")[i].as_py()]).view(np.uint64)).view(np.int64), tags


def _packed(bucket: np.ndarray, settled: bool, doc: np.ndarray, tag: np.ndarray, pair: np.ndarray, anchor: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: each document of its entries once, how many these are, then their pairs, anchors and codes."""
    order = np.lexsort((tag, doc, bucket))
    bucket, doc, tag = bucket[order], doc[order], tag[order]
    first, edges, row = _grouped(bucket, doc, tag)
    rows = np.append(first, len(doc))[edges]
    row |= {"bucket": pa.array(bucket[rows[:-1]].astype(np.int32)), "settled": pa.array([settled] * (len(edges) - 1))}
    row |= {"counts": _blobs(_narrow(np.diff(np.append(first, len(doc)))), edges), "pairs": _blobs(pair[order], rows)}
    none = np.zeros(len(rows), np.int64) if settled else rows
    row |= {"anchors": _blobs(anchor[order].astype(np.uint32), none), "codes": _blobs(code[order].view(np.uint16).reshape(-1, 4)[:, :3], 3 * none)}
    names = [x.split()[0] for x in _DEALT.split(", ")]
    return pa.RecordBatch.from_arrays([row[x] for x in names], names=names)


class _Remembered:
    """Pairs that came repeatedly, and the smallest document of each that has travelled."""

    def __init__(self):
        self.pair, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def settled(self, pair: np.ndarray, doc: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Which of the distinct pairs a smaller document has brought already; takes in the others that are repeated."""
        at = np.minimum(np.searchsorted(self.pair, pair), max(0, len(self.pair) - 1))
        known = self.pair[at] == pair if len(self.pair) else np.zeros(len(pair), bool)
        done = np.zeros(len(pair), bool)
        done[known] = self.doc[at[known]] < doc[known]
        self.doc[at[known & ~done]] = doc[known & ~done]
        new = repeated & ~known
        old = slice(None) if len(self.pair) + new.sum() <= REMEMBERED else slice(0, 0)
        both, docs = np.concatenate([self.pair[old], pair[new]]), np.concatenate([self.doc[old], doc[new]])
        order = np.argsort(both)
        self.pair, self.doc = both[order], docs[order]
        return done


def _deal(buckets: int):
    """Pairs of each batch, by bucket of their anchors. Of equal pairs only the smallest document's need to travel on, in a
    batch and as far as the task remembers earlier ones; all others are settled at once and go to buckets at random, so
    that copies of a passage cost a bucket little more than one pair per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, memory = TaskContext.get().partitionId(), _Remembered()
        for turn, batch in enumerate(batches):
            data, offsets = W.utf8(batch.column("text"))
            tags, docs = batch.column("tag").to_numpy().astype(np.uint32), batch.column("d").to_numpy()
            found = []
            for i, j in W.slices(offsets, SLICE):
                a, f, r, _, _, c = segments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], True)
                found.append((a, f, i + r, c))
            if not found:
                continue
            anchor, pair, row, code = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(row):
                continue
            order = np.lexsort((tags[row], docs[row], pair))
            anchor, pair, row, code = anchor[order], pair[order], row[order], code[order]
            doc, tag = docs[row], tags[row]
            new = np.append(True, pair[1:] != pair[:-1])
            group, first = np.cumsum(new) - 1, np.flatnonzero(new)
            again = np.append(False, ~new[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]))
            done = memory.settled(pair[first], doc[first], np.diff(np.append(first, len(pair))) > 1)
            settled = (doc > doc[first][group]) | done[group]
            at = np.flatnonzero(settled & ~again)
            if len(at):
                at = at[np.lexsort((tag[at], doc[at]))]
                where = W.mix(_U(part << 40 | turn << 20) | np.arange(len(at), dtype=np.uint64) // _U(SETTLED)) % _U(buckets)
                yield _packed(where, True, doc[at], tag[at], pair[at], anchor[at], code[at])
            at = np.flatnonzero(~settled & ~again)
            if len(at):
                # Anchors are the least of many hashes, so they have to be mixed for all buckets to be of one size.
                even = W.mix(anchor[at])
                yield _packed(((even >> _U(32)) * _U(buckets)) >> _U(32), False, doc[at], tag[at], pair[at], even, code[at])

    return run


def _replies(doc: np.ndarray, tag: np.ndarray, pair: np.ndarray, kind: np.ndarray, shares: int) -> pa.Table:
    """One row for each share of the documents that occurs: its documents, their pairs of each kind by number, the pairs."""
    share = W.mix(doc.view(np.uint64) * _MUL ^ tag) % _U(shares)
    order = np.lexsort((kind, tag, doc, share))
    doc, tag, pair, kind, share = doc[order], tag[order], pair[order], kind[order], share[order]
    first, edges, row = _grouped(share, doc, tag)
    rows = np.append(first, len(doc))
    counts = np.bincount(np.repeat(np.arange(len(first)), np.diff(rows)) * 3 + kind, minlength=3 * len(first))
    row |= {"share": pa.array(share[rows[edges[:-1]]].astype(np.int32)), "counts": _blobs(_narrow(counts), 3 * edges), "pairs": _blobs(pair, rows[edges])}
    names = [x.split()[0] for x in _REPLY.split(", ")]
    return pa.Table.from_arrays([row[x] for x in names], names=names)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What all buckets reply to a share of the documents, by document."""
    got = []
    for batch in batches:
        for i in range(batch.num_rows):
            d, t = _documents(batch, i)
            counts = _numbers(batch, "counts", i, 3 * len(d)).astype(np.int64)
            of = np.repeat(np.arange(len(d)), counts.reshape(-1, 3).sum(1))
            got.append((d[of], t[of], np.repeat(np.tile(np.arange(3, dtype=np.int8), len(d)), counts), _numbers(batch, "pairs", i, np.uint64)))
    doc, tag, kind, pair = (np.concatenate(x) for x in zip(*got, strict=True))
    del got
    order = np.lexsort((kind, tag, doc))
    doc, tag, kind, pair = doc[order], tag[order], kind[order], pair[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]))
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    every = np.arange(len(first) + 1)
    cols = [_blobs(pair[kind == c], np.searchsorted(group[kind == c], every)) for c in range(3)]
    cols = [pa.array(doc[first]), pa.array(tag[first].astype(np.int64)), *cols]
    yield from pa.Table.from_arrays(cols, names=["d", "tag", "covered", "shown", "hot"]).to_batches()


def _numbers(batch: pa.RecordBatch, column: str, i: int, kind) -> np.ndarray:
    """Numbers of one row, of a type or, if `kind` tells how many they are, as wide as they then must be."""
    blob = batch.column(column)[i].as_buffer()
    return np.frombuffer(blob, f"u{blob.size // kind}" if isinstance(kind, int) else kind)


def _several(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which entries have a code that is not 0 and that another of their group has as well."""
    _, at, n = np.unique(group << 24 | code, return_inverse=True, return_counts=True)
    return (code > 0) & (n[at] > 1)


def _settle(hot: int, shares: int):
    """For each document of a bucket, packed by share of the documents: its pairs that are covered, those to show, and those to show string by string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for i in range(batch.num_rows):
                docs, tags = _documents(batch, i)
                counts, pair = _numbers(batch, "counts", i, len(tags)), _numbers(batch, "pairs", i, np.uint64)
                doc, tag = np.repeat(docs, counts), np.repeat(tags, counts)
                if batch.column("settled")[i].as_py():
                    yield from _replies(doc, tag, pair, np.zeros(len(pair), np.int8), shares).to_batches()
                else:
                    got.append((doc, tag, pair, _numbers(batch, "anchors", i, np.uint32), _numbers(batch, "codes", i, np.uint16).reshape(-1, 3) @ _PARTS))
        if got:
            doc, tag, pair, anchor, code = (np.concatenate(x) for x in zip(*got, strict=True))
            del got
            order = np.lexsort((doc, pair, anchor))
            doc, tag, pair, anchor, code = doc[order], tag[order], pair[order], anchor[order], code[order]
            fresh = np.append(True, anchor[1:] != anchor[:-1])
            new = np.append(True, pair[1:] != pair[:-1]) | fresh
            group = np.cumsum(new) - 1
            covered = doc > doc[new][group]
            # Different segments of each anchor, and those that may have a string in common with another one.
            of, code = np.cumsum(fresh[new]) - 1, code[new]
            kinds, open_ = np.bincount(of), np.bincount(of, code == 0)
            met = np.flatnonzero(kinds[of] > 1)
            like = np.zeros(len(of), bool)
            like[met] = (open_[of[met]] > 0) | _several(of[met], code[met] >> 24) | _several(of[met], code[met] & _CODE)
            many = np.bincount(of, like)[of] > hot
            use = covered | like[group]
            if use.any():
                kind = np.where(covered, 0, np.where(many[group], 2, 1)).astype(np.int8)
                yield from _replies(doc[use], tag[use], pair[use], kind[use], shares).to_batches()

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and rows of a column of arrays of packed numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    blobs, rows = column.flatten(), column.value_parent_indices().to_numpy()
    data, offsets = W.utf8(blobs)
    return np.frombuffer(data.tobytes(), np.uint64), np.repeat(rows, np.diff(offsets) // 8)


def _match(pair: np.ndarray, row: np.ndarray, column: pa.Array) -> np.ndarray:
    data, offsets = W.utf8(column)
    values, rows = np.frombuffer(data.tobytes(), np.uint64), np.repeat(np.arange(len(column)), np.diff(offsets) // 8)
    salt = lambda p, r: W.mix(p ^ (r.astype(np.uint64) * _MUL))
    return np.isin(salt(pair, row), salt(values, rows))


def _merged(starts: np.ndarray, ends: np.ndarray, row: np.ndarray, reach: int):
    """Union of ranges that are ordered by row and start; none is longer than the largest gap that `reach` sets apart."""
    if not len(starts):
        return starts, ends, row
    lift = row * reach
    top = np.maximum.accumulate(ends + lift)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] + lift[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], top[last] - lift[first], row[first]


def _ranges(starts: np.ndarray, ends: np.ndarray, row: np.ndarray, ids: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """Rows of covered ranges, one per row that has any; `row` is ascending."""
    mine, edge = np.unique(row, return_index=True)
    edge, n = np.append(edge, len(row)), len(mine)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[mine], pa.int64()), pa.array(docs[mine], pa.int64()), _blobs(starts.astype(np.int64), edge), _blobs(ends.astype(np.int64), edge)]
        + [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
        names=[x.split()[0] for x in _FOUND.split(", ")],
    )


def _contents(key: np.ndarray, at: np.ndarray, content: np.ndarray, edge: np.ndarray, ids: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(docs, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        + [pa.array(W.mix(key).view(np.int64)), pa.array(at, pa.int64()), _blobs(content, edge)],
        names=[x.split()[0] for x in _FOUND.split(", ")],
    )


def _show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges that are covered as whole segments, and the segments (or strings) that the transform has to compare."""
    for batch in batches:
        data, offsets = W.utf8(batch.column("text"))
        keys, docs = batch.column("k").to_numpy(), batch.column("d").to_numpy()
        for i, j in W.slices(offsets, SLICE):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            a, pair, r, first, size = segments(part, at)
            covered, shown, hot = (_match(pair, r, batch.column(c).slice(i, j - i)) for c in ("covered", "shown", "hot"))
            ids, doc = keys[i:j], docs[i:j]
            s, e, row = _merged(first[covered] - at[r[covered]], first[covered] + size[covered] + MIN_BYTES - 1 - at[r[covered]], r[covered], len(part) + 1)
            yield _ranges(s, e, row, ids, doc)
            m = np.flatnonzero(shown & ~covered)
            length = size[m] + MIN_BYTES - 1
            edge = np.concatenate([[0], np.cumsum(length)])
            if len(m):
                content = part[np.repeat(first[m] - edge[:-1], length) + np.arange(edge[-1])]
                yield _contents(a[m], first[m] - at[r[m]], content, edge, ids[r[m]], doc[r[m]])
            h = np.flatnonzero(hot & ~covered)
            if not len(h):
                continue
            begin = np.repeat(first[h] - (np.cumsum(size[h]) - size[h]), size[h]) + np.arange(int(size[h].sum()))
            row = np.repeat(r[h], size[h])
            content = part[begin[:, None] + np.arange(MIN_BYTES)]
            key = W.mix((_BYTE[content] * _powers(_MUL, MIN_BYTES)).sum(axis=1, dtype=np.uint64))
            # Of equal strings here only the smallest document's go on, so that a string of very many texts makes no large shard.
            order = np.lexsort((doc[row], key))
            new = np.append(True, key[order][1:] != key[order][:-1])
            least = np.empty(len(key), np.int64)
            least[order] = doc[row][order][new][np.cumsum(new) - 1]
            over = doc[row] > least
            yield _ranges(*_merged(begin[over] - at[row[over]], begin[over] + MIN_BYTES - at[row[over]], row[over], len(part) + 1), ids, doc)
            go = ~over
            n = int(go.sum())
            yield _contents(key[go], (begin - at[row])[go], content[go].reshape(-1), np.arange(n + 1) * MIN_BYTES, ids[row[go]], doc[row[go]])


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of `text` in the order of what follows each, compared over 64 bytes: 8 at first, then by doubling."""
    n = len(text)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key[: n - k] |= text[k:].astype(np.uint64) << _U(56 - 8 * k)
    for width in (8, 16, 32, 64):
        order = np.argsort(key)
        step = np.ones(n, np.uint64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(step)
        if width == 64 or rank[order[-1]] == n - 1:
            return order
        key = (rank + _U(1)) << _U(32)
        key[: n - width] |= rank[width:] + _U(1)
    return order


def owners(contents: np.ndarray, edges: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each byte of the concatenated `contents` the smallest document with the MIN_BYTES bytes from there on, as far
    as they lie in one content and occur elsewhere; _LAST otherwise. `docs`: the document of each content.

    A zero follows each content. Intervals of the suffix order are held as runs of rows of one label. The row of a place
    one byte back (by the inverse order) extends the string to the left: rows of one interval that extend by the same
    byte form the interval of the longer string. Intervals of one row are given up, as are places whose content is too
    short to the left to reach MIN_BYTES.
    """
    lens = np.diff(edges)
    starts = edges[:-1] + np.arange(len(lens))
    n = len(contents) + len(lens)
    home = np.repeat(np.arange(len(lens)), lens + 1)
    off = np.arange(n) - starts[home]
    real = off < lens[home]
    text = np.zeros(n, np.uint8)
    text[real] = contents
    order = suffix_order(text)
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    label = np.full(n, -1, np.int64)
    at = np.flatnonzero(real & (off >= MIN_BYTES - 1))
    label[row_of[at]] = text[at]
    rows = np.flatnonzero(label >= 0)
    for width in range(1, MIN_BYTES + 1):
        new = np.ones(len(rows), bool)
        new[1:] = label[rows[1:]] != label[rows[:-1]]
        group = np.cumsum(new) - 1
        alive = np.bincount(group, minlength=1)[group] > 1 if len(rows) else new
        rows, group = rows[alive], group[alive]
        if width == MIN_BYTES or not len(rows):
            break
        back = order[rows] - 1
        ahead = row_of[back]
        label[rows] = -1
        label[ahead] = (group << 8) | text[back]
        rows = np.sort(ahead)
    owner = np.full(n, _LAST, np.int64)
    if len(rows):
        first = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        place = order[rows]
        least = np.minimum.reduceat(docs[home[place]], first)
        owner[place] = np.repeat(least, np.diff(np.append(first, len(rows))))
    return owner[real]


def _compare(table: pa.Table) -> pa.Table:
    """Ranges of a shard's contents that a smaller document owns."""
    keys, docs, at = (table[c].to_numpy() for c in ("k", "d", "at"))
    data, edges = W.utf8(table["content"].cast(pa.large_binary()))
    home = np.repeat(np.arange(len(docs)), np.diff(edges))
    place = np.flatnonzero(owners(data, edges, docs) < docs[home])
    home = home[place]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (home[1:] != home[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1 if len(place) else first
    h = home[first]
    s = place[first] - edges[h] + at[h]
    e = place[last] - edges[h] + at[h] + MIN_BYTES
    mine, edge = np.unique(h, return_index=True)
    edge = np.append(edge, len(h))
    return pa.Table.from_arrays([pa.array(keys[mine], pa.int64()), _blobs(s.astype(np.int64), edge), _blobs(e.astype(np.int64), edge)], names=["k", "starts", "ends"])


_CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first: long, last: long>>, kept string"


def _cut(names: list[str], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            s, row = _flat(batch.column("starts"))
            e, _ = _flat(batch.column("ends"))
            s, e = s.astype(np.int64), e.astype(np.int64)
            order = np.lexsort((s, row))
            s, e, row = _merged(s[order], e[order], row[order], int(offsets[-1]) + 1)
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out = []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                a, b = s[edge[i] : edge[i + 1]], e[edge[i] : edge[i + 1]]
                keep = [text[x:y] for x, y in zip([0, *b], [*a, len(text)], strict=True)]
                sha = hashlib.sha256()
                for x in keep:
                    sha.update(x)
                row_out = {"n_bytes": len(text), "n_removed": int((b - a).sum()), "n_spans": len(a), "kept_sha256": sha.hexdigest()}
                row_out["spans"] = [{"first": int(x), "last": int(y)} for x, y in zip(a, b, strict=True)] if whole else None
                row_out["kept"] = b"".join(x.tobytes() for x in keep).decode(errors="ignore") if whole else None
                out.append(row_out)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.string()]
            cols = [pa.array([x[c] for x in out], t) for c, t in zip(["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + cols, names=[*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, extra: tuple[str, ...] = ("doc_id",), whole: bool = False, hot: int = HOT) -> DataFrame:
    """`extra` columns of `docs` (doc_id, text, ...), n_bytes, n_removed, n_spans, kept_sha256, and if `whole` the removed
    spans and the kept text (bytes of characters that a cut parts are left out of that text only).

    A byte is removed if a string of MIN_BYTES bytes that covers it also starts in a document of smaller doc_id; all is
    judged on the input. Null texts are empty; rows that repeat a doc_id are no smaller than each other, so a string has
    to stand in another document as well; null doc_ids count as largest; an empty table gives an empty result.

    No group grows with a passage: copies in one batch travel as one, an anchor of many different segments is dealt
    string by string, and what a document is told back is bounded by its own length.
    """
    W.bound_batches(docs.sparkSession)
    # Rows are told apart by a hash of doc_id and text: equal rows share what they are told. On the way there 32 bits of it
    # do, with the doc_id: what is told of a segment is the same for all rows of one doc_id.
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", "text"))
    slim = keyed.select(F.col("_k").alias("k"), F.coalesce("doc_id", F.lit(_LAST)).alias("d"), F.col("_k").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = total // BUCKET_BYTES + 1
    shares = buckets // SHARED + 1
    dealt = slim.mapInArrow(_deal(buckets), _DEALT)
    # Replies travel packed by share: a row for every document and bucket would be the square of the input. Each table is
    # written before the next step, so that what was shuffled for it leaves the disk.
    told = dealt.groupBy("bucket").applyInArrow(_settle(hot, shares), _REPLY).groupBy("share").applyInArrow(_gather, _TOLD)
    told = materialize(told, "told")
    found = slim.join(told, ["d", "tag"]).select("k", "d", "text", "covered", "shown", "hot").mapInArrow(_show, _FOUND)
    found = materialize(found, "segments")
    discard(told)
    shown = found.where(F.col("content").isNotNull())
    # Shards follow the bytes that are really shown, which overlap.
    shards = (shown.agg(F.sum(F.octet_length("content"))).first()[0] or 0) // SHARD_BYTES + 1
    owned = shown.withColumn("shard", F.pmod("key", F.lit(shards))).groupBy("shard").applyInArrow(_compare, _SPANS)
    spans = found.where(F.col("content").isNull()).select("k", "starts", "ends").unionByName(owned)
    spans = spans.groupBy("k").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends")).withColumnRenamed("k", "_k")
    spans = materialize(spans, "spans")
    discard(found)
    joined = keyed.select("_k", F.col("text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(extra)]).join(spans, "_k", "left")
    empty = F.array().cast("array<binary>")
    joined = joined.withColumns({"starts": F.coalesce("starts", empty), "ends": F.coalesce("ends", empty)}).drop("_k")
    names = [f"_{i}" for i in range(len(extra))]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{n}` {kinds[c]}" for n, c in zip(names, extra, strict=True)) + ", " + _CUT
    out = joined.mapInArrow(_cut(names, whole), schema)
    out = out.withColumnsRenamed(dict(zip(names, extra, strict=True)))
    return out if whole else out.drop("spans", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents without the repeated passages."""
    # Other columns travel under names of their own, whatever they are called.
    names = {c: f"_x{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    slim = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()])
    out = remove_repeats(slim, ("doc_id", *names.values()), whole=True)
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    made |= {c: F.col(n) for c, n in names.items()}
    return out.select(*[made[c].alias(c) for c in docs.columns])
