"""Words of texts, as column expressions and as numpy kernels over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.session import bound_batches  # noqa: F401

#: White space that parts words; anything else belongs to a word.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACES]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_U64 = np.uint64

#: Bytes of text that a kernel works on at once; bounds the memory of its numpy arrays.
SLICE_BYTES = 1 << 20


def let(value: Column, use) -> Column:
    """`use` applied to `value`, which is computed once even where `use` names it in nested lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def free(columns: list[str], *names: str) -> list[str]:
    """`names` with as many underscores in front as it takes for none to be one of `columns`, in any case of letters."""
    taken, prefix = {c.lower() for c in columns}, ""
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def words(text: Column) -> Column:
    """Array of the words of `text`; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of `text` (long; null: 0)."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit values over all bits."""
    h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
    return h ^ (h >> _U64(31))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column and their len + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, ends, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(ends, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; `gaps` tells of each of the 256 bytes whether it parts words."""
    solid = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, of its lower-cased (A-Z) bytes if `lower`."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    at = np.arange(int(lens.sum())) - np.repeat(first, lens)
    power = np.full(int(lens.max()), _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    chars = data[np.repeat(starts, lens) + at]
    values = ((_LOWER[chars] if lower else chars).astype(np.uint64) + _U64(1)) * power[at]
    return mix(np.add.reduceat(values, first) ^ (lens.astype(np.uint64) << _U64(48)))


def shingles(word: np.ndarray, row: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each distinct shingle of `size` words, ordered by row and hash.

    A row with fewer words, but one at least, has its whole sequence as the only shingle.
    """
    counts = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out_h, out_r = [], []
    if len(word) >= size:
        n = len(word) - size + 1
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h = h * _U64(0xD6E8FEB86659FD93) + word[k : k + n]
        whole = row[:n] == row[size - 1 :]
        out_h.append(mix(h[whole]))
        out_r.append(row[:n][whole])
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        h = np.uint64(counts[r])
        for w in word[first[r] : first[r] + counts[r]]:
            h = _U64((int(h) * 0xD6E8FEB86659FD93 + int(w)) & 0xFFFFFFFFFFFFFFFF)
        out_h.append(mix(np.array([h], np.uint64)))
        out_r.append(np.array([r]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(out_h), np.concatenate(out_r).astype(np.int64)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]
