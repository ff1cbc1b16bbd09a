"""Hashes, MinHash signatures and bit distances that must equal published values, as column expressions and one Arrow function."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import bound_batches

#: FNV-1a, 32 bits.
FNV_START, FNV_PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF
#: Slots of a signature, and the seed and constants of the generator of its permutations.
SLOTS, SEED, LCG_MUL, LCG_ADD = 128, 0x9E3779B9, 1664525, 1013904223
EMPTY_SLOT = 0x7FFFFFFF


def fnv1a(text: Column) -> Column:
    """FNV-1a of an ASCII text (comparison keys are), 0 to 2^32 - 1."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * FNV_PRIME).bitwiseAND(F.lit(MASK))
    return F.when(F.length(text) == 0, F.lit(FNV_START)).otherwise(F.aggregate(codes, F.lit(FNV_START).cast("long"), step))


def pseudonym(text: Column) -> Column:
    """Four base-36 digits that show nothing of an ASCII text. The product is rounded to a double on purpose: the codes
    that are in use were made so, and must stay."""
    codes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("long"))

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        signed = F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)
        return (signed.cast("double") * float(FNV_PRIME)).cast("long").bitwiseAND(F.lit(MASK))

    h = F.when(F.length(text) == 0, F.lit(FNV_START)).otherwise(F.aggregate(codes, F.lit(FNV_START).cast("long"), step))
    return F.right(F.concat(F.lit("0000"), F.conv(h.cast("string"), 10, 36)), F.lit(4))


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """Multiplier (odd) and addend of each slot."""
    x, out = SEED, []
    for _ in range(2 * SLOTS):
        x = (x * LCG_MUL + LCG_ADD) & MASK
        out.append(x)
    return np.array(out[::2], np.uint64) | np.uint64(1), np.array(out[1::2], np.uint64)


#: 32 bits wrap around by themselves.
_MULTIPLIERS, _ADDENDS = (x.astype(np.uint32) for x in permutations())
#: Hashes of a signature's step, and runs of words hashed at once: what they need stays in a core's cache.
_STEP, _RUNS = 512, 1 << 16


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash signature of 32-bit hashes: per slot the least of ((h * a + b) mod 2^32) / 2."""
    if not len(hashes):
        return np.full(SLOTS, EMPTY_SLOT, np.int32)
    h, least = np.asarray(hashes).astype(np.uint32), np.full(SLOTS, MASK, np.uint32)
    for i in range(0, len(h), _STEP):
        least = np.minimum(least, (h[i : i + _STEP, None] * _MULTIPLIERS + _ADDENDS).min(axis=0))
    return (least >> np.uint32(1)).astype(np.int32)


def _hash_runs(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """FNV-1a of `length` bytes of `data` from `first` on, for many runs at once; the longest stand in front."""
    out = np.empty(len(first), np.uint32)
    for i in range(0, len(first), _RUNS):
        left = -length[i : i + _RUNS]
        order = np.argsort(left, kind="stable")
        at, left = first[i : i + _RUNS][order], left[order]
        h, still = np.full(len(at), FNV_START, np.uint32), len(at)
        for k in range(-int(left[0])):
            if left[still - 1] >= -k:
                still = int(np.searchsorted(left, -k))
            h[:still] ^= data[at[:still]]
            h[:still] *= np.uint32(FNV_PRIME)
            at[:still] += 1
        out[i : i + _RUNS][order] = h
    return out


def run_hashes(key: str, size: int) -> np.ndarray:
    """FNV-1a of each distinct run of `size` words of a comparison key, which is ASCII with single blanks."""
    return batch_run_hashes([key], size)[0]


def batch_run_hashes(keys: list[str | None], size: int) -> list[np.ndarray]:
    """`run_hashes` of each of many keys, whose runs are hashed together, byte by byte."""
    first, length, counts, at = [], [], [], 0
    data = np.frombuffer("".join(k or "" for k in keys).encode(), np.uint8)
    for key in keys:
        n = len(key or "")
        blanks = np.flatnonzero(data[at : at + n] == 32) + at
        starts, ends = np.concatenate([[at], blanks + 1]), np.append(blanks, at + n)
        runs = max(0, len(starts) - size + 1) if n else 0
        first.append(starts[:runs])
        length.append(ends[len(ends) - runs :] - starts[:runs])
        counts.append(runs)
        at += n
    if not sum(counts):
        return [np.zeros(0, np.uint32) for _ in keys]
    h = _hash_runs(data, np.concatenate(first), np.concatenate(length))
    return [np.unique(x) for x in np.split(h, np.cumsum(counts)[:-1])]


def sign(df: DataFrame, key: str, size: int) -> DataFrame:
    """`df` with the column `key` replaced by n_shingles and signature of its runs of `size` words, in Arrow batches."""
    import pyarrow as pa

    bound_batches(df.sparkSession)
    kept = [c for c in df.columns if c != key]

    def run(batches):
        for batch in batches:
            hashes = batch_run_hashes(batch.column(key).to_pylist(), size)
            signs = np.concatenate([signature(h) for h in hashes]) if hashes else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1) * SLOTS, pa.int32()), pa.array(signs))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([len(h) for h in hashes], pa.int32()), lists], names=[*kept, "n_shingles", "signature"])

    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", n_shingles int, signature array<int>")


def containment(jaccard: Column, x: Column, y: Column) -> Column:
    """Share of the smaller of two sets (sizes `x`, `y`) that the other holds, from their Jaccard similarity."""
    small = F.least(x, y)
    return F.when(small == 0, 0.0).otherwise(F.least(F.lit(1.0), jaccard * (x + y) / (1 + jaccard) / F.nullif(small, F.lit(0))))


def median_bits(vector: Column) -> Column:
    """64-bit image hash of 64 numbers: bit i is set where number i exceeds their median."""
    # The sorted numbers and their median are bound once, not for each number.
    let = lambda value, of: F.element_at(F.transform(F.array(value), of), 1)
    middle = let(F.array_sort(vector), lambda s: (F.get(s, F.lit(32)).cast("double") + F.get(s, F.lit(31)).cast("double")) / 2)

    def bits(m: Column) -> Column:
        set_ = F.transform(vector, lambda x, i: F.when(x.cast("double") > m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(set_, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))

    return let(middle, bits)


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y))


def informative(h: Column) -> Column:
    """A hash of nearly all zeros or ones says nothing of its image."""
    return F.bit_count(h).between(16, 48)
