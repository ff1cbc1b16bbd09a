"""Importance resampling of documents towards a target distribution of hashed word features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.ranges import placed
from paperloom.session import held, keyed, materialize

MAX_RUN, BUCKETS = 1, 10_000
MIN_WORDS, DRAW_PERCENT, SEED = 20, 10, "2024"
#: Features that are hashed at once; bounds the memory that a very long text needs.
CHUNK = 1 << 18

#: Blocks that a task reads at once; Spark's own number (4096) is more than its memory holds where a file has hundreds.
READ, READ_BLOCKS = "spark.sql.parquet.columnarReaderBatchSize", 16

#: Bytes that part words: all ASCII but digits and letters. Case is folded first.
_GAPS = np.ones(256, bool)
_GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: What a byte does to the running CRC-32 of reflected polynomial 0xEDB88320.
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1)).astype(np.uint32)
#: Fewer features than this are finished one by one.
_FEW = 64

_BLOCK = "doc_id array<long>, n_words array<long>, starts array<long>, bucket array<int>, n array<int>"
_COUNT = "bucket int, n long"
_WEIGHT = "doc_id long, n_words long, n_features long, weight long"


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of bytes; all ranges take their next byte at once, longest ranges first."""
    order = np.argsort(starts - ends, kind="stable")
    at, left = starts[order], (starts - ends)[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    k, n = 0, int(np.searchsorted(left, 0))
    while n > _FEW:
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + k]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
        k += 1
        n = int(np.searchsorted(left, -k))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(n):
        crc[i] = zlib.crc32(data[at[i] + k : at[i] - left[i]].tobytes(), int(crc[i]))
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _counts(data: np.ndarray, offsets: np.ndarray, max_run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row; row * buckets + bucket of all features, distinct and ascending, and how often each occurs."""
    starts, ends, row = W.spans(data, offsets, _GAPS)
    n_rows, size = len(offsets) - 1, ends - starts
    # Words with one space after each, where the row goes on: every run of words is a range of these bytes.
    solid = ~_GAPS[data]
    follows = np.zeros(len(data) + 1, bool)
    follows[ends[ends < offsets[row + 1]]] = True
    kept = solid | follows[:-1]
    text = np.where(solid, W._LOWER[data], np.uint8(0x20))[kept]
    step = size + (ends < offsets[row + 1])
    starts = np.cumsum(step) - step
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for run in range(1, max_run + 1):
        for i in range(0, len(starts) - run + 1, CHUNK):
            j = min(i + CHUNK, len(starts) - run + 1)
            last = slice(i + run - 1, j + run - 1)
            whole = row[i:j] == row[last]
            bucket = crc32(text, starts[i:j][whole], (starts + size)[last][whole]) % np.uint32(buckets)
            key, n = np.unique(row[i:j][whole] * buckets + bucket, return_counts=True)
            keys.append(key)
            times.append(n)
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    return np.bincount(row, minlength=n_rows), keys, np.bincount(at, np.concatenate(times), len(keys)).astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], max_run: int, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.utf8(batch.column("text"))
        for i, j in W.slices(offsets):
            n_words, keys, times = _counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], max_run, buckets)
            starts = np.searchsorted(keys, np.arange(j - i + 1) * buckets)
            row = [batch.column("doc_id").slice(i, j - i), n_words, starts, (keys % buckets).astype(np.int32), times.astype(np.int32)]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in row]
            yield pa.RecordBatch.from_arrays(lists, names=["doc_id", "n_words", "starts", "bucket", "n"])


def matrix(docs: DataFrame, max_run: int = MAX_RUN, buckets: int = BUCKETS) -> DataFrame:
    """The sparse matrix of documents by buckets, in blocks of compressed sparse rows, written once.

    A block holds about a megabyte of texts: doc_id and n_words of its rows, `starts` (a number more than rows) into the
    buckets that occur in each row, ascending, and `n`, how often. Null and empty texts are rows without buckets.
    """
    W.bound_batches(docs.sparkSession)
    return materialize(docs.select("doc_id", "text").mapInArrow(lambda t: _blocks(t, max_run, buckets), _BLOCK), "blocks")


def _column_sums(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in batches:
        at, n = batch.column("bucket").flatten().to_numpy(), batch.column("n").flatten().to_numpy()
        total += np.bincount(at, n, buckets).astype(np.int64)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def distribution(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the column sums of a matrix; each task gives a row for each bucket at most."""
    sums = blocks.select("bucket", "n").mapInArrow(lambda t: _column_sums(t, buckets), _COUNT)
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket, 1000 times the logarithm of its share in `target` against `source`, both smoothed by one; floored.

    These are `buckets` numbers, whatever the input, so they may pass through the driver.
    """
    both = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets)
    found = both.join(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(up / down)).alias("gain")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in found]] = [r["gain"] for r in found]
    return out


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            doc_id, n_words, starts, bucket, n = (batch.column(c)[k].values for c in ("doc_id", "n_words", "starts", "bucket", "n"))
            starts, n = starts.to_numpy(), n.to_numpy().astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)])[starts] for x in (n, n * gain[bucket.to_numpy()])]
            features, product = (np.diff(x) for x in sums)
            weight = np.where(features > 0, product // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([doc_id, n_words, pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_run: int = MAX_RUN,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    draw_percent: int = DRAW_PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (long): one row per row of `docs` (doc_id, text), drawn towards `target` (text).

    Features are runs of 1 to `max_run` words, hashed to buckets. The matrices of both tables are written as blocks; their
    column sums give the gain of each bucket, and the product of a matrix with the gains, over the row's features, the
    weight. Of the documents with `min_words` words or more, `draw_percent` percent with the highest scores (weight plus
    Gumbel noise of `seed` and doc_id) are drawn without replacement and ranked from 1; ranks of all others are null.

    Null and empty texts have no features, weight 0 and are never drawn while min_words is positive. A null doc_id is
    noise of the bare seed and comes last among equal scores. Rows that repeat a doc_id are drawn each; of equal scores
    and doc_ids, fewer features, then the lower weight come first. Empty `docs` give an empty result; an empty `target`
    gives the gains of smoothing alone. Other columns play no part.
    """
    a = matrix(docs, max_run, buckets)
    b = matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), max_run, buckets)
    with held(docs.sparkSession, READ, str(READ_BLOCKS)):
        gain = gains(distribution(a, buckets), distribution(b, buckets), buckets)
        weights = keyed(a.mapInArrow(lambda t: _weigh(t, gain), _WEIGHT))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(named, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weights.withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= min_words
    order = [F.when(able, 0).otherwise(1), F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "_row"]
    drawn = rows.where(able).count() * draw_percent // 100
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    return placed(rows, order).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 of the UTF-8 bytes of `{0}`, given the column `tab` of CRC_TABLE.
CRC = """
xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
  list_transform(range(0, CAST(octet_length(encode({0})) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))
"""
CRC_TABLE = """
SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END)) AS tab
"""

SQL = rf"""
WITH crc AS ({CRC_TABLE}), d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), f AS (
  SELECT rid, unnest(w) AS w FROM d
), g AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), h AS (
  SELECT w, {CRC.format("w")} % 10000 AS bucket FROM (SELECT w FROM f UNION SELECT w FROM g), crc
), s AS (
  SELECT bucket, count(*) AS s FROM f JOIN h USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM g JOIN h USING (w) GROUP BY bucket
), a AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM f) + 10000)
         / (CAST(s + 1 AS DOUBLE) * ((SELECT count(*) FROM g) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)
), p AS (
  SELECT rid, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN h USING (w) JOIN a USING (bucket) GROUP BY rid
), w AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, CASE WHEN len(w) = 0 THEN 0 ELSE (total - ((total % len(w)) + len(w)) % len(w)) // len(w) END AS weight,
         CAST('0x' || substr(sha256(concat('2024:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN p USING (rid)
), c AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM w
), k AS (
  SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id NULLS LAST, n, weight) AS place FROM c
)
SELECT doc_id, n AS n_features, CAST(weight AS BIGINT) AS weight, score,
       CASE WHEN n >= 20 AND place <= 10 * (SELECT count(*) FROM c WHERE n >= 20) // 100 THEN place END AS rank
FROM k
"""
