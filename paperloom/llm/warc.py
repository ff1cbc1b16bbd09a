"""WARC archives as a chunked record table: written and read by Spark's own files, payloads in bounded pieces."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.words import bound_batches
from paperloom.session import shared_dir

#: Characters of a chunk at most; a longer payload becomes a first segment and continuation records.
CHUNK_CHARS = 1 << 16
#: The date that all records carry, so that reruns write the same bytes.
DATE = "2026-01-01T00:00:00Z"
#: What begins every record, and with it parts the records of a file. Payloads never hold it: they are cut inside it.
MARK = "WARC/1.1\r\nWARC-Type: "
_CUT = r"(?<=\QWARC/1.1" + "\r\n" + r"WARC\E)(?=-Type: )"
_B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: every 20 bits (five hexadecimal digits) give four characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), *_B32)


def chunks(payload: Column) -> Column:
    """Array of the pieces of `payload` in order, one at least, none longer than CHUNK_CHARS or holding MARK."""

    def pieces(text: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil(F.length(text) / CHUNK_CHARS).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS))
        )

    whole = (F.length(payload) <= CHUNK_CHARS) & (F.instr(payload, MARK) == 0)
    return F.when(whole, F.array(payload)).otherwise(F.flatten(F.transform(F.split(payload, _CUT, -1), pieces)))


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, n_bytes, row, response and first (page_id and row of the record that others refer to).

    Of equal payloads (by SHA-1), the largest page_id responds and the others revisit it. Rows that repeat that page_id
    and payload respond each; null page_ids revisit, or respond if there is no other. Null html is an empty payload.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    p = p.withColumn("digest", base32_sha1(F.col("payload")))
    best = p.groupBy(F.col("digest").alias("_d")).agg(F.max("page_id").alias("response"), F.max_by("row", F.struct("page_id", -F.col("row"))).alias("first"))
    return p.join(best, F.col("digest") == F.col("_d")).drop("_d").withColumn("n_bytes", F.octet_length("payload").cast("long"))


def records(pages: DataFrame) -> DataFrame:
    """The chunked record table: record_id, chunk_no (from 1), n_chunks, block_digest and the record's text."""
    t = typed(pages).withColumn("revisit", ~F.col("page_id").eqNullSafe(F.col("response")))
    shown = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    # A record that others may refer to is named by page and digest; only repeats of one row need more.
    t = t.withColumn("record_id", F.concat(F.lit("urn:page:"), shown, F.lit(":"), "digest", F.when(F.col("row") == F.col("first"), "").otherwise(F.concat(F.lit("."), "row"))))
    t = t.withColumn("parts", F.when(F.col("revisit"), F.array(F.lit(""))).otherwise(chunks(F.col("payload"))))
    t = t.withColumn("n_chunks", F.size("parts")).select("*", F.posexplode("parts").alias("at", "block"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    first = F.col("at") == 0
    many = F.col("n_chunks") > 1
    kind = F.when(F.col("revisit"), "revisit").when(first, "response").otherwise("continuation")
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "%20")
    text = F.concat(
        F.lit(MARK), kind, F.lit("\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.when(first, "").otherwise(F.concat(F.lit(":"), "at")), F.lit(">"))),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("block")))),
        line("WARC-Payload-Length", F.col("n_bytes")),
        F.when(F.col("revisit"), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), "response", F.lit(":"), "digest", F.lit(">"))))).otherwise(""),
        F.when(many, line("WARC-Segment-Number", F.col("at") + 1)).otherwise(""),
        F.when(many & ~first, line("WARC-Segment-Origin-ID", F.concat(F.lit("<"), "record_id", F.lit(">")))).otherwise(""),
        F.when(many & (F.col("at") + 1 == F.col("n_chunks")), line("WARC-Segment-Total-Length", F.col("n_bytes"))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"), "block",
    )
    return t.select("record_id", (F.col("at") + 1).alias("chunk_no"), "n_chunks", F.sha1("block").alias("block_digest"), text.alias("text"))


def write(pages: DataFrame, path: str) -> None:
    """Archives of `pages`, one gzip file per task; retried and lost tasks are settled by Spark's committer."""
    records(pages).select("text").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of archives: kind, record_id, page_id, chunk_no, payload_digest, payload_bytes, refers_to, block."""
    raw = spark.read.option("lineSep", MARK).text(path).where(F.col("value") != "")
    raw = raw.withColumn("head", F.substring_index("value", "\r\n\r\n", 1))
    of = lambda name, pattern: F.regexp_extract("head", rf"(?m)^{name}: {pattern}\r?$", 1)
    origin, own = of("WARC-Segment-Origin-ID", r"<([^>]*)>"), of("WARC-Record-ID", r"<([^>]*)>")
    number = of("WARC-Segment-Number", r"(\d+)")
    return raw.select(
        F.substring_index("head", "\r\n", 1).alias("kind"),
        F.when(origin == "", own).otherwise(origin).alias("record_id"),
        F.when(number == "", F.lit(0)).otherwise(F.expr("try_cast(regexp_extract(head, '(?m)^WARC-Segment-Number: ([0-9]+)', 1) AS INT)")).alias("chunk_no"),
        of("WARC-Payload-Digest", r"sha1:(\w+)").alias("payload_digest"),
        of("WARC-Payload-Length", r"(\d+)").cast("long").alias("payload_bytes"),
        F.nullif(of("WARC-Refers-To", r"<urn:page:(-?\d+):\w+>"), F.lit("")).cast("long").alias("refers_to"),
        F.expr("substring(value, length(head) + 5, length(value) - length(head) - 8)").alias("block"),
    ).withColumn("page_id", F.expr("try_cast(split_part(record_id, ':', 3) AS LONG)"))


_JOINED = "record_id string, payload_bytes long, payload_digest string"


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and SHA-1 of each run of chunks of one record, carried from chunk to chunk and batch to batch."""
    import base64

    current, size, sha = None, 0, None

    def row():
        digest = base64.b32encode(sha.digest()).decode()
        return pa.RecordBatch.from_pydict({"record_id": [current], "payload_bytes": pa.array([size], pa.int64()), "payload_digest": [digest]})

    for batch in batches:
        for key, block in zip(batch.column("record_id"), batch.column("block"), strict=True):
            if key.as_py() != current:
                if current is not None:
                    yield row()
                current, size, sha = key.as_py(), 0, hashlib.sha1()
            data = block.as_buffer()
            sha.update(data)
            size += data.size
    if current is not None:
        yield row()


def verify(chunk_rows: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, whole.

    Length and digest of a response come from the payload as read; `whole` says that they are those of its header. A
    record in one piece is digested as it is read. Chunks of a longer one meet in order in one task, which keeps a
    running digest and one batch of chunks, never a payload.
    """
    bound_batches(chunk_rows.sparkSession)
    cols = ["page_id", "record_type", "refers_to"]
    named = chunk_rows.withColumnRenamed("kind", "record_type").withColumnsRenamed(
        {"payload_digest": "_digest", "payload_bytes": "_bytes"}
    )
    single = named.where(F.col("chunk_no") == 0)
    response = F.col("record_type") == "response"
    single = single.select(
        *cols,
        F.when(response, F.octet_length("block").cast("long")).otherwise(F.col("_bytes")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("block"))).otherwise(F.col("_digest")).alias("payload_digest"),
        "_bytes",
        "_digest",
    )
    several = named.where(F.col("chunk_no") > 0)
    joined = (
        several.select("record_id", "chunk_no", "block")
        .repartition("record_id")
        .sortWithinPartitions("record_id", "chunk_no")
        .select("record_id", "block")
        .mapInArrow(_digest_runs, _JOINED)
    )
    heads = several.where(F.col("chunk_no") == 1).select(*cols, F.col("record_id").alias("_r"), "_bytes", "_digest")
    several = heads.join(joined, F.col("_r") == F.col("record_id")).select(*single.columns)
    whole = (F.col("_bytes") == F.col("payload_bytes")) & (F.col("_digest") == F.col("payload_digest"))
    return single.unionByName(several).withColumn("whole", whole).drop("_bytes", "_digest")


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write `pages` (page_id, url, html; others play no part) to archives in `path` and read them back, verified.

    The default path is a new one in the shared folder. Rows that repeat page_id and html are records each, with ids of
    their own. An empty table gives archives without records, and no rows.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return verify(read(spark, path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one small archive, by Content-Length: the tests' independent reader."""
    found, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        head = {"": lines[0]} | dict(re.split(": ", x, maxsplit=1) for x in lines[1:])
        at = end + 4 + int(head["Content-Length"])
        found.append((head, data[end + 4 : at]))
        at += 4
    return found


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS n, sha1(payload) AS h FROM p
), b AS (
  SELECT page_id, n, h,
         array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST(concat('0x', substr(h, CAST(5 * i + 1 AS BIGINT), 5)) AS BIGINT) >> s) & 31), 1)), '')), '') AS digest,
         max(page_id) OVER (PARTITION BY h) AS top
  FROM d
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM b
"""
