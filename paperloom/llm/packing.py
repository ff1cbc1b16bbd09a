"""Mixture-controlled packing: deficit round-robin over source queues into sequences of fixed length."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.session import materialize

TOKENIZER, END_ID, SEQUENCE = "word_bpe_49k.json", 1, 2048
#: Tokens by which a queue is served; a queue whose share of a round is less saves it up.
QUANTUM = 256
#: Distinct words whose ids a Python worker remembers.
CACHE_WORDS = 600_000
# The vocabulary's pre-tokenizer on lower-case text of printable ASCII and Latin-1 letters.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
#: Characters by which a byte-level vocabulary writes the bytes that are not printable in Latin-1: from U+0100 on, in order.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_AS_BYTES = {c: "".join(_BYTES[b] for b in chr(c).encode()) for c in range(0xA1, 0x100)}

_TOKENS = "doc_id long, source string, part int, local long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Words on which the two ways to a word's ids are compared when a vocabulary is loaded.
PROBES = ("The", "Hello,", "it's", "WE'LL", "don't!?", "x2048y", "3.14", "(a+b)", "caf\u00e9", "\u00dcBER", "a_b-c", "''s", "#tag", "e.g.", "\u00df\u00e6\u00f8")


def id_type(tokenizer) -> type:
    """The narrowest type that holds all ids of a vocabulary."""
    return np.uint16 if max(tokenizer.get_vocab_size(), END_ID + 1) <= 1 << 16 else np.uint32


class WordIds:
    """Ids of words, each encoded once as long as the cache has room."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.kind = id_type(self.tokenizer)
        self.plain = True
        self._clear()
        # Pieces are only asked for one by one where the vocabulary splits words as PIECE does.
        self.plain = all(self._ids(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES)
        self._clear()

    def _clear(self):
        self.pieces: dict[str, list[int]] = {}
        self.index, self.first, self.count, self.pool, self.used = {}, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self.kind), 0

    def _ids(self, word: str) -> list[int]:
        """Ids of one word. The model is asked for each piece of a plain word once; any other word goes the whole way."""
        if not self.plain or not PLAIN.fullmatch(word) or "<|" in word:
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        out = []
        for piece in PIECE.findall(word.lower()):
            ids = self.pieces.get(piece)
            if ids is None:
                shown = piece if piece.isascii() else piece.translate(_AS_BYTES)
                ids = self.pieces[piece] = [t.id for t in self.model.tokenize(shown)]
            out += ids
        return out

    def _add(self, keys: np.ndarray, texts: list[str]) -> None:
        found = [self._ids(x) for x in texts]
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.kind, int(n.sum()))
        at = len(self.index)
        while len(self.first) < at + len(n):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while len(self.pool) < self.used + len(flat):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.first[at : at + len(n)] = self.used + np.cumsum(n) - n
        self.count[at : at + len(n)] = n
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.index.update(zip(keys.tolist(), range(at, at + len(n)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END_ID after each, and the number of ids of each text.

        The vocabulary's pre-tokenizer never joins what white space parts, so a text's ids are those of its words.
        """
        starts, ends, row = W.spans(data, offsets)
        keys, at, back = np.unique(W.hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.index) > CACHE_WORDS:
            self._clear()
        slot = np.array([self.index.get(k, -1) for k in keys.tolist()], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            raw = data.tobytes()
            slot[new] = len(self.index) + np.arange(len(new))
            self._add(keys[new], [raw[s:e].decode() for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        first, n = self.first[slot][back], self.count[slot][back]
        rows = len(offsets) - 1
        total = np.bincount(row, weights=n, minlength=rows).astype(np.int64) + 1
        ids = np.full(int(total.sum()), END_ID, self.kind)
        before = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(before, n)
        ids[np.repeat(before + row, n) + step] = self.pool[np.repeat(first, n) + step]
        return ids, total


@lru_cache(1)
def _encoder(file: str) -> WordIds:
    return WordIds(file)


def _tokenize(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ahead = TaskContext.get().partitionId(), {}
        for batch in batches:
            data, offsets = W.utf8(batch.column("text"))
            sources = batch.column("source").to_pylist()
            for i, j in W.slices(offsets):
                ids, n = _encoder(file).encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                local = []
                for s, k in zip(sources[i:j], n.tolist(), strict=True):
                    local.append(ahead.get(s, 0))
                    ahead[s] = local[-1] + k
                ends = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
                blob = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("source").slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(local, pa.int64()), pa.array(n), blob],
                    names=["doc_id", "source", "part", "local", "n", "ids"],
                )

    return run


def tokenize(docs: DataFrame, file: str) -> DataFrame:
    """doc_id, source, n and ids (see id_type) of each text, END_ID last, and its place: the partition that read it
    and the ids of its source ahead of it there. Written once, so that places never change."""
    W.bound_batches(docs.sparkSession)
    return materialize(docs.select("doc_id", "source", "text").mapInArrow(_tokenize(file), _TOKENS), "tokens")


class Rounds:
    """The schedule of the queues, in closed form, so that every task computes the places of its own documents.

    In round r of R, where R sequences hold all tokens, queue q of T tokens is served from served(q, r) to
    served(q, r + 1): its share r * T / R, rounded to whole quanta. What rounding leaves is the deficit that it carries
    on. Rounds follow one another, queues one another within a round, and sequences cut that stream every SEQUENCE tokens.
    """

    def __init__(self, totals: np.ndarray, sequence: int = SEQUENCE, quantum: int = QUANTUM):
        self.totals, self.quantum = totals, quantum
        self.rounds = max(1, -(-int(totals.sum()) // sequence))
        self.rate = totals / (self.rounds * quantum)

    def served(self, queue: np.ndarray, r: np.ndarray) -> np.ndarray:
        f = np.minimum(np.floor(r * self.rate[queue] + 0.5).astype(np.int64) * self.quantum, self.totals[queue])
        return np.where(r >= self.rounds, self.totals[queue], f)

    def round_of(self, queue: np.ndarray, t: np.ndarray) -> np.ndarray:
        r = np.ceil((t // self.quantum + 0.5) / self.rate[queue]).astype(np.int64) - 1
        r = np.clip(r, 0, self.rounds - 1)
        while (low := self.served(queue, r) > t).any():
            r = r - low
        while (high := self.served(queue, r + 1) <= t).any():
            r = r + high
        return r

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray):
        """Document, start in it, length and place in the stream of each piece that one round serves of a document."""
        low, high = self.round_of(queue, first), self.round_of(queue, first + n - 1)
        doc = np.repeat(np.arange(len(n)), high - low + 1)
        r = np.arange(len(doc)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1) + low[doc]
        a = np.maximum(first[doc], self.served(queue[doc], r))
        b = np.minimum(first[doc] + n[doc], self.served(queue[doc], r + 1))
        some = b > a
        doc, r, a, b = doc[some], r[some], a[some], b[some]
        place = np.empty(len(r), np.int64)
        rounds, back = np.unique(r, return_inverse=True)
        every = np.arange(len(self.totals))
        step = max(1, (1 << 20) // len(every))
        for i in range(0, len(rounds), step):
            here = self.served(every[None, :], rounds[i : i + step, None])
            more = self.served(every[None, :], rounds[i : i + step, None] + 1) - here
            starts = here.sum(axis=1)[:, None] + np.cumsum(more, axis=1) - more - here
            mine = np.flatnonzero((back >= i) & (back < i + step))
            place[mine] = starts[back[mine] - i, queue[doc[mine]]] + a[mine]
        return doc, a - first[doc], b - a, place


def _cut(totals: list[int], sequence: int, quantum: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Rounds(np.array(totals, np.int64), sequence, quantum)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            first = batch.column("first").to_numpy()
            doc, start, length, place = plan.pieces(batch.column("queue").to_numpy().astype(np.int64), first, n)
            cuts = (place + length - 1) // sequence - place // sequence + 1
            k = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            doc, start, length, place = (np.repeat(x, cuts) for x in (doc, start, length, place))
            a = np.maximum(place, (place // sequence + k) * sequence)
            b = np.minimum(place + length, (place // sequence + k + 1) * sequence)
            start, length = start + a - place, b - a
            ids = [np.frombuffer(x.as_buffer(), kind).astype("<u4") for x in batch.column("ids")]
            crc = [zlib.crc32(ids[d][s : s + m]) for d, s, m in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(a // sequence), pa.array(a % sequence)],
                names=[x.split()[0] for x in _PIECES.split(", ")],
            )

    return run


def pack(docs: DataFrame, file: str, sequence: int = SEQUENCE, quantum: int = QUANTUM) -> DataFrame:
    """Pieces of the documents (doc_id, source, text; other columns play no part) in sequences, see _PIECES.

    Each id of a document lies in one piece; every sequence but the last is full, and holds the sources in proportion to
    their tokens within a quantum. Null and empty texts have END_ID alone; null sources are one source; rows that repeat
    a doc_id are packed each; an empty table gives no pieces. The driver knows one total per source. Texts are never shuffled: they become ids where they are
    read, and the start of each partition's share of a queue is a prefix sum over one row per partition and source.
    """
    tokens = tokenize(docs, file)
    parts = tokens.groupBy("source", "part").agg(F.sum("n").alias("sum"))
    rank = parts.select("source").distinct().withColumn("queue", ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)).cast("int"))
    rank = rank.withColumnRenamed("source", "_s")
    parts = parts.join(rank, F.col("source").eqNullSafe(F.col("_s")))
    ahead = Window.partitionBy("queue").orderBy("part", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "queue", "sum", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("begin"))
    parts = materialize(parts, "queues")
    totals = [r["t"] for r in parts.groupBy("queue").agg(F.sum("sum").alias("t")).orderBy("queue").collect()]
    placed = tokens.join(parts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
    placed = placed.select("doc_id", "queue", (F.col("begin") + F.col("local")).alias("first"), "n", "ids")
    from tokenizers import Tokenizer

    return placed.mapInArrow(_cut(totals or [1], sequence, quantum, id_type(Tokenizer.from_file(file))), _PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(TOKENIZER))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the pieces of the sequences."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path(TOKENIZER))
