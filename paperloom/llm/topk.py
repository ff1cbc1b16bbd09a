"""Exact top-k inner-product search: a ball tree per shard, searched by branch and bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.session import materialize

SCALE, TOP, QUERY_EVERY = 256, 5, 50
#: Vectors of a shard, queries of a block and vectors of a leaf, about.
SHARD, BLOCK, LEAF = 8192, 2048, 64

_OUT = "query_id long, vec_id long, score long"


def scaled(vector: Column) -> Column:
    """floor(256 * x) of every component as double; null for a vector that is null, empty or not finite throughout."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("double"))
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(~bad & (F.size(vector) > 0), x)


class BallTree:
    """Nodes as arrays: centre, radius, children (or the rows of a leaf)."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF):
        self.rows, self.centre, self.radius, self.kids, self.leaf = rows, [], [], [], []
        self.root = self._build(np.arange(len(rows)), leaf)

    def _build(self, at: np.ndarray, leaf: int) -> int:
        x = self.rows[at]
        centre = x.mean(axis=0)
        far = np.sqrt(((x - centre) ** 2).sum(axis=1))
        me = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(far.max()))
        self.kids.append(None)
        self.leaf.append(at)
        if len(at) > leaf and far.max() > 0:
            # Split at the median along the line through two far points; equal vectors are never split for nothing.
            a = x[far.argmax()]
            b = x[((x - a) ** 2).sum(axis=1).argmax()]
            side = np.argsort(x @ (b - a), kind="stable")
            half = len(at) // 2
            self.kids[me] = (self._build(at[side[:half]], leaf), self._build(at[side[half:]], leaf))
            self.leaf[me] = None
        return me

    def search(self, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int):
        """Best k (score, id) of each query among the rows, not its own id, with scores of `floor` at least.

        A node is visited by the queries whose bound, q . centre + |q| * radius, reaches their kth score so far; of two
        children, the one of greater bounds goes first. Ties go to the smaller id, so an equal bound is visited too.
        """
        n = len(queries)
        score = np.full((n, k), -np.inf)
        best = np.full((n, k), np.iinfo(np.int64).max)
        kth = floor.astype(float).copy()
        length = np.sqrt((queries**2).sum(axis=1))

        def bound(node: int, at: np.ndarray) -> np.ndarray:
            b = queries[at] @ self.centre[node] + length[at] * self.radius[node]
            return b + 1e-9 * np.abs(b) + 1e-6

        stack = [(self.root, np.arange(n))]
        while stack:
            node, at = stack.pop()
            at = at[bound(node, at) >= kth[at]]
            if not len(at):
                continue
            if self.kids[node] is not None:
                left, right = self.kids[node]
                if bound(left, at).sum() > bound(right, at).sum():
                    left, right = right, left
                stack += [(left, at), (right, at)]
                continue
            rows = self.leaf[node]
            s = np.concatenate([score[at], queries[at] @ self.rows[rows].T], axis=1)
            i = np.concatenate([best[at], np.broadcast_to(ids[rows], (len(at), len(rows)))], axis=1)
            s[:, k:][i[:, k:] == query_ids[at][:, None]] = -np.inf
            order = np.lexsort((i, -s), axis=1)[:, :k]
            score[at], best[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            kth[at] = np.maximum(kth[at], score[at][:, -1])
        return score, best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _searcher(k: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            ids, qids = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            floor = queries["floor"].to_numpy()
            score, best = BallTree(_matrix(vectors["x"])).search(ids, _matrix(queries["x"]), qids, floor, k)
            q, _ = np.nonzero(np.isfinite(score))
            out = {"query_id": qids[q], "vec_id": best[np.isfinite(score)], "score": score[np.isfinite(score)].astype(np.int64)}
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return search


def _best(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query. Both tables: vec_id, x (array of whole doubles).

    Vectors are compared if they have as many components. Null vectors and ids must be filtered before; rows that repeat
    an id with other vectors are candidates of their own, never of their own id. Fewer than k candidates give all; an
    empty table gives no rows. Scores are exact below 2^53.

    Every block of queries meets every shard of vectors, as an exact search must; shards and blocks have bounded sizes,
    so the work grows in tasks, never in a task. A first shard of each length is searched alone; its kth scores then go
    with the queries to all other shards, which skip every node that cannot reach them.
    """
    v = materialize(vectors.select("vec_id", "x", F.size("x").alias("dim")), "vectors")
    q = materialize(queries.select("vec_id", "x", F.size("x").alias("dim")), "queries")
    shards, blocks = v.count() // SHARD + 1, q.count() // BLOCK + 1
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    v, q = v.withColumn("shard", shard), q.withColumn("block", block)

    def run(rows: DataFrame, asked: DataFrame, of_shards) -> DataFrame:
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = asked.withColumn("shard", F.explode(of_shards))
        keys = ("dim", "shard", "block")
        return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_searcher(k), _OUT)

    low = F.lit(float("-inf"))
    pilot = run(v.where("shard = 0"), q.withColumn("floor", low), F.array(F.lit(0)))
    if shards == 1:
        return _best(pilot, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    pilot = materialize(_best(pilot, k), "pilot")
    floors = pilot.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    asked = q.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", low))
    rest = run(v.where("shard > 0"), asked, F.sequence(F.lit(1), F.lit(shards - 1)))
    return _best(rest.unionByName(pilot.drop("rank")), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", scaled(F.col("embedding")).alias("x"))
    e = e.where(F.col("x").isNotNull() & F.col("vec_id").isNotNull())
    return top_k(e, e.where(F.col("vec_id") % QUERY_EVERY == 0))


SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(v.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.x) = len(v.x)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
