"""Manifests of datasets: hash trees over documents, and the proofs that a document belongs to them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import words as W
from paperloom.llm.importance import CRC, CRC_TABLE
from paperloom.llm.ranges import placed
from paperloom.session import materialize

ARITY, TAMPER_EVERY = 16, 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that each reshuffle of the frontier resolves: what lies below one node of that height meets in a task.
ROUND_LEVELS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NODE = pa.schema(
    [
        ("tree", pa.string()),
        ("size", pa.int64()),
        ("level", pa.int32()),
        ("place", pa.int64()),
        ("digest", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("changed", pa.list_(pa.string())),
        ("children", pa.list_(pa.string())),
        ("top", pa.bool_()),
    ]
)
_NODES = "tree string, size long, level int, place long, digest string, doc_ids array<long>, changed array<string>, children array<string>, top boolean"
_PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def width(size: int, level: int, arity: int) -> int:
    """Nodes of a level in a tree of `size` leaves."""
    return -(-size // arity**level)


def height(size: int, arity: int) -> int:
    level = 0
    while width(size, level, arity) > 1:
        level += 1
    return level


def leaf(fields: tuple[str, ...], text: str | None = None) -> Column:
    """Digest of a row: each field's bytes counted, so that no two rows are written alike; `text` is folded to lower case."""
    value = lambda c: F.translate(c, _UPPER, _LOWER) if c == text else F.col(c).cast("string")
    parts = [F.coalesce(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


class _Parent:
    """A parent whose children arrive one by one; its tree's size says how many there are."""

    def __init__(self, node: dict, arity: int):
        self.key = node["tree"], node["place"] // arity
        self.size, self.level = node["size"], node["level"] + 1
        self.wanted = min(arity, width(self.size, node["level"], arity) - arity * self.key[1])
        self.children: dict[int, dict] = {}

    def close(self, arity: int) -> dict:
        nodes = [self.children[k] for k in sorted(self.children)]
        digests = [n["digest"] for n in nodes]
        bottom = self.level == 1
        return {
            "tree": self.key[0], "size": self.size, "level": self.level, "place": self.key[1], "digest": digest(*digests),
            "doc_ids": [n["doc_ids"][0] for n in nodes] if bottom and nodes[0]["doc_ids"] is not None else None,
            "changed": [n["changed"][0] for n in nodes] if bottom and nodes[0]["changed"] is not None else None,
            "children": digests, "top": self.level == height(self.size, arity),
        }


def _climb(batches: Iterator[pa.RecordBatch], arity: int) -> Iterator[pa.RecordBatch]:
    """Nodes in the order of their leaves in, parents that are whole out, each as soon as its last child has come.

    A whole parent is itself a child of the next level. One parent of each level is open at a time; one that the order has
    left behind goes out as its children, the frontier, with null `children`. A lone leaf goes out as a top of level 0.
    """
    open_: dict[int, _Parent] = {}
    for batch in batches:
        out: list[dict] = []
        for node in batch.to_pylist():
            if node["size"] == 1:
                out.append(node | {"children": [node["digest"]], "top": True})
                continue
            while node is not None:
                level = node["level"] + 1
                at = open_.get(level)
                if at is None or at.key != (node["tree"], node["place"] // arity):
                    out.extend(at.children.values() if at else ())
                    at = open_[level] = _Parent(node, arity)
                # What is kept of a child is not its own children: these have gone out with it.
                at.children[node["place"]] = node | {"children": None}
                node = None
                if len(at.children) == at.wanted:
                    del open_[level]
                    whole = at.close(arity)
                    out.append(whole)
                    if not whole["top"]:
                        node = whole | {"doc_ids": None, "changed": None}
        yield pa.RecordBatch.from_pylist(out, _NODE)
    yield pa.RecordBatch.from_pylist([n for p in open_.values() for n in p.children.values()], _NODE)


def climb(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """Runs of the trees over `leaves` (tree, size, place, digest; doc_ids and changed, arrays of one, or null).

    A run is a parent: tree, size, level, place, digest, its children's digests in order and whether it is the tree's
    `top`. Runs of leaves also hold their doc_ids and changed digests. Tasks first build what lies in their own ranges; the
    frontier, at most a few runs for each level and range, is then dealt by common ancestors ROUND_LEVELS up at a time.
    """
    nodes = leaves.select(
        "tree", "size", F.lit(0).alias("level"), "place", "digest", "doc_ids", "changed",
        F.lit(None).cast("array<string>").alias("children"), F.lit(False).alias("top"),
    ).sortWithinPartitions("tree", "place")
    found = materialize(nodes.mapInArrow(lambda t: _climb(t, arity), _NODES), "runs")
    runs, reach = [found.where(F.col("children").isNotNull())], ROUND_LEVELS
    frontier = found.where(F.col("children").isNull())
    while not frontier.isEmpty():
        power = lambda n: F.pow(F.lit(float(arity)), n).cast("long")
        ancestor = F.expr("place div _step")
        dealt = frontier.withColumn("_step", power(F.greatest(F.lit(0), reach - F.col("level")))).repartition("tree", ancestor).drop("_step")
        dealt = dealt.sortWithinPartitions("tree", F.col("place") * power(F.col("level")), "level")
        found = materialize(dealt.mapInArrow(lambda t: _climb(t, arity), _NODES), "runs")
        runs.append(found.where(F.col("children").isNotNull()))
        frontier = found.where(F.col("children").isNull())
        reach += ROUND_LEVELS
    return runs[0] if len(runs) == 1 else materialize(reduce(DataFrame.unionByName, runs), "runs")


def descend(runs: DataFrame, bases: DataFrame, arity: int = ARITY) -> DataFrame:
    """Runs of leaves (and lone leaves, level 0) with `ups`: the runs above, nearest first, each as its children's digests
    and the place `at` among them; and the other columns of `bases` (tree, ups above the tree's top, others).

    Reverse links are computed, not stored: a run's parent is the run of its place divided by the arity, a level up. Paths
    are joined from the top down and written level by level, so only the lowest join, which is not, is as large as the runs
    of leaves.
    """
    most = runs.agg(F.max("level")).first()[0] or 0
    extra = [c for c in bases.columns if c != "tree"]
    above, found = None, []
    for level in range(most, -1, -1):
        here = runs.where(F.col("level") == level).drop("digest")
        now = here.where("top").join(bases, "tree")
        if above is not None and level:
            up = above.select(F.col("tree").alias("_t"), F.col("place").alias("_p"), F.col("children").alias("_c"), *extra)
            mine = here.where("NOT top").join(up, (F.col("tree") == F.col("_t")) & (F.expr(f"place div {arity}") == F.col("_p")))
            step = F.struct(F.col("_c").alias("children"), (F.col("place") % arity).cast("int").alias("at"))
            now = now.unionByName(mine.withColumn("ups", F.concat(F.array(step), "ups")).drop("_t", "_p", "_c"))
        if level <= 1:
            found.append(now)
        else:
            above = materialize(now, "paths")
    # Level 0 holds lone leaves only, which are tops.
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def others(run: list[str], at: int) -> str:
        return "".join(run[:at] + run[at + 1 :])

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            run, ups = row["children"], [(u["children"], u["at"]) for u in row["ups"]]
            high, roots = "".join(others(c, at) for c, at in ups), {}
            for k, leaf_ in enumerate(run):
                node, proof = row["changed"][k] or leaf_, high
                if row["level"]:
                    node, proof = digest(*run[:k], node, *run[k + 1 :]), others(run, k) + high
                if node not in roots:
                    folded = node
                    for c, at in ups:
                        folded = digest(*c[:at], folded, *c[at + 1 :])
                    roots[node] = folded
                out.append((row["doc_ids"][k], leaf_, row["subroot"], row["root"], digest(proof), roots[node], roots[node] == row["root"]))
        names = [f.split(" ")[0] for f in _PROOFS.split(", ")]
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _top_tree(subroots: DataFrame, arity: int) -> DataFrame:
    """tree, subroot, root and `ups` above the subroot, for each tree, in the order of their names."""
    ordered = materialize(placed(subroots, ["tree"]).withColumnsRenamed({"_place": "place", "_of": "size"}), "subroots")
    no = lambda kind: F.lit(None).cast(kind)
    runs = climb(ordered.select(F.lit("").alias("tree"), "size", "place", F.col("subroot").alias("digest"), no("array<long>").alias("doc_ids"), no("array<string>").alias("changed")), arity)
    ups = F.array().cast("array<struct<children:array<string>,at:int>>")
    base = runs.where("top").select("tree", ups.alias("ups"), F.col("digest").alias("root"))
    found = descend(runs, base, arity).select("level", "place", "ups", "root", "children", F.posexplode("children").alias("at", "_d"))
    step = F.array(F.struct("children", "at"))
    found = found.select(
        (F.col("place") * arity + F.col("at")).alias("_p"), "root", F.when(F.col("level") == 0, F.col("ups")).otherwise(F.concat(step, "ups")).alias("ups")
    )
    return ordered.join(found, F.col("place") == F.col("_p")).select("tree", "subroot", "root", "ups")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "source", arity: int = ARITY, every: int = TAMPER_EVERY) -> tuple[DataFrame, DataFrame]:
    """The runs of all trees over `docs`, and a row for each tree: tree, subroot, root, ups (the runs above its subroot).

    A leaf is the digest of a row's fields, in order; leaves of one value of the `tree` column form a tree, ascending by
    doc_id, and the trees' subroots, ordered by that value, form the top tree. Tree names are '' for null, else '=' and the
    value. Nulls come first in both orders; rows of one doc_id are ordered by their digests, so equal rows are leaves each.
    Null and empty texts are fields like others; an empty table gives no runs and no trees. Columns outside of `fields`
    play no part. Runs of leaves also carry the digests of changed copies (text in lower case) of every `every`-th row by
    CRC-32 of its doc_id; a null doc_id is never changed.
    """
    W.bound_batches(docs.sparkSession)
    rows = docs.select(*fields)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, leaf(fields, "text"))
    name = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    leaves = materialize(rows.select(name.alias("tree"), "doc_id", leaf(fields).alias("digest"), changed.alias("changed")), "leaves")
    ordered = placed(leaves, ["tree", F.asc_nulls_first("doc_id"), "digest"], "tree")
    nodes = ordered.select("tree", F.col("_of").alias("size"), F.col("_place").alias("place"), "digest", F.array("doc_id").alias("doc_ids"), F.array("changed").alias("changed"))
    runs = climb(nodes, arity)
    return runs, _top_tree(runs.where("top").select("tree", F.col("digest").alias("subroot")), arity)


def proofs(runs: DataFrame, trees: DataFrame, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each leaf of a manifest.

    The proof of a leaf is the digests of its siblings, level by level up to the root, left to right; folded_root is the
    root that follows from them and the leaf of the changed copy, where there is one, else the leaf itself. The paths above
    a run of leaves are shared by all of them, and each leaf's proof is made where its run is.
    """
    return descend(runs, trees, arity).select("level", "children", "doc_ids", "changed", "ups", "subroot", "root").mapInArrow(_fold, _PROOFS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(*manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _leaf_sql(text: str = "text") -> str:
    values = [text if c == "text" else c for c in FIELDS]
    parts = [f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({v} AS VARCHAR))), ':', {v}) END" for v in values]
    return f"sha256(concat({', '.join(parts)}))"


SQL = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE}), d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_leaf_sql()} AS leaf,
         CASE WHEN {CRC.format("CAST(doc_id AS VARCHAR)")} % {TAMPER_EVERY} = 0
              THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed
  FROM documents, crc
), l AS (
  SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY source) AS n FROM d
), t AS (
  SELECT tree, 0 AS level, place, n, leaf AS digest FROM l
  UNION ALL
  SELECT tree, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM t WHERE n > 1 GROUP BY tree, level, n, place // 16
), s AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 100 AS level, place, n, subroot AS digest FROM s
  UNION ALL
  SELECT level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM u WHERE n > 1 GROUP BY level, n, place // 16
), nodes AS (
  SELECT * FROM t WHERE n > 1 UNION ALL SELECT '*', level, place, n, digest FROM u WHERE n > 1
), steps AS (
  SELECT rid, tree, level, CAST(l.place // CAST(pow(16, level) AS BIGINT) AS BIGINT) AS mine FROM l JOIN (SELECT DISTINCT tree, level FROM nodes) USING (tree)
  UNION ALL
  SELECT rid, '*', level, CAST(s.place // CAST(pow(16, level - 100) AS BIGINT) AS BIGINT) FROM l JOIN s USING (tree), (SELECT DISTINCT level FROM nodes WHERE tree = '*')
), k AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level) AS k FROM steps
), f AS (
  SELECT rid, CAST(0 AS BIGINT) AS k, coalesce(changed, leaf) AS folded FROM l
  UNION ALL
  SELECT f.rid, k.k, sha256(string_agg(CASE WHEN nodes.place = mine THEN folded ELSE digest END, '' ORDER BY nodes.place))
  FROM f JOIN k ON k.rid = f.rid AND k.k = f.k + 1 JOIN nodes ON nodes.tree = k.tree AND nodes.level = k.level AND nodes.place // 16 = mine // 16
  GROUP BY f.rid, k.k
), p AS (
  SELECT rid, string_agg(digest, '' ORDER BY k, nodes.place) AS proof
  FROM k JOIN nodes ON nodes.tree = k.tree AND nodes.level = k.level AND nodes.place // 16 = mine // 16 AND nodes.place <> mine GROUP BY rid
), r AS (
  SELECT digest AS root FROM u WHERE n = 1
), e AS (
  SELECT rid, arg_max(folded, k) AS folded_root FROM f GROUP BY rid
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN s USING (tree) JOIN e USING (rid) LEFT JOIN p USING (rid), r
"""
