"""A Merkle manifest of a dataset: a tree of digests for each group, a tree of the groups, and the proof of every row.

The tables hold *parent preimages*: the concatenated digests of a parent's children.
A row's proof is cut out of them: its siblings are what remains of the preimage of
each ancestor without the 64 characters of the own slot, and a changed row is folded
by splicing its digest into that slot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._blocks import quoted, written
from siltstone.operators.places import placed

#: Children of a parent, and characters of a digest.
FAN_OUT, WIDTH = 8, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Manifest:
    """Written tables of a manifest.

    ``leaves`` (id, _tree, leaf, at, n_leaves and the columns asked for): rows with their
    place in the tree of their group. ``levels[k]`` (_tree, at, digest, preimage,
    n_nodes): the nodes k + 1 levels above the leaves, n_nodes being the tree's number of
    nodes there. ``ways`` (_tree, subroot, path): the root of each group with its steps
    to the root of all. ``root``: the root of all, None for an empty table.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    ways: DataFrame
    root: str | None


def field(value: Column) -> Column:
    """A value for a preimage: ``-`` for null, otherwise its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    """SHA-256 in lowercase hex of the fields of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def tree_key(group: Column) -> Column:
    """A group as a string that isn't null and goes by UTF-8 bytes, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def grown(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The levels above some nodes (_tree, at, digest, n_nodes), lowest first; ``most`` is the largest tree's number of nodes.

    A tree ends at the level where it has one node. Each level is written, an eighth of
    the one below.
    """
    levels = []
    while most > 1:
        parents = nodes.filter(F.col("n_nodes") > 1).groupBy("_tree", F.shiftrightunsigned("at", 3).alias("at"))
        below = F.sort_array(F.collect_list(F.struct("at", "digest")))
        parents = parents.agg(F.array_join(F.transform(below, lambda x: x["digest"]), "").alias("preimage"), F.max("n_nodes").alias("n"))
        nodes = written(parents.select("_tree", "at", F.sha2("preimage", 256).alias("digest"), "preimage", F.ceil(F.col("n") / FAN_OUT).alias("n_nodes")))
        levels.append(nodes)
        most = -(-most // FAN_OUT)
    return levels


def step(preimage: Column, at: Column) -> Column:
    """A step of a path: the preimage of a parent and the slot of the child at a place."""
    return F.array(F.struct(preimage.alias("preimage"), F.pmod(at, F.lit(FAN_OUT)).cast("int").alias("slot")))


PATH = "array<struct<preimage:string,slot:int>>"


def descended(levels: list[DataFrame], roots: DataFrame) -> DataFrame | None:
    """(_tree, at, preimage, subroot, path) of the lowest parents, path being the steps from there to the root of all.

    ``roots`` (_tree, subroot, path) holds how each tree's root goes on. Paths travel
    down, each node takes its parent's, so the rows joined are an eighth of the leaves.
    """
    above = None
    for nodes in reversed(levels):
        own = nodes.filter(F.col("n_nodes") == 1).join(roots, "_tree").select("_tree", "at", "preimage", "subroot", "path")
        if above is not None:
            lower = below(nodes.filter(F.col("n_nodes") > 1), above)
            own = own.unionByName(lower.select("_tree", "at", "preimage", "subroot", "path"))
        above = own
    return above


def below(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Nodes (_tree, at, ...) with their parents' subroot and the path that their parents are a step of."""
    up = parents.select("_tree", F.col("at").alias("_up"), F.col("preimage").alias("_pre"), "subroot", "path")
    joined = nodes.withColumn("_up", F.shiftrightunsigned("at", 3)).join(up, ["_tree", "_up"])
    return joined.withColumn("path", F.concat(step(F.col("_pre"), F.col("at")), "path")).drop("_up", "_pre")


def build(df: DataFrame, id_col: str, group_col: str, leaf_cols: Sequence[str], *keep: Column) -> Manifest:
    """The manifest of some rows: a tree for each group, its leaves in order of the id, and a tree of the groups in order.

    A leaf is the row_digest of ``leaf_cols``; columns ``keep`` are carried along. Every
    FAN_OUT consecutive nodes, the last ones of a level perhaps fewer, have a parent,
    until a tree has one node; a group of one row is its leaf. Groups go by UTF-8
    bytes, null first; so do ids, nulls first, and rows of one id by their leaves.
    Repeated rows are leaves of their own. Nulls in a leaf's columns have a mark that no
    value has. Other columns are ignored, whatever their names. An empty table has no
    leaves and no root.
    """
    spark = df.sparkSession
    leaf = row_digest(*(F.col(quoted(c)) for c in leaf_cols))
    rows = df.select(F.col(quoted(id_col)).alias("id"), tree_key(F.col(quoted(group_col))).alias("_tree"), leaf.alias("leaf"), *keep)
    rows = written(rows)  # digests alone from here on: texts are read once
    leaves = written(placed(rows, "_tree", ("id", "leaf"), "n_leaves"))
    nodes = leaves.select("_tree", "at", F.col("leaf").alias("digest"), F.col("n_leaves").alias("n_nodes"))
    levels = grown(nodes, leaves.agg(F.max("n_leaves")).first()[0] or 0)
    subroots = reduce(DataFrame.unionByName, (x.filter(F.col("n_nodes") == 1).select("_tree", "digest") for x in (nodes, *levels)))
    groups = written(placed(subroots.withColumn("_all", F.lit("")), "_all", ("_tree",), "n_nodes"))
    tops = groups.select(F.col("_all").alias("_tree"), "at", "digest", "n_nodes", F.col("_tree").alias("_of"))
    upper = grown(tops, groups.agg(F.max("n_nodes")).first()[0] or 0)
    root = (upper[-1] if upper else tops).first()
    end = spark.range(1).select(F.lit("").alias("_tree"), F.lit("").alias("subroot"), F.array().cast(PATH).alias("path"))
    ways = below(tops, descended(upper, end)) if upper else tops.join(end, "_tree")
    ways = ways.select(F.col("_of").alias("_tree"), F.col("digest").alias("subroot"), "path")
    return Manifest(leaves, levels, written(ways), root["digest"] if root else None)


def paths(manifest: Manifest) -> DataFrame:
    """The leaves with their subroot and their path: the steps from the leaf to the root of all.

    Leaves meet their lowest parent, which has the way up with it; a leaf that is the
    whole of its tree meets the way of its group.
    """
    lone = manifest.leaves.filter(F.col("n_leaves") == 1).join(manifest.ways, "_tree")
    parents = descended(manifest.levels, manifest.ways)
    return lone if parents is None else lone.unionByName(below(manifest.leaves.filter(F.col("n_leaves") > 1), parents))


def siblings(path: Column) -> Column:
    """The digests that prove a row, in one string: each preimage of the path without the own slot."""
    cut = lambda s: F.overlay(s["preimage"], F.lit(""), s["slot"] * WIDTH + 1, F.lit(WIDTH))
    return F.array_join(F.transform(path, cut), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of a path."""
    splice = lambda digest, s: F.sha2(F.overlay(s["preimage"], digest, s["slot"] * WIDTH + 1, F.lit(WIDTH)), 256)
    return F.aggregate(path, leaf, splice)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by language, with the proof of each row and what a row with tampered text folds to."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)
    changed = row_digest(*(F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in columns))
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    manifest = build(docs, "doc_id", "lang", columns, F.when(hit, changed).alias("tampered"))
    root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = paths(manifest).select(F.col("id").alias("doc_id"), "leaf", "subroot", F.lit(manifest.root).alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('=' || lang, '') AS tree FROM documents
), e AS (
  SELECT doc_id, tree,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS changed,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 3 = 0 AS hit
  FROM d
), l AS (
  SELECT doc_id, tree, sha256(head || body) AS leaf, CASE WHEN hit THEN sha256(head || changed) ELSE sha256(head || body) END AS tampered FROM e
), r AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l
), t AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, n FROM r
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY tree, level, pos // 8, n
), s AS (
  SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
), u AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM s
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (n + 7) // 8 FROM u WHERE n > 1 GROUP BY level, pos // 8, n
), x AS (
  SELECT tree, level, pos // 8 AS up, string_agg(digest, '' ORDER BY pos) AS pre FROM t WHERE n > 1 GROUP BY ALL
), y AS (
  SELECT level, pos // 8 AS up, string_agg(digest, '' ORDER BY pos) AS pre FROM u WHERE n > 1 GROUP BY ALL
), p AS (
  SELECT doc_id, r.tree, leaf, 0 AS level, pos, tampered AS cur, '' AS proof FROM r
  UNION ALL
  SELECT doc_id, p.tree, leaf, p.level + 1, pos // 8, sha256(left(pre, (pos % 8 * 64)::BIGINT) || cur || substr(pre, (pos % 8 * 64 + 65)::BIGINT)), proof || left(pre, (pos % 8 * 64)::BIGINT) || substr(pre, (pos % 8 * 64 + 65)::BIGINT)
  FROM p JOIN x ON p.tree = x.tree AND p.level = x.level AND p.pos // 8 = x.up
), q AS (
  SELECT doc_id, p.tree, leaf, 0 AS level, s.pos, s.subroot, cur, proof FROM p JOIN s ON p.tree = s.tree WHERE p.level = (SELECT max(level) FROM t WHERE t.tree = p.tree)
  UNION ALL
  SELECT doc_id, q.tree, leaf, q.level + 1, pos // 8, subroot, sha256(left(pre, (pos % 8 * 64)::BIGINT) || cur || substr(pre, (pos % 8 * 64 + 65)::BIGINT)), proof || left(pre, (pos % 8 * 64)::BIGINT) || substr(pre, (pos % 8 * 64 + 65)::BIGINT)
  FROM q JOIN y ON q.level = y.level AND q.pos // 8 = y.up
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT digest FROM u WHERE n = 1) AS verified
FROM q WHERE level = (SELECT max(level) FROM u)
"""
