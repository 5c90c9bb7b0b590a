"""Merkle dataset manifest: one tree per source, one over the sources; interior levels are kept only now and then.

A row's leaf is the SHA-256 of its fields. Within a source the leaves ascend by
document id; while several nodes remain, every ``FAN`` consecutive ones become
the hash of their hashes (the last run may be shorter, even one). What remains
is the source's subroot; the subroots, by source, likewise give the root.

* Order without one task per source: the leaves are range-partitioned by
  (source, id, leaf), written, and a leaf's place is its place in its partition
  plus the source's rows in the partitions before (a count table of one row per
  partition and source).
* Checkpoints: an aligned subtree of ``BAND`` levels has at most FAN^BAND nodes at
  its foot, which are one row of the written level; the levels between are not
  kept. The subtrees' tops are the nodes of the next written level.
* Proofs go from the top down: each subtree regenerates its interior levels
  from its written row, emits for every node at its foot the siblings on the
  way up, ahead of the proof of the subtree's own top, and keeps none of it.
  A row of one level meets the next in an equi-join on (tree, place) where each
  key has one row on either side, so no key is hot, whatever the source.

DataFrame functions only. Every written level is Parquet under the shared
folder, so a lost executor costs at most a level's work.

Defined cases: every input row is a leaf; null fields are ``-``; ids may be
null (first) or repeat (then the leaf's hash decides, and equal leaves are
interchangeable); a null source is a source of its own, first in order; an
empty table gives no rows; texts are hashed whole; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm.components import places
from parallax.session import scratch_path

FAN = 3
BAND = 4                                                    # levels between written ones: subtrees of at most 81 nodes
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]    # fixed values: a leaf's fields, in order
_HEIGHTS = [FAN ** k for k in range(39)]                    # below 2^63
_STEP = "array<struct<left:array<string>,right:array<string>>>"


@dataclass(frozen=True)
class Manifest:
    """Paths of the written levels, foot first: of the sources' trees, and of the tree over their subroots."""

    levels: list[str]  # (_tree, _block, _n, _foot array<struct<node, ...>>)
    over: list[str]


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """``-`` if null, else the value's byte count, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(row: dict[str, Column]) -> Column:
    """The leaf of a row's fields."""
    return sha(*(field(row[f]) for f in FIELDS))


def _settle(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, f"merkle-{name}")
    df.write.parquet(path)
    return path


def _height(n: Column) -> Column:
    """Levels above n nodes until one remains."""
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in _HEIGHTS]), lambda x: x < n))


def _up(level: Column) -> Column:
    """The hashes of a level's runs."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / FAN).cast("int") - 1)
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(level, r * FAN + 1, F.lit(FAN)), ""), 256))


def _interior(blocks: DataFrame) -> DataFrame:
    """The subtree's levels ``_l0`` to ``_l<BAND>`` again from its foot, and ``_up`` of them, as many as its tree still has."""
    out = blocks.withColumn("_up", F.least(F.lit(BAND), _height(F.col("_n")))).withColumn("_l0", F.col("_foot")["node"])
    for k in range(BAND):
        out = out.withColumn(f"_l{k + 1}", _up(F.col(f"_l{k}")))
    return out


def _tops(blocks: DataFrame) -> DataFrame:
    """(_tree, _at, _n, node): the subtrees' tops, the next level's nodes, and how many of them the tree has."""
    top = F.element_at(F.array(*[F.col(f"_l{k}")[0] for k in range(BAND + 1)]), F.col("_up") + 1)
    return _interior(blocks).select("_tree", F.col("_block").alias("_at"), F.ceil(F.col("_n") / FAN ** BAND).cast("long").alias("_n"), top.alias("node"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """The aligned subtrees' feet of a level's (_tree, _at, _n, node, ...)."""
    own = [c for c in nodes.columns if c not in ("_tree", "_at", "_n")]
    foot = F.sort_array(F.collect_list(F.struct("_at", *own)))
    return (nodes.withColumn("_block", F.expr(f"_at div {FAN ** BAND}")).groupBy("_tree", "_block")
            .agg(F.first("_n").alias("_n"), F.transform(foot, lambda x: F.struct(*[x[c].alias(c) for c in own])).alias("_foot")))


def _levels(spark: SparkSession, nodes: DataFrame, name: str) -> tuple[list[str], DataFrame]:
    """The written levels over ``nodes``, foot first, and the trees' roots (_tree, node)."""
    paths: list[str] = []
    roots: DataFrame | None = None
    while True:
        paths.append(_settle(_blocks(nodes), name))
        blocks = spark.read.parquet(paths[-1])
        done = _tops(blocks.filter(F.col("_n") <= FAN ** BAND)).select("_tree", "node")
        roots = done if roots is None else roots.unionAll(done)
        rest = blocks.filter(F.col("_n") > FAN ** BAND)
        if rest.isEmpty():
            return paths, roots
        nodes = _tops(rest)


def _tree_name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def build_manifest(docs: DataFrame, tampered_text: Column | None = None) -> Manifest:
    """The manifest of ``docs`` (FIELDS among its columns), written to the shared folder.

    ``tampered_text`` is what a later reader finds in place of ``text``; its leaf is kept
    beside the original where it differs, for ``verify``."""
    spark = docs.sparkSession
    row = {f: F.col(f) for f in FIELDS}
    changed = F.lit(None).cast("string") if tampered_text is None else F.when(
        ~tampered_text.eqNullSafe(row["text"]), leaf_hash(row | {"text": tampered_text}))
    leaves = docs.select(_tree_name(row["source"]).alias("_tree"), "source", "doc_id", leaf_hash(row).alias("node"), changed.alias("tampered"))
    levels, roots = _levels(spark, places(leaves, "_tree", "doc_id", "node"), "level")
    subroots = roots.withColumn("source", F.when(F.col("_tree") != "-", F.substring(F.col("_tree"), 2, 2 ** 31 - 1)))
    ordered = places(subroots.select(F.lit("all").alias("_tree"), "source", "node"), "_tree", "source")
    return Manifest(levels, _levels(spark, ordered, "over")[0])


def _proofs(spark: SparkSession, levels: list[str], above: DataFrame, carried: list[str]) -> DataFrame:
    """(_tree, _at, _foot, proof, *carried) of the foot nodes of the levels' trees; ``_foot`` is the node's own struct.

    ``above``: (_tree, proof, *carried) of the trees' roots. A proof is a list of steps, the left and right
    siblings of each level, foot first."""
    roots = above.select("_tree", F.lit(0).cast("long").alias("_block"), "proof", *carried)
    pending = roots
    for k in range(len(levels) - 1, -1, -1):
        # beside a subtree, the proof of its top: from the level above, or that of its tree's root
        known = spark.read.parquet(levels[k]).join(pending, ["_tree", "_block"])
        steps = []
        for j in range(BAND):
            place = F.floor(F.col("_i") / FAN ** j).cast("int")
            at = place % FAN
            steps.append(F.struct(F.slice(f"_l{j}", place - at + 1, at).alias("left"),
                                  F.slice(f"_l{j}", place + 2, F.lit(FAN - 1) - at).alias("right")))
        own = F.slice(F.array(*steps), F.lit(1), F.col("_up"))
        nodes = (_interior(known).select("*", F.posexplode("_foot").alias("_i", "_node"))
                 .select("_tree", (F.col("_block") * FAN ** BAND + F.col("_i")).alias("_at"), F.col("_node").alias("_foot"),
                         F.concat(own, F.col("proof")).alias("proof"), *carried))
        if not k:
            return nodes
        # trees of which the next level down is the last start there from their root's proof
        ends = spark.read.parquet(levels[k - 1]).filter(F.col("_n") <= FAN ** BAND).select("_tree")
        pending = spark.read.parquet(_settle(
            nodes.withColumnRenamed("_at", "_block").drop("_foot").unionByName(roots.join(ends, "_tree", "left_semi")), "proof"))
    raise ValueError("a manifest has at least one level")


def prove(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(source, doc_id, leaf, tampered, proof, subroot, root) of every row: its siblings level by level up to the root."""
    tops = _tops(spark.read.parquet(manifest.over[-1])).select("_tree", F.array().cast(_STEP).alias("proof"), F.col("node").alias("root"))
    above = _proofs(spark, manifest.over, tops, ["root"]).select(
        _tree_name(F.col("_foot.source")).alias("_tree"), "proof", F.col("_foot.node").alias("subroot"), "root")
    above = spark.read.parquet(_settle(above, "above"))
    return _proofs(spark, manifest.levels, above, ["subroot", "root"]).select(
        "_foot.source", "_foot.doc_id", F.col("_foot.node").alias("leaf"), "_foot.tampered", "proof", "subroot", "root")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda acc, s: F.sha2(F.concat(F.array_join(s["left"], ""), acc, F.array_join(s["right"], "")), 256))


def proof_hash(proof: Column) -> Column:
    """The SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(F.array_join(s["left"], ""), F.array_join(s["right"], ""))), ""), 256)


def verify(proofs: DataFrame) -> DataFrame:
    """``prove`` rows with folded_root (of the row as a later reader finds it) and verified (it is the root)."""
    return proofs.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof"))).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _sql_field(name: str, value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(f, text if f == "text" else f) for f in FIELDS) + ")"


ORACLE = f"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS at FROM bits WHERE k = 8),
found AS (
  SELECT *, CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                                      lambda s, b: xor(s >> 8, crc.at[(xor(s, b) & 255) + 1])), 4294967295) % 2 = 0
                 THEN replace(text, chr(10), '') ELSE text END AS found
  FROM documents, crc),
leaf AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, source, {_sql_leaf("text")} AS leaf, {_sql_leaf("found")} AS found_leaf FROM found),
row AS (SELECT *, row_number() OVER () AS row_no, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
               count(*) OVER (PARTITION BY tree) AS n FROM leaf),
node(tree, l, i, n, h) AS (
  SELECT tree, 0, i, n, leaf FROM row
  UNION ALL SELECT tree, l + 1, i // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY tree, l, i // {FAN}, n),
sub AS (SELECT tree, l, h AS subroot, row_number() OVER (ORDER BY nullif(tree, '-') NULLS FIRST) - 1 AS s, count(*) OVER () AS n FROM node WHERE n = 1),
over_node(l, i, n, h) AS (
  SELECT 0, s, n, subroot FROM sub
  UNION ALL SELECT l + 1, i // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(h, '' ORDER BY i)) FROM over_node WHERE n > 1 GROUP BY l, i // {FAN}, n),
every AS (SELECT tree, l, i, h FROM node WHERE n > 1 UNION ALL SELECT '', l, i, h FROM over_node WHERE n > 1),
step AS (
  SELECT a.tree, a.l, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS rgt
  FROM every a JOIN every b ON a.tree = b.tree AND a.l = b.l AND a.i // {FAN} = b.i // {FAN} GROUP BY a.tree, a.l, a.i),
way AS (
  SELECT row_no, step.l AS q, lft, rgt FROM row JOIN step ON row.tree = step.tree AND row.i // ({FAN} ** step.l)::BIGINT = step.i
  UNION ALL SELECT row_no, sub.l + step.l, lft, rgt FROM row JOIN sub USING (tree) JOIN step ON step.tree = '' AND sub.s // ({FAN} ** step.l)::BIGINT = step.i),
proof AS (SELECT row_no, sha256(string_agg(lft || rgt, '' ORDER BY q)) AS proof_sha256, count(*) AS steps FROM way GROUP BY row_no),
fold(row_no, q, h) AS (
  SELECT row_no, 0, found_leaf FROM row
  UNION ALL SELECT row_no, q + 1, sha256(lft || h || rgt) FROM fold JOIN way USING (row_no, q)),
root AS (SELECT h AS root FROM over_node WHERE n = 1)
SELECT row.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
FROM row JOIN sub USING (tree) LEFT JOIN proof USING (row_no) JOIN fold ON fold.row_no = row.row_no AND fold.q = coalesce(steps, 0), root
"""
