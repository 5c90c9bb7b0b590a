"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups.

DataFrame functions only. Two texts are equal when identical after lower-casing
A-Z. The group key is the first 128 bits of the SHA-256 of the normalised text;
every member of a group is then compared, byte for byte, with the group's
largest-id row, and members that differ (a hash collision) are regrouped by
their whole text, so a collision can never merge two texts.

What moves: hashes and ids for the counts (partial aggregation first, so a
group of a third of all rows is one row per task), then the texts of repeated
hashes only (a bounded sieve keeps the others out of the shuffle). The byte
comparison is an equi-join on the hash whose hot side adaptive execution
splits.

Defined cases: a null text counts as empty (and equals other empty texts);
very long texts are hashed and compared whole; an empty table gives no rows;
every input row gives one output row; rows that repeat the largest doc_id of a
group with an equal text are the same document and all are kept; null doc_ids
rank lowest; columns of the input other than id and text are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.llm.components import sieve
from parallax.session import scratch_path


def lower_ascii(text: Column) -> Column:
    """Null as empty, A-Z lower-cased, every other character as it is."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) == F.octet_length(t), F.lower(t)).otherwise(
        F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def content_hash(sha: Column) -> Column:
    """128 bits of the SHA-256, as 32 hex digits."""
    return F.substring(sha, 1, 32)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``hash_fn`` maps the SHA-256 column to the group key (tests pass a weak one
    to force collisions)."""
    spark: SparkSession = docs.sparkSession

    def settle(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"exact-dedup-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    light = settle(raw.select("doc_id", F.sha2(lower_ascii(F.col("text")), 256).alias("sha")), "hash").withColumn("h", hash_fn(F.col("sha")))
    groups = settle(light.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).filter(F.col("n") > 1), "group")
    # The texts of repeated hashes, to be compared. Here and below, what a join needs is written first, so that no
    # aggregate stands on the joins and a hot hash's side can be split.
    members = light.join(groups, "h", "left_semi")
    multi = settle(sieve(raw, "doc_id", members, "doc_id").select("doc_id", lower_ascii(F.col("text")).alias("norm"))
                   .withColumn("sha", F.sha2("norm", 256)).withColumn("h", hash_fn(F.col("sha"))).join(groups, "h"), "text")
    # the group's largest-id text; ids may repeat, so one row per hash is taken
    rep = settle(multi.filter(F.col("doc_id").eqNullSafe(F.col("top"))).select("h", F.col("norm").alias("rep")).dropDuplicates(["h"]), "rep")
    # A collision leaves rows unlike the representative; then n and top of that hash are of
    # several texts, so all its rows are regrouped by their whole text.
    bad = settle(multi.select("h", "norm").join(rep, "h").filter(F.col("norm") != F.col("rep")).select("h"), "mixed")
    clean = light.join(bad, "h", "left_anti").join(groups, "h", "left").select(
        "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"), "sha")
    mixed = multi.join(bad, "h", "left_semi").select("doc_id", "sha", "norm")
    exact = mixed.groupBy("norm").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    collided = mixed.join(exact, "norm").select("doc_id", "keep_id", "group_size", "sha")
    out = clean.unionByName(collided)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, all columns kept: the largest id of each group of equal texts.

    Rows that repeat that id with an equal text are one document and stay together."""
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(
        F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(lower_ascii(docs[text_col]), 256)
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("_id")) & (sha == F.col("_sha")), "left_semi")


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
