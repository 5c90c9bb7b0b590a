"""Labelled rows for the classifiers: folds, and a bounded sample.

Labels are learned only from documents outside the held-out fold
(crc32(doc_id as text) mod 5 = 0), from at most about ``MAX_LABELLED`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bound of the labelled rows that a classifier is fitted on. More labels are
# thinned by a hash of their id, so the choice does not depend on file order.
MAX_LABELLED = 20_000


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, label: str, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, label 0/1): non-held-out rows, one per id (1 if any row says 1), thinned to about ``bound``.

    The result is at most about ``bound`` rows of two numbers, so it may be broadcast."""
    rows = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("label").alias("label")))
    n = rows.count()
    if n > bound:
        # the labels with the smallest hashes: a share of the whole 64-bit range, so it is not 0 at any number of labels
        share = int(bound / n * (1 << 64)) - (1 << 63)
        rows = rows.filter(F.xxhash64(F.lit(7), "doc_id") < F.lit(share))
    return rows


def training_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, text, label) of the labelled training documents, one per id; the labels are broadcast (bounded).

    An id that many rows have counts once, by the text with the smallest hash; partial aggregation leaves
    a row per id and task before anything moves."""
    lab = training_labels(labels, label, bound)
    return (docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id")
            .groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))
            .select("doc_id", "m.text", "label"))
