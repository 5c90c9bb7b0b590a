"""The training-data pipeline: five operators of parallax.llm over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared checkpoint folder and reads it back as the
next stage's docs, so a lost executor never costs more than one stage. All
but the last return the columns of ``documents``.

1. quality classifier: documents that the rules reject go;
2. toxicity: documents that the grammar rejects go;
3. line dedup: lines of templates that recur across documents are dropped, but
   for one document's; ``n_chars`` is counted anew;
4. n-gram Jaccard join: of each group of near duplicates the smallest id stays;
   then a long line that several of the documents left have word for word stays in
   one (``n_chars`` anew), which the stage 3 templates ask for in more documents;
5. best-fit packing: what is left, as token pieces in sequences of 2048.

Defined cases: null texts count as empty, get the scores of an empty text and, where they stay, come out of stage 3 as
empty ones; texts without words are near duplicates of each other, so the smallest id stays; rows without an id
are never near duplicates and stay; rows that repeat an id and text stay together, as one document; a document
without labels is judged like any other; without any label stage 1 keeps all and stage 2 goes by its seed list; an
empty table gives no rows; further columns pass stages 1 to 4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.fixtures import read_table
from parallax.llm import line_dedup, ngram_join, packing, quality, toxicity
from parallax.llm.queries import tokenizer_file
from parallax.session import scratch_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; learned from the docs and the labels outside the held-out fold."""
    return quality.quality_filter(docs, quality.train_quality(docs, read_table(spark, sf_dir, "labels")))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar keeps."""
    return toxicity.toxicity_filter(docs, toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their recurring lines."""
    return _counted_anew(line_dedup.drop_recurring_lines(docs), docs)


def _counted_anew(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, ``n_chars`` of the text that is left."""
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, without the long lines that an earlier one of them has."""
    path = scratch_path(spark, "pipeline-no-copies")
    ngram_join.drop_near_duplicates(docs).write.parquet(path)
    kept = spark.read.parquet(path)
    return _counted_anew(line_dedup.drop_repeated_passages(kept), kept)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(packing.token_pieces(docs, tokenizer_file("word_bpe_49k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("packing", pack),
]

# Fitted models and token ids are not expressible in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
