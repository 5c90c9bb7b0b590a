"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.fixtures import read_table
from parallax.llm import (chat, embedding_dedup, exact_dedup, html_extract, lexical_search, line_dedup, merkle, ngram_join, packing, quality,
                          secret_scan, spiece, toxicity)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, by a grammar learned from the labels outside the held-out fold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in sequences of 2048."""
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, tokenizer_file("word_bpe_49k.json")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays for its text."""
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links of cosine 0.98 or more within its label, and its class."""
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of every participant."""
    return chat.rotate(read_table(spark, sf_dir, "conversations")).withColumn("mask", chat.mask_text(F.col("mask")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids, and whether they decode to the text."""
    out = spiece.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class and number of links: five words, Jaccard 0.8."""
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, by rules learned from the labels outside the held-out fold."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return quality.score_quality(docs, quality.train_quality(docs, labels))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines of recurring templates and repeated passages."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_recurring_lines(docs, long_lines=True).withColumnsRenamed({"_n_lines": "n_lines", "_n_dropped": "n_dropped"})


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and places."""
    return secret_scan.secret_digests(secret_scan.find_secrets(read_table(spark, sf_dir, "documents")))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and check against the root, where half of the ids lose their texts' line ends."""
    text = F.col("text")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    manifest = merkle.build_manifest(read_table(spark, sf_dir, "documents"), F.when(tampered, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text))
    return merkle.verify(merkle.prove(spark, manifest)).select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's twenty best documents."""
    return lexical_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_html_extract": op2_html_extract,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_chat": op6_chat,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_ngram_join": op8_ngram_join,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_secret_scan": op11_secret_scan,
    "op12_merkle": op12_merkle,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op6_chat": chat.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_secret_scan": secret_scan.ORACLE,
    "op12_merkle": merkle.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
