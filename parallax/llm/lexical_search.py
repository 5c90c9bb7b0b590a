"""Ranked lexical search: one automaton of the items' terms reads every document, with no index of documents.

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are
lower-cased. An item's terms (repeats counted) score a document by

    sum of w * ((1000000000 * tf) div (1000 * tf + 12 * m)),
    w = floor(1000 * ln((2 N + 2) / (2 df + 1))),  m = 75 + ((25 * n * N) div L)

with N documents that have a term, L terms in all, n of the document, df documents
that hold the term and tf its occurrences in the document.

* Items are dealt to blocks by a hash, about ``BLOCK_PAIRS`` (item, term) pairs each
  and whole items always, so what is broadcast for a block does not grow with the items
  or the documents (an item of more distinct terms than that has a block's size of its own).
* A block's automaton holds `` term `` with a space on either side. A text's bytes,
  everything outside terms turned to spaces, run through it in slices cut between
  terms; each output is a term's number. Texts join in a slice, so numpy counts the
  outputs by (document, term).
* First pass: df of the block's terms, N and L; a partition sends one number for each
  term it has met. Second pass: the outputs map to the items that have the term, and a
  partition keeps each item's best documents. The best of partitions meet in two
  rounds, so no task ranks what all partitions send for an item.

Defined cases: a null text has no terms, like an empty one; an item without terms, or
whose terms no document has, gives no rows; rows that repeat an item id are one item with
all their terms; rows that repeat a document id are documents of their own; equal scores
rank by ascending id, null ids first; an empty table on either side gives no rows; very
long texts are read whole, slice by slice; further columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.llm.exact_dedup import lower_ascii
from parallax.session import scratch_path

# The term expression, the number of documents an item lists, and the score's numbers.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
SCALE, TF_PART, LENGTH_PART, LEAST_LENGTH, LENGTH_SHARE, WEIGHT_SCALE = 1_000_000_000, 1000, 12, 75, 25, 1000

BLOCK_PAIRS = 500_000       # (item, term) pairs in a block of items
SLICE_BYTES = 1 << 20       # text that one run of the automaton reads
SCORE_CELLS = 2_000_000     # documents x items scored at once
FIRST_ROUND = 256           # groups of partitions in the first round of ranking

_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def automaton_key(term: str) -> str:
    """A term as the automaton holds it: a character per UTF-8 byte, a space on either side."""
    return f" {term.encode().decode('latin-1')} "


def build_automaton(terms: list[str]):
    """The automaton of different terms; its outputs are their places in the list."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        automaton.add_word(automaton_key(t), k)
    if terms:
        automaton.make_automaton()
    return automaton


def _slices(texts: list[bytes], size: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Folded texts, each between spaces, in runs of about ``size`` bytes; longer ones are cut at spaces."""
    docs, parts, held = [], [], 0
    for k, text in enumerate(texts):
        folded, at = text.translate(_FOLD), 0
        while at < len(folded):
            to = len(folded)
            if to - at > size:
                to = folded.rfind(b" ", at, at + size)
                if to <= at:  # no space, or only the first: one term is longer than a slice
                    to = folded.find(b" ", at + 1)
                    to = len(folded) if to < 0 else to
            docs.append(k)
            parts.append(b" " + folded[at:to] + b" ")
            held += to - at + 2
            at = to
            if held >= size:
                yield docs, parts
                docs, parts, held = [], [], 0
    if parts:
        yield docs, parts


def term_counts(texts: list[bytes], automaton, n_terms: int, size: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, tf) of the automaton's terms, sorted by document and term, and all terms in each document."""
    total = np.zeros(len(texts), np.int64)
    keys, tfs = [], []
    for docs, parts in _slices(texts, size):
        run = b"".join(parts)
        ends, owner = np.cumsum([len(p) for p in parts]), np.array(docs)
        letters = np.frombuffer(run, np.uint8) != 32
        starts = np.flatnonzero(letters[1:] & ~letters[:-1]) + 1
        np.add.at(total, owner[np.searchsorted(ends, starts, side="right")], 1)
        if n_terms:
            hits = np.fromiter(chain.from_iterable(automaton.iter(run.decode("latin-1"))), np.int64).reshape(-1, 2)
            k, c = np.unique(owner[np.searchsorted(ends, hits[:, 0], side="right")] * n_terms + hits[:, 1], return_counts=True)
            keys.append(k)
            tfs.append(c)
    if not keys:
        none = np.zeros(0, np.int64)
        return none, none, none, total
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.zeros(len(key), np.int64)
    np.add.at(tf, back, np.concatenate(tfs))
    return key // n_terms, key % n_terms, tf, total


def _texts(column) -> list[bytes]:
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x.as_py() or b"" for x in column.cast(kind)]


def _corpus_batches(batches: Iterator, block, n_terms: int) -> Iterator:
    """For ``mapInArrow``: (term, documents that hold it) of a partition, -1 for N and -2 for L."""
    import pyarrow as pa

    df, n_docs, length = np.zeros(n_terms, np.int64), 0, 0
    for batch in batches:
        _, term, _, total = term_counts(_texts(batch.column(0)), block.value[0], n_terms)
        df += np.bincount(term, minlength=n_terms)
        n_docs += int((total > 0).sum())
        length += int(total.sum())
    met = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *met.tolist()], pa.int64()), pa.array([n_docs, length, *df[met].tolist()], pa.int64())],
                                     names=["term", "n"])


def weight(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def score_documents(doc: np.ndarray, term: np.ndarray, tf: np.ndarray, total: np.ndarray, weights: np.ndarray, of_term: tuple,
                    n_items: int, n_docs: int, length: int) -> np.ndarray:
    """Scores, documents x items. ``of_term``: for each term, where its items start, the items, and the term's repeats in them."""
    first, items, repeats = of_term
    m = LEAST_LENGTH + (LENGTH_SHARE * total * n_docs) // max(length, 1)
    part = weights[term] * ((SCALE * tf) // (TF_PART * tf + LENGTH_PART * m[doc]))
    degree = first[term + 1] - first[term]
    # every (document, term) once for each of the term's items
    flat = np.repeat(first[term] - np.concatenate([[0], np.cumsum(degree)[:-1]]), degree) + np.arange(degree.sum()) if len(term) else term
    out = np.zeros(len(total) * n_items, np.int64)
    np.add.at(out, np.repeat(doc * n_items, degree) + items[flat], np.repeat(part, degree) * repeats[flat])
    return out.reshape(len(total), n_items)


def _best(item: np.ndarray, score: np.ndarray, named: np.ndarray, doc_id: np.ndarray, top: int) -> np.ndarray:
    """The rows of each item's ``top`` best: by score, then null ids, then ascending id."""
    order = np.lexsort((doc_id, named, -score, item))
    start = np.flatnonzero(np.concatenate([[True], item[order][1:] != item[order][:-1]])) if len(order) else order
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < top]


def _score_batches(batches: Iterator, block, scale, n_terms: int, n_items: int, top: int) -> Iterator:
    """For ``mapInArrow``: a partition's best documents of each item, (item, doc_id, score)."""
    import pyarrow as pa

    automaton, of_term = block.value
    weights, n_docs, length = scale.value
    held = [np.zeros(0, np.int64) for _ in range(4)]  # item, score, whether the id is not null, id
    floor = np.ones(n_items, np.int64)  # what a score must reach to be among an item's best
    step = max(top, SCORE_CELLS // max(n_items, 1))
    for batch in batches:
        ids = batch.column(0)
        named = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
        doc_ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = _texts(batch.column(1))
        for at in range(0, len(texts), step):
            s = score_documents(*term_counts(texts[at:at + step], automaton, n_terms), weights, of_term, n_items, n_docs, length)
            least = floor if len(s) <= top else np.maximum(floor, np.partition(s, len(s) - top, axis=0)[len(s) - top])
            d, i = np.nonzero(s >= least)
            new = [i, s[d, i], named[at + d], doc_ids[at + d]]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            keep = _best(*held, top)
            held = [x[keep] for x in held]
            full = np.flatnonzero(np.bincount(held[0], minlength=n_items) == top)
            lowest = np.full(n_items, np.iinfo(np.int64).max)
            np.minimum.at(lowest, held[0], held[1])
            floor[full] = lowest[full]
    item, score, named, doc_id = held
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, pa.int64(), mask=named == 0), pa.array(score, pa.int64())],
                                     names=["item", "doc_id", "score"])


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term, repeats) of every item."""
    return (items.select(F.col(item_col).alias("item_id"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(TERM), F.lit(0))).alias("term"))
            .groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("repeats")))


def rank_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", top: int = TOP, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` best documents with a score above 0."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = scratch_path(spark, "search-terms")
    item_terms(items, item_col, item_text_col).write.parquet(path)
    pairs = spark.read.parquet(path)
    blocks = max(1, -(-pairs.count() // block_pairs))
    item_type = items.schema[item_col].dataType
    out = spark.createDataFrame([], T.StructType([T.StructField("item_id", item_type), T.StructField("rank", T.IntegerType()),
                                                  T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())]))
    for b in range(blocks):
        mine = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # about block_pairs rows
        if mine:
            out = out.unionAll(_rank_block(texts, mine, item_type, top))
    return out


def _rank_block(texts: DataFrame, pairs: list, item_type: T.DataType, top: int) -> DataFrame:
    """``rank_documents`` of one block's (item_id, term, repeats)."""
    spark, sc = texts.sparkSession, texts.sparkSession.sparkContext
    terms = sorted({r["term"] for r in pairs})
    number = {t: k for k, t in enumerate(terms)}
    items = list(dict.fromkeys(r["item_id"] for r in pairs))
    place = {x: k for k, x in enumerate(items)}
    links = np.array(sorted((number[r["term"]], place[r["item_id"]], r["repeats"]) for r in pairs), np.int64).reshape(-1, 3)
    first = np.searchsorted(links[:, 0], np.arange(len(terms) + 1))
    block = sc.broadcast((build_automaton(terms), (first, links[:, 1], links[:, 2])))

    counts = texts.select("text").mapInArrow(partial(_corpus_batches, block=block, n_terms=len(terms)), "term long, n long")
    corpus = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row for each of the block's terms
    n_docs, length = corpus.get(-1, 0), corpus.get(-2, 0)
    weights = np.array([weight(n_docs, corpus.get(k, 0)) for k in range(len(terms))], np.int64)
    scale = sc.broadcast((weights, n_docs, length))

    best = texts.mapInArrow(partial(_score_batches, block=block, scale=scale, n_terms=len(terms), n_items=len(items), top=top),
                            "item long, doc_id long, score long").withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(FIRST_ROUND)))
    path = scratch_path(spark, "search-best")
    best.write.parquet(path)
    block.unpersist()
    scale.unpersist()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    rounds = spark.read.parquet(path).withColumn("_r", rank("item", "_group")).filter(F.col("_r") <= top)
    ranked = rounds.withColumn("rank", rank("item")).filter(F.col("rank") <= top)
    names = spark.createDataFrame(list(enumerate(items)), T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", item_type)]))
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items


_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{TERM}') AS terms
           FROM documents),
corpus AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS length FROM d WHERE len(terms) > 0),
item AS (SELECT item_id, term, count(*) AS repeats
         FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM item) GROUP BY ALL),
w AS (SELECT term, floor({WEIGHT_SCALE} * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), corpus),
score AS (
  SELECT item_id, row_no, doc_id, sum(repeats * w * (({SCALE} * tf) // ({TF_PART} * tf + {LENGTH_PART} * ({LEAST_LENGTH} + ({LENGTH_SHARE} * len(terms) * docs) // length))))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN w USING (term) JOIN d USING (row_no), corpus GROUP BY item_id, row_no, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM score WHERE score > 0)
WHERE rank <= {TOP}
"""
