"""Best-fit packing: large pieces matched in pairs, small ones best-fit into the gaps.

A document's tokens (and one end token, id 0) are one piece, or several where
they exceed a sequence's capacity: whole pieces of the capacity, then the rest.

How a packing of any number of pieces is planned without gathering them: only
the number of pieces of each length matters, at most ``capacity`` numbers. Spark
counts them; the driver turns the counts into runs, each "the next m pieces of
length l go to bins b, b+1, ..., at offset o". Each piece then finds its bin from
its rank among the pieces of its length, which Spark computes by salted windows.

The plan:

1. pieces above a third of the capacity are large, and a bin takes at most two:
   from the longest down, each is matched with the longest unmatched piece that
   fits beside it;
2. smaller pieces, from the longest down, go to the fullest bin where they fit
   (best fit); a new bin opens only where none fits.

Defined cases: a null or empty text is the end token alone; repeated rows are
packed as often as they occur; ties (equal lengths) are ranked by document id,
piece and checksum; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallax.llm.wordbpe import worker_encoder
from parallax.session import free_arrow, scratch_path

CAPACITY = 2048
END_ID = 0
SLICE_CHARS = 400_000  # characters that one call of the tokenizer sees: it and the split words take some 50 bytes for each


def piece_batches(tokenizer_file: str, capacity: int, end_id: int):
    """For ``mapInPandas``: (doc_id, text) to (doc_id, piece, start, length, ids_crc32)."""

    def run(batches: Iterator) -> Iterator:
        encoder = worker_encoder(tokenizer_file)
        for pdf in batches:
            n, out = len(pdf), []
            ids, texts = pdf["doc_id"].to_numpy(), pdf["text"].tolist()
            at = 0
            while at < n:
                size, to = 0, at
                while to < n and (to == at or size + len(texts[to] or "") <= SLICE_CHARS):
                    size += len(texts[to] or "")
                    to += 1
                for k, row in zip(range(at, to), encoder.encode([t or "" for t in texts[at:to]]), strict=True):
                    row = np.append(row, end_id).astype("<u4")
                    for p, start in enumerate(range(0, len(row), capacity)):
                        part = row[start:start + capacity]
                        out.append((ids[k], p, start, len(part), zlib.crc32(part.tobytes())))
                at = to
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype(
                {"piece": "int32", "start": "int64", "length": "int64", "ids_crc32": "int64"})
            free_arrow()

    return run


def token_pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    # sent as text, so that a null id among them does not turn a batch's ids to floats
    out = src.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(
        piece_batches(tokenizer_file, capacity, end_id),
        "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, number, first bin, offset) for ``counts`` pieces of each length, and the number of bins.

    Works on counts alone: its time depends on the number of lengths, not of pieces."""
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> groups of bins (first bin, number), all with that gap
    bins = 0

    def place(n: int, m: int, first: int, offset: int) -> None:
        runs.append((n, rank[n], m, first, offset))
        rank[n] += m
        left[n] -= m

    def leave(gap: int, first: int, m: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append((first, m))

    large = sorted(n for n in left if 3 * n > capacity)  # lengths of large pieces not yet placed, ascending
    while large:
        n = large[-1]
        k = bisect_left(large, capacity - n + 1) - 1  # the longest that fits beside it
        mate = large[k] if k >= 0 else None
        if mate == n and left[n] < 2:
            mate = large[k - 1] if k >= 1 else None
        if mate is None:
            m = left[n]
            place(n, m, bins, 0)
            leave(capacity - n, bins, m)
        elif mate == n:
            m = left[n] // 2
            place(n, m, bins, 0)
            place(n, m, bins, n)
            leave(capacity - 2 * n, bins, m)
        else:
            m = min(left[n], left[mate])
            place(n, m, bins, 0)
            place(mate, m, bins, n)
            leave(capacity - n - mate, bins, m)
        bins += m
        large = [x for x in large if left[x]]
    open_gaps = sorted(gaps)
    for n in sorted((x for x in left if left[x]), reverse=True):
        while left[n]:
            k = bisect_left(open_gaps, n)
            if k == len(open_gaps):
                # no bin has room: open bins for all that are left, filled as far as they go
                per = capacity // n
                whole = left[n] // per
                for m, each in ((whole, per), (1, left[n] - whole * per)):
                    if m and each:
                        for i in range(each):
                            place(n, m, bins, i * n)
                        gap = capacity - each * n
                        if gap:
                            if gap not in gaps:
                                insort(open_gaps, gap)
                            leave(gap, bins, m)
                        bins += m
                break
            gap = open_gaps[k]
            first, m = gaps[gap].pop()
            take = min(m, left[n])
            if take < m:
                gaps[gap].append((first + take, m - take))
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(k)
            place(n, take, first, capacity - gap)
            if gap - n:
                if gap - n not in gaps:
                    insort(open_gaps, gap - n)
                leave(gap - n, first, take)
    return runs, bins


def rank_in_length(pieces: DataFrame, rows_per_salt: int = 200_000) -> DataFrame:
    """``_rank`` of each piece among those of its length, 0 up without gaps.

    A length that many pieces share is dealt over salts (by a hash of ``_row``, a number of each row's own, so that
    repeated rows are dealt too; about ``rows_per_salt`` rows each), ranked in each, and shifted by the counts of the salts before."""
    n = pieces.count()
    salts = max(8, min(100_000, -(-n // rows_per_salt)))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    within = salted.withColumn("_in", F.row_number().over(
        W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32", "_row")) - 1)
    return within.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_salt", "_in", "_before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``capacity``) and sequence_id, offset.

    The pieces are written once to the shared folder; the plan is made from their
    length counts, at most ``capacity`` rows, and sent to the tasks."""
    spark = pieces.sparkSession
    path = scratch_path(spark, "packing")
    names = pieces.columns
    pieces.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    pieces = spark.read.parquet(path)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    runs, _ = plan_bins(counts, capacity)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    ranked = rank_in_length(pieces)

    top = (1 << 62) // (capacity + 1)
    keys = table[:, 0] * top + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def find(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy(np.int64)
        k = np.searchsorted(keys, length.to_numpy(np.int64) * top + r, side="right") - 1
        return pd.DataFrame({"sequence_id": table[k, 3] + r - table[k, 1], "offset": table[k, 4]})

    return (ranked.withColumn("_at", find("length", "_rank"))
            .select(*names, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset")))
