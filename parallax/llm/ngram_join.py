"""N-gram Jaccard join: MinHash banding, then verification on the full n-gram sets.

Words are runs without white space, lower-cased, less everything that is no
letter, digit or underscore; runs with nothing left are no words. A document's
set holds its n-grams of ``n`` words (one n-gram of all its words if it has
fewer). Two documents link if the Jaccard similarity of their sets is at least
``threshold``.

1. Equal word sequences form a class, known by their digest; one of its rows, that of the smallest id, stands for it.
2. Each representative gets ``rows * bands`` MinHash values; ``choose_bands``
   takes the most selective banding of at most ``MAX_HASHES`` values that finds
   a pair at the threshold with ``target_recall``.
3. Representatives are shuffled on their band hashes. Within a bucket the whole
   signatures are compared, block by block in numpy, and pairs whose estimate
   is within ``MARGIN`` of the threshold join their documents into a family;
   a block sends on a spanning forest, never its pairs.
4. Families are the connected components of those edges (near copies, in the
   main). Inside a family every pair is verified on the full sets, again in
   blocks: a block sends on, for each document, how many documents it links to,
   and a spanning forest of the links.
5. The forests' components are the result's classes.

So links are counted without listing them, no bucket or family is held by one
task (a large one is cut into blocks of pairs of chunks), and no link between
different texts is lost beyond the banding's recall.

Defined cases: a null text counts as empty; texts without words form one class
(their word sequences are equal) and link to no other text; a row with a null
id has no class, no links and is kept; rows that repeat an id are documents of their
own with their own text's class, count once each in ``n_links`` of the others, and are kept
where that class is named by their id; an empty table gives no rows; very long texts
are hashed whole; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.components import connected_components, forest, free_names, mark_possible, sieve, sorted_groups
from parallax.session import free_arrow, scratch_path

N = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
MAX_HASHES = 96
MARGIN = 0.2            # a signature of 90 values misses a pair at the threshold by this much about once in a million
BUCKET_CHUNK = 512      # representatives in a chunk of a large bucket
FAMILY_CHUNK = 256      # and of a large family,
FAMILY_SHINGLES = 2_000_000  # or as many n-grams, whichever makes more chunks
MAX_CACHED_WORDS = 300_000

_NOT_WORD = re.compile(r"\W+")


def choose_bands(threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band with ``1 - (1 - t^rows)^bands >= target_recall`` within ``max_hashes`` values."""
    best = None
    for rows in range(1, max_hashes + 1):
        miss = 1 - threshold ** rows
        bands = int(np.ceil(np.log(1 - target_recall) / np.log(miss))) if miss > 0 else 1
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding of that recall within max_hashes")
    return best


class Shingler:
    """Word and n-gram hashes of texts; a worker's words are hashed once (bounded cache)."""

    def __init__(self, n: int = N):
        self.n = n
        self._cache: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        """64-bit hashes of the text's words, in order."""
        import xxhash

        runs = (text or "").lower().split()
        new = set(runs).difference(self._cache)
        if len(self._cache) + len(new) > MAX_CACHED_WORDS:
            self._cache = {}
            new = set(runs)
        for r in new:
            w = _NOT_WORD.sub("", r)
            self._cache[r] = (xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) | 1) if w else 0
        h = np.fromiter(map(self._cache.__getitem__, runs), np.uint64, len(runs))
        return h[h != 0]

    def shingles(self, words: np.ndarray) -> np.ndarray:
        """Different 64-bit n-gram hashes of the words, sorted; empty for no words."""
        if not len(words):
            return words
        k = min(self.n, len(words))
        m = len(words) - k + 1
        h = np.zeros(m, np.uint64)
        for i in range(k):
            h = (h ^ words[i:i + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return np.unique(h)


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_501)
    return (rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1)) | np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``a * x + b`` (mod 2^64) over the set, for each (a, b)."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 1024):
        v = a[:, None] * shingles[s:s + 1024]
        v += b[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


def _digest(words: np.ndarray) -> bytes:
    """A word sequence's class."""
    import xxhash

    return xxhash.xxh3_128_digest(words.tobytes())


def _sketch_batches(batches: Iterator, n: int, bands: int, rows: int) -> Iterator:
    """(..., text) to (..., cls, keys, sig)."""
    import pyarrow as pa
    import xxhash

    shingler = Shingler(n)
    a, b = _coefficients(bands * rows)
    for batch in batches:
        cls, keys, sigs = [], [], []
        for text in batch.column(batch.num_columns - 1):
            words = shingler.words(text.as_py())
            cls.append(_digest(words))
            s = shingler.shingles(words)
            if len(s):
                sig = minhash(s, a, b)
                keys.append([xxhash.xxh3_64_intdigest(sig[k * rows:(k + 1) * rows].tobytes(), seed=k) - (1 << 63) for k in range(bands)])
                sigs.append((sig >> np.uint64(48)).astype(np.uint16).tobytes())
            else:
                keys.append([])
                sigs.append(b"")
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                                         names=[*batch.schema.names[:-1], "cls", "keys", "sig"])
        free_arrow()


def _set_batches(batches: Iterator, n: int) -> Iterator:
    """(..., cls, text) to (..., set bytes) of the texts of that class."""
    import pyarrow as pa

    shingler = Shingler(n)
    for batch in batches:
        sets = []
        for cls, text in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
            words = shingler.words(text.as_py())
            sets.append(shingler.shingles(words).tobytes() if _digest(words) == cls.as_py() else None)
        own = pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-2], "set"])
        yield own.filter(own.column("set").is_valid())
        free_arrow()


def _pairs_in_block(side: np.ndarray, first: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of a block's two chunks (equal if the block is a chunk against itself)."""
    return np.flatnonzero(side == first), np.flatnonzero(side == second)


def _bucket_edges(batches: Iterator, least: int, width: int) -> Iterator:
    """Spanning edges of the pairs whose signatures agree in at least ``least`` of ``width`` values."""
    import pyarrow as pa

    def work(table, cut) -> Iterator:
        rep = table["rep"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, width)
        side, ci, cj = (table[c].to_numpy() for c in ("chunk", "ci", "cj"))
        ea, eb = [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo < 2:
                continue
            if hi - lo == 2:
                if ci[lo] == cj[lo] or side[lo] != side[lo + 1]:
                    if (sig[lo] == sig[lo + 1]).sum() >= least:
                        ea.append(rep[lo])
                        eb.append(rep[lo + 1])
                continue
            s = sig[lo:hi]
            left, right = _pairs_in_block(side[lo:hi], ci[lo], cj[lo])
            same = ci[lo] == cj[lo]
            i, j = [], []
            for k, x in enumerate(left):
                others = right[k + 1:] if same else right
                hit = others[(s[others] == s[x]).sum(axis=1) >= least]
                i.append(np.full(len(hit), x))
                j.append(hit)
            for x, y in forest(hi - lo, np.concatenate(i), np.concatenate(j)) if i else []:
                ea.append(rep[lo + x])
                eb.append(rep[lo + y])
        yield pa.RecordBatch.from_arrays([pa.array(ea, pa.int64()), pa.array(eb, pa.int64())], names=["a", "b"])

    yield from sorted_groups(batches, ["key", "ci", "cj"], work)


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right``."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    number = np.cumsum(count > 1) - 1  # shared values renumbered
    rows, col = rows[shared], number[col[shared]]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    out = np.zeros((len(left), len(right)), np.float64)
    n_col = int(col[-1]) + 1 if len(col) else 0
    width = max(256, 4_000_000 // max(1, len(sets)))
    for s in range(0, n_col, width):
        lo, hi = np.searchsorted(col, (s, s + width))
        m = np.zeros((len(sets), min(width, n_col - s)), np.float32)
        m[rows[lo:hi], col[lo:hi] - s] = 1
        out += m[left] @ m[right].T  # whole numbers below 2^24 are exact in single precision
    return out


def _family_links(batches: Iterator, threshold: float) -> Iterator:
    """For each block: (rep, -1, linked documents) and spanning edges (rep, rep, 0) of the verified links."""
    import pyarrow as pa

    def work(table, cut) -> Iterator:
        rep, weight = table["rep"].to_numpy(), table["m"].to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["set"]]
        side, ci, cj = (table[c].to_numpy() for c in ("chunk", "ci", "cj"))
        oa, ob, on = [], [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo < 2:
                continue
            left, right = _pairs_in_block(side[lo:hi], ci[lo], cj[lo])
            if not len(left) or not len(right):
                continue
            size = np.array([len(s) for s in sets[lo:hi]], np.float64)
            inter = intersections(sets[lo:hi], left, right)
            link = inter >= threshold * (size[left][:, None] + size[right][None, :] - inter) - 1e-9
            link &= inter > 0
            w = weight[lo:hi]
            if ci[lo] == cj[lo]:
                link &= left[:, None] != right[None, :]
                count = [(left, link @ w[right])]
            else:
                count = [(left, link @ w[right]), (right, link.T @ w[left])]
            for rows, c in count:
                some = c > 0
                oa.extend(rep[lo + rows[some]])
                ob.extend([-1] * int(some.sum()))
                on.extend(c[some].astype(np.int64))
            i, j = np.nonzero(link)
            for x, y in forest(hi - lo, left[i], right[j]):
                oa.append(rep[lo + x])
                ob.append(rep[lo + y])
                on.append(0)
        yield pa.RecordBatch.from_arrays([pa.array(oa, pa.int64()), pa.array(ob, pa.int64()), pa.array(on, pa.int64())],
                                         names=["a", "b", "n"])

    yield from sorted_groups(batches, ["family", "ci", "cj"], work)


def _blocks(df: DataFrame, key: str, chunks: str) -> DataFrame:
    """Each row of a group of ``chunks`` chunks, in each block of two chunks that its own is in; blocks dealt over the
    tasks, and sorted."""
    df = df.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col(chunks)).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col(chunks) - 1)))
    df = df.withColumn("ci", F.least("chunk", "_o").cast("int")).withColumn("cj", F.greatest("chunk", "_o").cast("int")).drop("_o")
    return df.repartition(key, "ci", "cj").sortWithinPartitions(key, "ci", "cj")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD,
                    target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id reachable by links), n_links (other documents linked
    directly, equal ones included), kept (doc_id = class_id)."""
    return _classed(docs, id_col, text_col, n, threshold, target_recall).select("doc_id", "class_id", "n_links", "kept")


def _classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, threshold: float = THRESHOLD,
             target_recall: float = TARGET_RECALL) -> DataFrame:
    """``near_duplicates`` with ``th``, a hash of the row's text, which tells the rows of one id apart."""
    spark = docs.sparkSession
    bands, rows = choose_bands(threshold, target_recall)
    width = bands * rows

    def settle(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"ngram-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    named = src.filter(F.col("doc_id").isNotNull())
    sketches = settle(named.mapInArrow(partial(_sketch_batches, n=n, bands=bands, rows=rows),
                                       "doc_id long, th long, cls binary, keys array<long>, sig binary"), "sketch")
    # a class's number is only a name inside; the written table fixes it
    first = F.min(F.struct("doc_id", "th")).alias("first")
    classes = settle(sketches.groupBy("cls").agg(first, F.count(F.lit(1)).alias("m")).select(
        "cls", "m", F.col("first.doc_id").alias("doc_id"), F.col("first.th").alias("th"), F.monotonically_increasing_id().alias("rep")), "class")
    # rows of a class have one sketch, so any of those that repeat its first row will do
    reps = sketches.join(classes.drop("m"), ["cls", "doc_id", "th"]).dropDuplicates(["rep"])

    # buckets that two or more representatives share
    spread = reps.select("rep", F.explode("keys").alias("key"))
    buckets = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = settle(spread.join(buckets, "key"), "bucket")
    chunked = members.withColumn("chunks", F.ceil(F.col("size") / BUCKET_CHUNK).cast("int")).join(reps.select("rep", "sig"), "rep")
    least = int(np.ceil((threshold - MARGIN) * width))
    edges = (_blocks(chunked.select("key", "chunks", "rep", "sig"), "key", "chunks")
             .mapInArrow(partial(_bucket_edges, least=least, width=width), "a long, b long").distinct())
    families = connected_components(edges).withColumnsRenamed({"id": "rep", "component": "family"})
    families = settle(families.join(classes, "rep"), "family")

    # full sets of the family members only; the sieve keeps the other texts out of the shuffle
    texts = sieve(named, "doc_id", families, "doc_id").join(families, ["doc_id", "th"]).dropDuplicates(["rep"])
    sized = settle(texts.select("family", "rep", "m", "cls", "text")
                   .mapInArrow(partial(_set_batches, n=n), "family long, rep long, m long, set binary"), "set")
    cut = settle(sized.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / FAMILY_CHUNK),
                                                        F.ceil(F.sum(F.octet_length("set") / 8) / FAMILY_SHINGLES), F.lit(1)).cast("int").alias("chunks")), "cut")
    links = settle(_blocks(sized.join(cut, "family"), "family", "chunks")
                   .mapInArrow(partial(_family_links, threshold=threshold), "a long, b long, n long"), "link")
    counts = links.filter("b < 0 and n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    joined = settle(connected_components(links.filter("n = 0").select("a", "b").distinct()).withColumnsRenamed({"id": "rep"})
                    .join(classes.select("rep", "doc_id"), "rep"), "joined")
    least_id = settle(joined.groupBy("component").agg(F.min("doc_id").alias("class_id")), "name")
    named_by = joined.select("rep", "component").join(least_id, "component").select("rep", "class_id")
    found = settle(classes.join(named_by, "rep", "left").join(counts, "rep", "left")
                   .select("cls", F.coalesce("class_id", "doc_id").alias("class_id"),
                           (F.col("m") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links")), "found")
    out = sketches.select("doc_id", "th", "cls").join(found, "cls").select(
        "doc_id", "th", "class_id", "n_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    nameless = src.filter(F.col("doc_id").isNull()).select(
        "doc_id", "th", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return out.unionAll(nameless)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One document of each class (the smallest id; rows that repeat it count as one document and stay), all columns kept."""
    spark = docs.sparkSession
    path = scratch_path(spark, "ngram-gone")
    number, text_hash, key, mark = free_names(docs, "_id", "_th", "_key", "_maybe")
    (_classed(docs, id_col, text_col, **settings).filter("not kept").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
     .withColumn("gone_key", F.xxhash64("gone_id", "gone_th")).write.parquet(path))
    gone = spark.read.parquet(path)
    # documents that are surely not gone pass without a shuffle
    named = docs.withColumn(number, F.col(id_col).cast("long")).withColumn(text_hash, F.xxhash64(F.col(text_col)))
    marked = mark_possible(named.withColumn(key, F.xxhash64(number, text_hash)), key, gone, "gone_key", mark)
    stay = marked.filter(~F.col(mark)).select(*docs.columns)
    asked, listed = marked.filter(F.col(mark)).alias("a"), gone.alias("g")
    same = (F.col(f"a.{number}") == F.col("g.gone_id")) & (F.col(f"a.{text_hash}") == F.col("g.gone_th"))
    return stay.unionAll(asked.join(listed, same, "left_anti").select(*docs.columns))
