"""Embedding near-dedup: an inverted multi-index with multi-sequence traversal.

Vectors are compared only with vectors of the same label and length, by cosine in double
precision.

1. Equal directions (equal normalised vectors) of a label form one class, so a
   vector that a third of all rows hold is compared once.
2. Two codebooks, one for each half of the vector, are trained by k-means on a
   bounded sample (``SAMPLE`` rows, those with the smallest hashes). Their product is the grid of cells; every
   vector lies in the cell of its nearest centroids. The codebooks have the most common
   length; in the index alone, other vectors are cut or filled with zeros to it, which
   brings no two further apart, so the bounds below hold for them too. A half has at least ``CENTROIDS``
   centroids, and as many as give the largest label a cell for every ``BUCKET_ROWS`` vectors, up to ``MAX_CENTROIDS``.
3. A vector within distance d of the query lies, in each half, on its own
   centroid's side of the bisector; so each half has a lower bound of the distance
   from the query to a cell, and the squares add up. The traversal walks the two
   sorted lists of bounds together, nearest cells first (a heap over the grid's
   frontier), until the next cell's bound exceeds the reach. With
   ``target_recall`` 1 the reach is the distance of the cosine threshold and no
   pair can be missed; a lower target takes the quantile of what links need,
   measured on the sample's links and on simulated ones (``fit_index``).
4. A vector is sent once to each bucket of cells that it visits any of, with the
   list of those cells, and meets their vectors there, in blocks of bounded
   size, cell by cell, by matrix products. A block sends on, for each
   vector, how many rows it links to, and a spanning forest, never its pairs. A pair that
   only one side visits (the other's bound tells) counts there for both.

Classes are the connected components of the forests.

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and vectors without a label link
with nothing and are kept; repeated rows count as links of each other; rows that repeat an id
with another vector are vectors of their own, and kept where their component is named by their id;
ties go to the smallest id; an empty table gives no rows; a null id has no links and
is kept; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallax.llm.components import connected_components, forest, sorted_groups
from parallax.session import scratch_path

THRESHOLD = 0.98
TARGET_RECALL = 0.9999
SAMPLE = 20_000          # rows that the codebooks are trained on
CENTROIDS = 16           # in each half, at least
MAX_CENTROIDS = 1024     # and at most
BUCKET_ROWS = 4096       # vectors of a bucket of cells, and of a chunk of its visitors
EPS = 1e-9


def normalised(v: np.ndarray) -> np.ndarray | None:
    """The direction, in double precision, or None if the vector has none."""
    v = np.asarray(v, np.float64)
    if not len(v) or not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt(v @ v)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 0) -> np.ndarray:
    """Lloyd's centroids of at most ``k`` clusters (fewer if there are fewer different rows)."""
    u = np.unique(x, axis=0)
    if len(u) <= k:
        return u
    rng = np.random.default_rng(seed)
    c = u[rng.choice(len(u), k, replace=False)]
    for _ in range(rounds):
        near = _squares(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return np.unique(c, axis=0)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


class MultiIndex:
    """Two codebooks and, for each half, the distances between centroids."""

    def __init__(self, first: np.ndarray, second: np.ndarray, reach: float):
        self.books = (first, second)
        self.between = tuple(np.sqrt(_squares(b, b)) for b in self.books)
        self.reach = reach

    def keys(self, units: list[bytes]) -> np.ndarray:
        """Directions of any length, cut or filled with zeros to that of the codebooks."""
        width = self.books[0].shape[1] + self.books[1].shape[1]
        return np.frombuffer(b"".join(u[:8 * width].ljust(8 * width, b"\0") for u in units), np.float64).reshape(len(units), width)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = x.shape[1] // 2
        return x[:, :h], x[:, h:]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Cell number of each vector: first * size of the second book + second."""
        a, b = (_squares(part, book).argmin(axis=1) for part, book in zip(self.halves(x), self.books, strict=True))
        return a * len(self.books[1]) + b

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each half, the square of a lower bound of each vector's distance to each centroid's region."""
        out = []
        for part, book, between in zip(self.halves(x), self.books, self.between, strict=True):
            d = _squares(part, book)
            own = d.argmin(axis=1)
            gap = d - d[np.arange(len(d)), own][:, None]
            lower = gap / (2 * np.maximum(between[own], 1e-300))
            lower[np.arange(len(d)), own] = 0
            out.append(np.maximum(lower, 0) ** 2)
        return out[0], out[1]

    def visited(self, units: list[bytes], by: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Whether the vectors at ``by`` visit the cells of those at ``of``."""
        sides = []
        for at in (by, of):
            u, back = np.unique(at, return_inverse=True)
            sides.append((self.keys([units[k] for k in u]), back))
        (one, two), cell = self.bounds(sides[0][0]), self.cells(sides[1][0])[sides[1][1]]
        width, row = len(self.books[1]), sides[0][1]
        return one[row, cell // width] + two[row, cell % width] <= self.reach ** 2 + EPS

    def visits(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The cells that each vector visits, nearest first: the multi-sequence traversal."""
        one, two = self.bounds(x)
        limit = self.reach ** 2 + EPS
        order_a, order_b = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        width = len(self.books[1])
        for k in range(len(x)):
            a, b, oa, ob = one[k], two[k], order_a[k], order_b[k]
            sa, sb = a[oa], b[ob]
            na, nb = int(np.searchsorted(sa, limit, side="right")), int(np.searchsorted(sb, limit, side="right"))
            if na == 1 and nb == 1:
                yield np.array([oa[0] * width + ob[0]])
                continue
            out, heap, seen = [], [(sa[0] + sb[0], 0, 0)], {(0, 0)}
            while heap:
                bound, i, j = heapq.heappop(heap)
                if bound > limit:
                    break
                out.append(oa[i] * width + ob[j])
                for i2, j2 in ((i + 1, j), (i, j + 1)):
                    if i2 < na and j2 < nb and (i2, j2) not in seen:
                        seen.add((i2, j2))
                        heapq.heappush(heap, (sa[i2] + sb[j2], i2, j2))
            yield np.array(out)


def fit_index(sample: np.ndarray, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, centroids: int = CENTROIDS) -> MultiIndex:
    """Codebooks from sampled directions; the reach for the target recall.

    The reach of target 1 is the threshold's distance itself, which no link exceeds. A lower target is met by
    the quantile of what links need, over the sample's own links (at most 2,000 from each 1,000 rows) and over links made by turning sampled
    directions by the threshold's angle, each in a random direction; the larger of both counts."""
    h = sample.shape[1] // 2
    index = MultiIndex(kmeans(sample[:, :h], centroids, seed=1), kmeans(sample[:, h:], centroids, seed=2), np.sqrt(max(0.0, 2 - 2 * threshold)))
    if target_recall < 1:
        width = len(index.books[1])
        rng = np.random.default_rng(5)

        def need(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Distance bounds from each x to the cell of its y."""
            out = []
            for s in range(0, len(x), 5000):
                one, two = index.bounds(x[s:s + 5000])
                cell = index.cells(y[s:s + 5000])
                k = np.arange(len(cell))
                out.append(np.sqrt(one[k, cell // width] + two[k, cell % width]))
            return np.concatenate(out) if out else np.empty(0)

        x = sample[rng.integers(0, len(sample), 40_000)]
        turn = rng.normal(size=x.shape)
        turn -= (turn * x).sum(1)[:, None] * x
        turn /= np.maximum(np.linalg.norm(turn, axis=1), 1e-300)[:, None]
        reach = float(np.quantile(need(x, threshold * x + np.sqrt(max(0.0, 1 - threshold ** 2)) * turn), target_recall))
        pairs = []
        for s in range(0, len(sample), 1000):
            i, j = np.nonzero(sample[s:s + 1000] @ sample.T >= threshold)
            off = np.flatnonzero(i + s != j)
            if len(off) > 2000:  # a bounded number of them from each block is enough for a quantile
                off = rng.choice(off, 2000, replace=False)
            pairs.append(np.stack([i[off] + s, j[off]]))
        i, j = np.concatenate(pairs, axis=1)
        if len(i):
            reach = max(reach, float(np.quantile(need(sample[i], sample[j]), target_recall)))
        index.reach = min(index.reach, reach)
    return index


def _unit_batches(batches: Iterator) -> Iterator:
    """(vec_id, label, vector) to (vec_id, label, unit): the direction's bytes, or null."""
    import pyarrow as pa

    for batch in batches:
        units = []
        for v in batch.column(2):
            x = v.as_py()
            u = None if x is None or any(y is None for y in x) else normalised(x)
            units.append(None if u is None else u.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary())], names=["vec_id", "label", "unit"])


def _place_batches(batches: Iterator, index: MultiIndex) -> Iterator:
    """(rep, label, m, unit, buckets) to a row for its own cell (``own``) and one for each bucket of cells that it
    visits, with those cells; a cell's bucket is its number modulo the label's ``buckets``."""
    import pyarrow as pa

    for batch in batches:
        for s in range(0, batch.num_rows, 1000):
            part = batch.slice(s, 1000)
            x = index.keys(part.column(3).to_pylist())
            buckets = part.column(4).to_numpy()
            row, bucket, cells, own = [], [], [], []
            for k, (mine, seen) in enumerate(zip(index.cells(x).tolist(), index.visits(x), strict=True)):
                row.append(k)
                bucket.append(mine % buckets[k])
                cells.append([mine])
                own.append(True)
                of = seen % buckets[k]
                for b in np.unique(of).tolist():
                    row.append(k)
                    bucket.append(b)
                    cells.append(seen[of == b])
                    own.append(False)
            picked = part.select(["rep", "label", "m", "unit"]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(bucket, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(own)],
                                             names=["rep", "label", "m", "unit", "bucket", "cells", "own"])


def _cell_links(batches: Iterator, threshold: float, index: MultiIndex) -> Iterator:
    """For each block: (rep, -1, linked rows) and spanning edges (rep, rep, 0)."""
    import pyarrow as pa

    def work(table, cut) -> Iterator:
        rep, m, own = table["rep"].to_numpy(), table["m"].to_numpy(), table["own"].to_numpy(zero_copy_only=False)
        units = table["unit"].to_pylist()
        lists = table["cells"].combine_chunks()
        cell, start = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        oa, ob, on = [], [], []
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            at = np.repeat(np.arange(lo, hi), np.diff(start[lo:hi + 1]))
            of = cell[start[lo]:start[hi]]
            order = np.argsort(of, kind="stable")
            at, of = at[order], of[order]
            total = np.zeros(hi - lo, np.int64)
            left, right = [], []
            x = np.frombuffer(b"".join(units[lo:hi]), np.float64).reshape(hi - lo, -1)  # a group's label fixes the length
            # cell by cell: the vectors that visit it against the vectors in it
            for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of))), strict=True):
                here = at[a:b]
                mine, asks = here[own[here]], here[~own[here]]
                if not len(mine) or not len(asks):
                    continue
                link = (x[asks - lo] @ x[mine - lo].T >= threshold) & (rep[asks][:, None] != rep[mine][None, :])
                np.add.at(total, asks - lo, link @ m[mine])
                i, j = np.nonzero(link)
                if len(i):
                    # pairs that the other side does not visit count for it here
                    back = ~index.visited(units, mine[j], asks[i])
                    np.add.at(total, mine[j[back]] - lo, m[asks[i[back]]])
                    # a spanning forest of the cell's links is enough
                    ids, k = np.unique(np.concatenate([rep[asks[i]], rep[mine[j]]]), return_inverse=True)
                    for p, q in forest(len(ids), k[:len(i)], k[len(i):]):
                        left.append(ids[p])
                        right.append(ids[q])
            some = np.flatnonzero(total > 0)
            oa.extend(rep[lo + some])
            ob.extend([-1] * len(some))
            on.extend(total[some])
            oa.extend(left)
            ob.extend(right)
            on.extend([0] * len(left))
        yield pa.RecordBatch.from_arrays([pa.array(oa, pa.int64()), pa.array(ob, pa.int64()), pa.array(on, pa.int64())], names=["a", "b", "n"])

    yield from sorted_groups(batches, ["label", "bucket", "ci", "cj"], work)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, centroids: int = CENTROIDS,
                 sample_rows: int = SAMPLE) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly), component_id (smallest id reachable), kept."""
    spark = vectors.sparkSession

    def settle(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"embedding-{name}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    # labels of any type are compared by their text; a hash of it and the length stands for the label while in numpy
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col).cast("string"), F.size(vector_col))).alias("label"),
                         F.col(vector_col).cast("array<double>").alias("v"))
    units = settle(src.mapInArrow(_unit_batches, "vec_id long, label long, unit binary"), "unit")
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("unit").isNotNull()
    usable = units.filter(fit)
    alone = lambda rows: rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    common = usable.groupBy(F.octet_length("unit").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not common:
        return alone(units)
    # classes of equal directions: keyed by the bytes themselves; the written table fixes their numbers
    classes = settle(usable.groupBy("label", "unit").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("m"))
                     .select(F.monotonically_increasing_id().alias("rep"), "vec_id", "label", "m", "unit"), "class")
    per_label = settle(classes.groupBy("label").agg(F.count(F.lit(1)).alias("rows")), "label")
    n, most = per_label.agg(F.sum("rows"), F.max("rows")).first()
    centroids = max(centroids, min(MAX_CENTROIDS, int(np.ceil(np.sqrt(most / BUCKET_ROWS)))))
    # the smallest hashes, from about twice as many as are wanted, so that no task sees more
    order = F.xxhash64(F.lit(3), "unit")
    share = min(1.0, 2 * sample_rows / n)
    near = classes if share == 1.0 else classes.filter(order < F.lit(int(share * (1 << 64)) - (1 << 63)))
    picked = near.orderBy(order, "unit").select("unit").limit(sample_rows).collect()
    width = common[0]["n"]
    sample = np.array(sorted(bytes(r["unit"])[:width].ljust(width, b"\0") for r in picked), dtype=object)
    index = fit_index(np.frombuffer(b"".join(sample), np.float64).reshape(len(sample), -1), threshold, target_recall, centroids)
    buckets = per_label.select("label", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int").alias("buckets"))
    placed = settle(classes.join(buckets, "label").select("rep", "label", "m", "unit", "buckets").mapInArrow(
        partial(_place_batches, index=index),
        "rep long, label long, m long, unit binary, bucket int, cells array<int>, own boolean"), "cell")
    # a bucket's own vectors are cut into chunks, its visitors too, and a block is a chunk of each
    count = lambda c: F.greatest(F.ceil(F.sum(c.cast("long")) / BUCKET_ROWS), F.lit(1)).cast("int")
    sizes = settle(placed.groupBy("label", "bucket").agg(count(F.col("own")).alias("ni"), count(~F.col("own")).alias("nj")), "size")
    met = placed.join(sizes, ["label", "bucket"])
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("nj")).otherwise(F.col("ni")) - 1))
    met = met.withColumn("_o", other)
    met = met.withColumn("ci", F.when(F.col("own"), part("ni")).otherwise(F.col("_o"))).withColumn(
        "cj", F.when(F.col("own"), F.col("_o")).otherwise(part("nj"))).drop("_o", "ni", "nj")
    met = met.repartition("label", "bucket", "ci", "cj").sortWithinPartitions("label", "bucket", "ci", "cj")
    links = settle(met.mapInArrow(partial(_cell_links, threshold=threshold, index=index), "a long, b long, n long"), "link")
    counts = links.filter("b < 0 and n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    joined = settle(connected_components(links.filter("n = 0").select("a", "b").distinct()).withColumnsRenamed({"id": "rep"})
                    .join(classes.select("rep", "vec_id"), "rep"), "joined")
    name = settle(joined.groupBy("component").agg(F.min("vec_id").alias("component_id")), "name")
    named = joined.select("rep", "component").join(name, "component").select("rep", "component_id")
    found = settle(classes.join(named, "rep", "left").join(counts, "rep", "left")
                   .select("label", "unit", F.coalesce("component_id", "vec_id").alias("component_id"),
                           (F.col("m") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links")), "found")
    linked = usable.join(found, ["label", "unit"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionAll(alone(units.filter(~fit)))
