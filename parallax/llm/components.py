"""Helpers for pair operators: connected components on Spark, and sorted groups streamed to numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallax.session import scratch_path


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """(id, component) of every id that an edge names; component is the smallest id reachable.

    Alternating large-star and small-star steps: each id links its larger
    (then its smaller) neighbours to the smallest of its neighbourhood, until
    nothing changes. A neighbourhood is only ever reduced to its minimum by a
    partial aggregation and an equi-join, never gathered. Every round is
    written to the shared checkpoint folder, so a lost executor costs at most a round."""
    spark = edges.sparkSession

    def settle(df: DataFrame) -> DataFrame:
        path = scratch_path(spark, "components")
        df.write.parquet(path)
        return spark.read.parquet(path)

    # every edge points from the larger to the smaller id
    cur = settle(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct())
    before = None
    for _ in range(max_rounds):
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        # written, so that no aggregate stands on the join and a hub's side can be split
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        large = settle(large)
        least2 = settle(large.groupBy("hi").agg(F.min("lo").alias("m")))
        joined = large.join(least2, "hi")
        # small star: hi -> m, and every other smaller neighbour -> m
        cur = settle(joined.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"),
                                   F.col("m").alias("lo")).filter("hi <> lo").distinct())
        # settled when every id has one smaller neighbour that itself has none, and nothing moves any more
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select("lo").distinct().select(F.col("lo").alias("id"), F.col("lo").alias("component"))
    return cur.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionAll(roots)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for inside use, like ``wanted``, that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def places(df: DataFrame, tree: str, *order: str) -> DataFrame:
    """``df`` and ``_at``, its rows' places 0, 1, ... within each tree by ``order``, and ``_n``, the tree's rows.

    The rows are range-partitioned by tree and order and written; a place is the place in the partition plus the tree's
    rows in the partitions before. So no task ranks a tree, however large, and
    equal rows are told apart by where they were read, so that even they spread over partitions."""
    spark = df.sparkSession

    def settle(rows: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, f"places-{name}")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(tree).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("_row")]
    first = settle(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ranged = settle(
        first.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).drop("_row"), "ranged")
    # one row for each partition and tree in it
    counts = ranged.groupBy(tree, "_part").agg(F.count(F.lit(1)).alias("_c"), F.min("_in").alias("_first"))
    of_tree = W.partitionBy(tree)
    before = of_tree.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = settle(counts.select(
        F.col(tree).alias("_t"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_c").over(of_tree).alias("_n")), "shift")
    return (ranged.join(shift, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t")))
            .withColumn("_at", F.col("_in") + F.col("_shift")).drop("_part", "_in", "_p", "_t", "_shift"))


MAX_SIEVE_WORDS = 1 << 20  # 8 MB


def mark_possible(rows: DataFrame, column: str, ids: DataFrame, id_col: str, mark: str = "_maybe") -> DataFrame:
    """``rows`` and a boolean: false where ``column`` is surely not among ``ids``, true where it may be.

    A Bloom filter in blocks of 64 bits, about four ids a block, of at most ``MAX_SIEVE_WORDS`` blocks
    whatever the number of ids, so it may be broadcast; where the ids outgrow it, more rows are marked.
    It spares the shuffle the rows that an equi-join with the ids would not match."""
    words = max(1, min(MAX_SIEVE_WORDS, ids.count() // 4))
    place = lambda c: F.pmod(F.xxhash64(F.lit(1), c), F.lit(words))
    bit = lambda c, k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(k), c), F.lit(64)).cast("int"))
    bits = lambda c: bit(c, 2).bitwiseOR(bit(c, 3))
    at, mask = free_names(rows, "_w", "_m")
    table = ids.select(place(F.col(id_col)).alias(at), bits(F.col(id_col)).alias("_b")).groupBy(at).agg(F.bit_or("_b").alias(mask))
    hit = rows.withColumn(at, place(F.col(column))).join(F.broadcast(table), at, "left")
    maybe = F.coalesce(F.col(mask).bitwiseAND(bits(F.col(column))) == bits(F.col(column)), F.lit(False))
    return hit.select(*rows.columns, maybe.alias(mark))


def sieve(rows: DataFrame, column: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows whose ``column`` may be among ``ids``: every one that is, and a few others."""
    mark, = free_names(rows, "_maybe")
    return mark_possible(rows, column, ids, id_col, mark).filter(F.col(mark)).drop(mark)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of the graph with nodes 0..n-1 and edges (i, j): at most n - 1, each towards a root's smallest node."""
    label = np.arange(n)
    while len(i):
        m = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], m)
        np.minimum.at(new, label[j], m)
        new = new[new]
        while True:
            nxt = new[new]
            if (nxt == new).all():
                break
            new = nxt
        new = new[label]
        if (new == label).all():
            break
        label = new
    return [(int(k), int(label[k])) for k in np.flatnonzero(label != np.arange(n))]


def sorted_groups(batches: Iterator, keys: list[str], work: Callable) -> Iterator:
    """For ``mapInArrow`` over partitions sorted by ``keys``: ``work(table)`` of each whole group.

    Only the group at hand is held (the caller bounds group sizes); results come out in batches."""
    import pyarrow as pa

    held: list = []

    def groups() -> Iterator:
        """Tables of whole groups, with the boundaries of the groups in each."""
        nonlocal held
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            cut = _starts(table, keys)
            if len(cut) > 1:
                yield table.slice(0, cut[-1]), cut
                rest = table.slice(cut[-1])
            else:
                rest = table
            held = rest.combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield table, np.append(_starts(table, keys), table.num_rows)

    for table, cut in groups():
        out = [r for r in work(table.combine_chunks(), cut) if r is not None and r.num_rows]
        for r in out:
            yield r


def _starts(table, keys: list[str]) -> np.ndarray:
    """Row numbers where a group starts."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table[k].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)
