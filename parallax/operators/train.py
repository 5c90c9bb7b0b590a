"""Data-parallel minibatch training with periodic parameter averaging.

1. ``assign_workers``: every example gets ``worker`` (a seeded hash of its
   id, or ``pmod`` of a given column) and a position in a per-worker order
   (a second seeded hash, i.e. shuffled, or a given column);
   ``batch_no = pos div batch_size``, ``round_no = batch_no div F``.
   Two layouts compute the same numbers (see ``assign_workers``): ``worker``
   (one partition per worker, position = index after a local sort) for
   inputs with no more splits than workers, and ``range`` (range partitions
   over ``(worker, order)`` + a small per-partition count table) so that no
   task holds a whole worker's share, however large or skewed.
2. ``place`` materialises the placement once per ``fit``: persisted
   (``worker`` layout, rows sorted by round so cached batches of
   other rounds are skipped by min/max statistics) or written as Parquet
   under the shared checkpoint folder (``range`` layout, or
   ``storage="checkpoint"``): one file per worker and unit, a unit being a run
   of rounds (or of a long round's minibatches) of at most
   ``ROUND_TASK_MAX_ROWS`` rows, sorted (see ``Units``).
3. One Spark job per averaging round: ``filter(round_no = r)`` -> ``mapInArrow``
   streaming each worker's rows in batch order (the gradient of a minibatch is
   summed over Arrow chunks, so memory is bounded by the Arrow batch, not by
   ``batch_size x F``) -> one ``(worker, params, n, loss)`` row per worker ->
   the row-weighted average (numpy on the driver while ``workers x params``
   is small, else ``average_parameters``, in blocks), which becomes the next round's
   starting point. Nothing is shuffled: a persisted partition holds one worker, and
   of a written placement each task reads one worker's file, whole, in order. ``fit``'s short rounds
   read packed minibatches instead (see ``PackedRounds``). A share of
   more than ``ROUND_TASK_MAX_ROWS`` rows runs as a chain of bounded jobs that
   carry each worker's parameters.

Plain SGD on squared error; averaging is weighted by rows, over the workers
that had rows in the round (Zinkevich et al. 2010; McDonald et al. 2010).
Lineage does not grow across rounds: parameters travel as task closures.
A lost executor re-runs only its tasks: placement is persisted, checkpointed
or written, and every round is a deterministic function of its inputs.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, replace
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.model import Model, ModelRef, loss_grad_sums
from parallax.operators.row_ids import file_offsets
from parallax.session import delete_path, list_files, path_exists, read_bytes, scratch_path, write_bytes

WORKER_PARAMS_SCHEMA = "worker int, params array<double>, n bigint, loss double"
# The same as a StructType: no DDL parse (a JVM round trip) per round job.
_WORKER_PARAMS_TYPE = T.StructType([
    T.StructField("worker", T.IntegerType()),
    T.StructField("params", T.ArrayType(T.DoubleType())),
    T.StructField("n", T.LongType()),
    T.StructField("loss", T.DoubleType()),
])
# The worker layout sorts one worker's whole share in one task; ``auto`` uses
# it only while that share is at most this many bytes by the plan's own size
# estimate (files: their bytes, however many splits), else the range layout.
WORKER_TASK_MAX_BYTES = 512 << 20
# ... and while its rows, as the sort holds them, are at most this many bytes
# (rows counted: compressed files say little of it).
WORKER_SORT_MAX_BYTES = 384 << 20
# Rows of one bucket of the range layout, which a task sorts.
RANGE_TASK_MAX_ROWS = 1_000_000
# Rows of a worker that one task steps through: a longer round runs as a
# chain of jobs that carry each worker's parameters on.
ROUND_TASK_MAX_ROWS = 4_000_000
# A written placement's files are read one to a task: beyond any file's size.
WHOLE_FILE_BYTES = 1 << 44
# Upper bound on the Arrow batch used by round jobs (rows).
ROUND_ARROW_MAX_ROWS = 131_072
# Packed rounds (``PackedRounds``): bytes of a partition, as wanted and at most, and partitions at most.
PACK_BYTES = 1 << 20
PACK_MAX_BYTES = 32 << 20
PACK_MAX_PARTITIONS = 8192
# Largest workers x parameters count averaged on the driver (4M doubles, 32 MB).
DRIVER_AVERAGE_MAX = 1 << 22
# Parameters to a row where vectors are averaged on Spark (32 KB).
AVERAGE_BLOCK = 4096


@dataclass(frozen=True)
class TrainOptions:
    """Knobs of a training run (what a training strategy object holds)."""

    workers: int = 4
    batch_size: int = 2048  # minibatch per worker
    averaging_frequency: int | None = 5  # minibatches between averagings; None = once per epoch
    learning_rate: float = 0.1
    seed: int = 12345
    storage: str = "persist"  # "persist" (memory+disk) or "checkpoint" (Parquet in the shared checkpoint folder)

    def __post_init__(self):
        if self.workers < 1 or self.batch_size < 1:
            raise ValueError("workers and batch_size must be positive")
        if self.averaging_frequency is not None and self.averaging_frequency < 1:
            raise ValueError("averaging_frequency must be positive or None")
        if self.storage not in ("persist", "checkpoint"):
            raise ValueError("storage must be 'persist' or 'checkpoint'")


@dataclass(frozen=True)
class Units:
    """How a written placement is cut into files: ``rounds`` whole rounds to a unit, or, where a worker's share of one
    round is more than ``ROUND_TASK_MAX_ROWS``, ``batches`` of its minibatches, ``per_round`` units to a round."""

    rounds: int
    batches: int = 0
    per_round: int = 1
    frequency: int | None = None

    @staticmethod
    def of(options: "TrainOptions") -> "Units":
        b, f = options.batch_size, options.averaging_frequency
        if f is not None and b * f <= ROUND_TASK_MAX_ROWS:
            return Units(ROUND_TASK_MAX_ROWS // (b * f), frequency=f)
        per = max(1, ROUND_TASK_MAX_ROWS // b)
        return Units(1, per, 1 if f is None else -(-f // per), f)

    def column(self) -> str:
        """SQL of a row's unit."""
        if not self.batches:
            return f"round_no div {self.rounds}"
        if self.frequency is None:
            return f"batch_no div {self.batches}"
        return f"round_no * {self.per_round} + (batch_no - round_no * {self.frequency}) div {self.batches}"

    def number(self, round_no: int, first_batch: int | None = None) -> int:
        """The unit of a round, or of the run of its minibatches from ``first_batch`` on."""
        if not self.batches:
            return round_no // self.rounds
        if self.frequency is None:
            return (first_batch or 0) // self.batches
        first = round_no * self.frequency
        return round_no * self.per_round + ((first if first_batch is None else first_batch) - first) // self.batches


def _shuffle_width(df: DataFrame, workers: int) -> int:
    """Partitions for the range layout's shuffles: ``spark.sql.shuffle.partitions``
    (the cluster's own shuffle sizing; sizing by input splits would give
    map x reduce block counts the driver cannot track at 100 TB), and at
    least one per worker."""
    conf = df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")
    return max(int(conf), workers)


def _plan_bytes(df: DataFrame) -> int:
    """The optimiser's size estimate of ``df``: no job is run for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _sort_bytes(df: DataFrame) -> int:
    """About what a row takes in a sort: eight bytes a value, more for an array or a string, and the sort's own pointers."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    return 32 + sum(8 if isinstance(f.dataType, fixed) else 48 for f in df.schema.fields)


def _order_columns(examples: DataFrame, seed: int, order_col: str | None, row_id: str) -> list:
    tie = [F.col(row_id)] if row_id in examples.columns else []
    if order_col is None:
        return [F.xxhash64(F.col(row_id), F.lit(seed + 1)), *tie]
    return [F.col(order_col), *([] if order_col == row_id else tie)]


def assign_workers(examples: DataFrame, workers: int, batch_size: int, averaging_frequency: int | None = None,
                   seed: int = 12345, worker_col: str | None = None, order_col: str | None = None,
                   row_id: str = "row_id", layout: str = "auto", num_partitions: int | None = None,
                   keep_position: bool = False) -> DataFrame:
    """``worker_batches``: the input plus ``worker, batch_no, round_no``.

    ``worker`` is ``pmod(xxhash64(row_id, seed), workers)`` unless
    ``worker_col`` names one (then ``pmod(worker_col, workers)``, null -> 0).  Rows of a
    worker are numbered in ``order_col`` order (default: a seeded hash of
    ``row_id``, i.e. shuffled), ``batch_no = pos div batch_size``,
    ``round_no = batch_no div averaging_frequency`` (0 for all when None).

    Two layouts give the same numbers:

    * ``"worker"``: partition ``w`` holds exactly worker ``w``, sorted; the
      position is the row's index in its partition.  One shuffle,
      but one task sorts a whole worker's share: ``auto`` picks it
      while that share is at most ``WORKER_TASK_MAX_BYTES`` by the plan and
      ``WORKER_SORT_MAX_BYTES`` by its rows, which it counts (hashed workers:
      the input's size / workers; a given worker column, which may be
      skewed: the input's size).
    * ``"range"``: many partitions (``num_partitions``, default:
      ``spark.sql.shuffle.partitions``), each a contiguous range of one
      worker's order, so no
      task holds more than one range however large (or skewed) a worker
      is.  Position = index in the partition + the worker's rows in earlier
      ranges, from a small count table broadcast back.  With the default
      hashed order the ranges are equal-width hash slices (see
      ``_hash_range_positions``; nothing is materialised); with an explicit
      ``order_col`` they come from ``repartitionByRange`` and are
      written once so counts and rows see the same partitioning.
      Adds ``_pos`` (kept: it orders a worker's rows in a round).
    """
    if workers < 1 or batch_size < 1:
        raise ValueError("workers and batch_size must be positive")
    if worker_col is None:
        worker = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(workers))
    else:
        # a null worker value goes to worker 0 (never dropped by the joins below)
        worker = F.coalesce(F.pmod(F.col(worker_col), F.lit(workers)), F.lit(0))
    order = _order_columns(examples, seed, order_col, row_id)
    n_rows = None
    if layout == "auto":
        # Hashed workers are balanced; a given worker column may put every row in one worker.
        shares = workers if worker_col is None else 1
        fits = _plan_bytes(examples) <= WORKER_TASK_MAX_BYTES * shares
        if fits:
            n_rows = examples.count()
            fits = n_rows * _sort_bytes(examples) <= WORKER_SORT_MAX_BYTES * shares
        layout = "worker" if fits else "range"
    keyed = examples.withColumn("worker", worker.cast("int"))
    written: list[str] = []
    local_idx = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    if layout == "worker":
        placed = keyed.repartitionById(workers, F.col("worker")).sortWithinPartitions(*order)
        placed = placed.withColumn("_p", local_idx)
    elif layout == "range" and order_col is None:
        placed, n_rows = _hash_range_positions(keyed, workers, seed, row_id, num_partitions or _shuffle_width(keyed, workers),
                                               None if num_partitions else RANGE_TASK_MAX_ROWS)
    elif layout == "range":
        if n_rows is None:
            n_rows = examples.count()
        parts = num_partitions or max(_shuffle_width(keyed, workers), -(-n_rows // RANGE_TASK_MAX_ROWS))
        ranged = (
            keyed.repartitionByRange(parts, F.col("worker"), *order)
            .sortWithinPartitions(F.col("worker"), *order)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_idx", local_idx)
        )
        # Written once (shared checkpoint folder): the counts and the rows
        # must see the same partitioning, and two separately optimised copies
        # of the range exchange may sample different bounds.
        path = scratch_path(examples.sparkSession, "ranged")
        ranged.write.parquet(path)
        written.append(path)
        ranged = examples.sparkSession.read.parquet(path)
        counts = ranged.groupBy("_pid", "worker").agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
        before = Window.partitionBy("worker").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("_pid", "worker", "_first",
                                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
        placed = (
            ranged.join(F.broadcast(offsets), ["_pid", "worker"])
            .withColumn("_p", F.col("_off") + F.col("_idx") - F.col("_first"))
            .drop("_pid", "_idx", "_off", "_first")
        )
    else:
        raise ValueError("layout must be 'auto', 'worker' or 'range'")
    placed = placed.withColumn("batch_no", F.expr(f"_p div {int(batch_size)}"))
    rounds = F.lit(0).cast("long") if averaging_frequency is None else F.expr(
        f"batch_no div {int(averaging_frequency)}")
    placed = placed.withColumn("round_no", rounds)
    placed = placed.withColumnRenamed("_p", "_pos") if layout == "range" or keep_position else placed.drop("_p")
    placed._parallax_paths = written
    placed._parallax_rows = n_rows  # None where no one counted
    placed._parallax_frequency = averaging_frequency
    return placed


def _hash_range_positions(keyed: DataFrame, workers: int, seed: int, row_id: str, parts: int, most: int | None) -> tuple[DataFrame, int]:
    """(rows, their number): positions for the default (hashed) order without materialising anything.

    The order key ``h = xxhash64(row_id, seed + 1)`` is uniform over the
    64-bit range. One counting pass counts the rows of every worker in fixed,
    equal-width slices of it (at most 2^20 counts, which the driver reads); neighbouring slices of a worker
    are merged to buckets of about ``rows / parts`` rows (or ``most``, if that is fewer), so a hot worker
    gets many. Each bucket is one partition (``repartitionById``), sorted by
    ``(h, row_id)``; position = the worker's rows in earlier slices (from the
    same counts, carried with the row) + index in the partition. Everything is a function
    of the data, so a recomputed partition gets the same positions. A slice is
    not split, so ids must be unique (rows that share an id share a slice).
    """
    slices = max(16, min(4096, (1 << 20) // max(workers, 1)))
    h = F.xxhash64(F.col(row_id), F.lit(seed + 1))
    frac = F.col("_h").cast("double") / F.lit(float(2 ** 64)) + F.lit(0.5)
    keyed = keyed.withColumn("_h", h).withColumn("_s", F.least(F.floor(frac * slices), F.lit(slices - 1)).cast("int"))
    counts = keyed.groupBy("worker", "_s").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counts)
    target = max(1, -(-total // max(parts, 1)))  # rows per bucket ~ rows per wanted partition
    target = min(target, most or target)
    table, bucket, filled, off, of = [], -1, 0, 0, None
    for r in sorted(counts, key=lambda r: (r["worker"], r["_s"])):
        if r["worker"] != of or filled >= target:
            if r["worker"] != of:
                of, seen = r["worker"], 0
            bucket, filled, off = bucket + 1, 0, seen
        table.append((r["worker"], r["_s"], bucket, off))
        filled += r["n"]
        seen += r["n"]
    spark = keyed.sparkSession
    shape = spark.createDataFrame(table, "worker int, _s int, _b int, _off long")  # at most 2^20 rows
    local_idx = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    ordered = (
        keyed.join(F.broadcast(shape), ["worker", "_s"])
        .repartitionById(max(bucket + 1, 1), F.col("_b"))
        .sortWithinPartitions("_h", row_id)
        .withColumn("_p", F.col("_off") + local_idx)
    )
    return ordered.drop("_b", "_h", "_s", "_off"), total


def _refuse_missing(x: np.ndarray, y: np.ndarray) -> None:
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("training examples contain null, NaN or infinite features or labels; "
                         "keep only good records (sources.csv.good_records) or fill them first")


def _run_round(batches, ref: ModelRef, learning_rate: float, n_in: int, n_out: int, starts: dict | None = None):
    """For ``mapInArrow``: one round over a partition of (worker, batch_no, x..., y...) rows, sorted by both; ``starts``
    holds the workers' own parameters where a round goes on from an earlier job."""
    import pyarrow as pa

    model = ref.get()
    start = model.params()
    xcols = [f"x{i}" for i in range(n_in)]
    ycols = [f"y{i}" for i in range(n_out)]
    out = []
    cur_w = None
    params = start
    m = model
    b_id, b_n, b_loss, b_grad = None, 0, 0.0, None
    w_n, w_loss = 0, 0.0

    def close_batch():
        nonlocal params, m, b_id, b_n, b_loss, b_grad, w_n, w_loss
        if b_id is not None and b_n:
            params = params - learning_rate * (b_grad / b_n)
            m = m.with_params(params)
            w_n += b_n
            w_loss += b_loss
        b_id, b_n, b_loss, b_grad = None, 0, 0.0, None

    def close_worker():
        nonlocal params, m, w_n, w_loss
        close_batch()
        if cur_w is not None and w_n:
            out.append((int(cur_w), params.copy(), int(w_n), float(w_loss / w_n)))
        params, m, w_n, w_loss = start, model, 0, 0.0

    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        wk, bn = batch.column("worker").to_numpy(), batch.column("batch_no").to_numpy()
        x, y = _matrix(batch, xcols), _matrix(batch, ycols)
        _refuse_missing(x, y)
        # runs of equal (worker, batch_no); rows arrive sorted by both
        change = np.flatnonzero((wk[1:] != wk[:-1]) | (bn[1:] != bn[:-1])) + 1
        bounds = np.concatenate([[0], change, [rows]])
        for s, e in zip(bounds[:-1], bounds[1:]):
            if wk[s] != cur_w:
                close_worker()
                cur_w = wk[s]
                if starts and int(cur_w) in starts:
                    params = starts[int(cur_w)]
                    m = model.with_params(params)
            if bn[s] != b_id:
                close_batch()
                b_id = bn[s]
            loss, grad = loss_grad_sums(m, x[s:e], y[s:e])
            b_n += e - s
            b_loss += loss
            b_grad = grad if b_grad is None else b_grad + grad
    close_worker()
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.list_(pa.float64())),
             pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.float64())],
            names=["worker", "params", "n", "loss"])


def _matrix(batch, cols: list[str]) -> np.ndarray:
    """An Arrow batch's columns as a matrix; nulls become NaN."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in cols])


def _flat_columns(df: DataFrame, n_in: int, n_out: int, features: str = "features", label: str = "label") -> list:
    """``x0.., y0..``: as they are, or from the arrays, whose widths must be the model's."""
    if all(f"x{i}" in df.columns for i in range(n_in)) and all(f"y{j}" in df.columns for j in range(n_out)):
        return [F.col(f"x{i}") for i in range(n_in)] + [F.col(f"y{j}") for j in range(n_out)]

    def part(col: str, n: int, what: str, name: str) -> list:
        wrong = F.concat(F.lit(f"the model takes {n} {what}, a row has "), F.size(col).cast("string"))
        ok = F.col(col).isNull() | (F.size(col) == n)
        # the check rides on the first value; a null array gives null values, which training refuses
        first = F.when(ok, F.col(col)[0]).otherwise(F.raise_error(wrong).cast("double"))
        return [(first if i == 0 else F.col(col)[i]).alias(f"{name}{i}") for i in range(n)]

    return part(features, n_in, "features", "x") + part(label, n_out, "labels", "y")


def fit_round(placed: DataFrame, model: Model, round_no: int | None, learning_rate: float,
              features: str = "features", label: str = "label", workers: int | None = None,
              model_ref: ModelRef | None = None, starts: dict | None = None,
              batches: tuple[int, int] | None = None) -> DataFrame:
    """``worker_params`` after one averaging round: each worker starts from
    ``model`` (or its own entry in ``starts``) and steps through its minibatches of round ``round_no`` (all
    rounds when None; only those from ``batches[0]`` up to ``batches[1]`` if given); ``loss`` is the mean loss
    over its rows, each taken before the step of its minibatch.  With the ``worker`` layout there is no
    shuffle (rows are already placed), and none for a written placement (its files are a worker's each);
    rows that ``assign_workers`` numbered in the ``range`` layout are regrouped by worker (``fit`` bounds how many), or,
    where a round is one minibatch, stay where they lie: only their gradient sums meet."""
    rows = _round_rows(placed, round_no, batches)
    n_in, n_out = model.n_inputs, model.n_outputs
    cols = set(placed.columns)
    one_step = round_no is not None and not starts and batches is None and getattr(placed, "_parallax_frequency", None) == 1
    if "_pos" in cols and "unit" not in cols and one_step:
        flat = rows.select("worker", *_flat_columns(placed, n_in, n_out, features, label))
        ref = model_ref or ModelRef(model, placed.sparkSession.sparkContext)
        return _one_step(_gradient_parts(flat, n_in, n_out, {}, ref), ref, learning_rate,
                         workers or placed.sparkSession.sparkContext.defaultParallelism)
    if "_pos" in cols and "unit" not in cols:
        # range layout, not written by ``place``: bring each worker's rows into one task, in position order
        parts = workers or placed.sparkSession.sparkContext.defaultParallelism
        rows = rows.repartitionById(parts, F.col("worker")).sortWithinPartitions("worker", "batch_no", "_pos")
    wanted = {"worker", "batch_no", "round_no", *(f"x{i}" for i in range(n_in)), *(f"y{j}" for j in range(n_out))}
    # placed rows that already hold exactly the flat columns go in as they are
    # (one transformation, so one analysis, fewer per round job)
    flat = rows if cols == wanted else rows.select("worker", "batch_no", *_flat_columns(placed, n_in, n_out, features, label))
    ref = model_ref or ModelRef(model, placed.sparkSession.sparkContext)
    return flat.mapInArrow(partial(_run_round, ref=ref, learning_rate=learning_rate, n_in=n_in, n_out=n_out, starts=starts), _WORKER_PARAMS_TYPE)


def _round_rows(placed: DataFrame, round_no: int | None, batches: tuple[int, int] | None) -> DataFrame:
    rows = placed if round_no is None else placed.filter(F.col("round_no") == F.lit(round_no))
    units = getattr(placed, "_parallax_units", None)  # known to ``fit``
    if round_no is not None and units and (batches or not units.batches):
        rows = rows.filter(F.col("unit") == F.lit(units.number(round_no, batches[0] if batches else None)))  # prunes directories
    if batches is not None:
        rows = rows.filter((F.col("batch_no") >= batches[0]) & (F.col("batch_no") < batches[1]))
    return rows


def _gradient_parts(flat: DataFrame, n_in: int, n_out: int, starts: dict, ref: ModelRef) -> DataFrame:
    """``(worker, v)``: each task's gradient sum of each worker in it, then its rows and loss sum."""
    def run(frames):
        import pandas as pd

        m = ref.get()
        sums: dict = {}
        for pdf in frames:
            x = pdf[[f"x{i}" for i in range(n_in)]].to_numpy(dtype=np.float64)
            y = pdf[[f"y{j}" for j in range(n_out)]].to_numpy(dtype=np.float64)
            _refuse_missing(x, y)
            for w in np.unique(pdf["worker"].to_numpy()).tolist():
                at = (pdf["worker"] == w).to_numpy()
                loss, grad = loss_grad_sums(m.with_params(starts[w]) if w in starts else m, x[at], y[at])
                had = sums.get(w)
                v = np.append(grad, (at.sum(), loss))
                sums[w] = v if had is None else had + v
        if sums:
            yield pd.DataFrame({"worker": np.array(list(sums), np.int32), "v": list(sums.values())})

    return flat.mapInPandas(run, "worker int, v array<double>")


def _one_step(parts: DataFrame, ref: ModelRef, learning_rate: float, tasks: int) -> DataFrame:
    """``worker_params`` after one step on the sums of ``_gradient_parts``, a vector from each task."""
    def run(batches):
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for w, v in zip(b.column("worker").to_pylist(), b.column("v")):
                v = np.asarray(v.values)
                sums[w] = sums[w] + v if w in sums else v
        start = ref.get().params()
        for w, v in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([w], pa.int32()), pa.array([start - learning_rate * (v[:-2] / v[-2])], pa.list_(pa.float64())),
                 pa.array([int(v[-2])], pa.int64()), pa.array([float(v[-1] / v[-2])], pa.float64())], names=["worker", "params", "n", "loss"])

    numbered = parts.withColumn("at", F.spark_partition_id())
    return (numbered.repartitionById(tasks, F.col("worker") % tasks).sortWithinPartitions("worker", "at")
            .mapInArrow(run, _WORKER_PARAMS_TYPE))


def _gradient_sums(placed: DataFrame, model: Model, round_no: int, batch: int, starts: dict, ref: ModelRef) -> dict:
    """worker -> (gradient sum, rows, loss sum) of one minibatch: summed where its rows lie, over any number of
    tasks, then by Spark; what comes back is one vector per worker."""
    n_in, n_out = model.n_inputs, model.n_outputs
    flat = _round_rows(placed, round_no, (batch, batch + 1)).select("worker", *_flat_columns(placed, n_in, n_out))

    parts = _gradient_parts(flat, n_in, n_out, starts, ref)
    got = parts.select("worker", F.posexplode("v").alias("pos", "v")).groupBy("worker", "pos").agg(F.sum("v").alias("v")).collect()
    out: dict = {}
    for r in got:
        out.setdefault(r["worker"], np.zeros(model.n_params + 2))[r["pos"]] = r["v"]
    return {w: (v[:-2], int(v[-2]), float(v[-1])) for w, v in out.items()}


def _long_round(placed: DataFrame, model: Model, round_no: int, options: "TrainOptions", n_batches: int):
    """A round whose share per worker is more than ``ROUND_TASK_MAX_ROWS``, as a chain of bounded jobs that carry
    every worker's parameters on (``workers x parameters`` numbers); the average comes at the end.

    Minibatches that fit are stepped through several to a job; a minibatch that does not is summed over many tasks."""
    per_round = n_batches if options.averaging_frequency is None else options.averaging_frequency
    first = 0 if options.averaging_frequency is None else round_no * options.averaging_frequency
    last = min(n_batches, first + per_round)
    ref = ModelRef(model, placed.sparkSession.sparkContext)
    starts: dict = {}
    rows: dict = {}
    loss_sum = 0.0
    step = ROUND_TASK_MAX_ROWS // options.batch_size
    try:
        if step >= 1:
            for b in range(first, last, step):
                got = fit_round(placed, model, round_no, options.learning_rate, workers=options.workers, model_ref=ref,
                                starts=starts, batches=(b, min(last, b + step))).collect()
                for r in sorted(got, key=lambda r: r["worker"]):
                    starts[r["worker"]] = np.array(r["params"])
                    rows[r["worker"]] = rows.get(r["worker"], 0) + r["n"]
                    loss_sum += r["loss"] * r["n"]
        else:
            for b in range(first, last):
                for w, (grad, n, loss) in _gradient_sums(placed, model, round_no, b, starts, ref).items():
                    starts[w] = (starts[w] if w in starts else model.params()) - options.learning_rate * grad / n
                    rows[w] = rows.get(w, 0) + n
                    loss_sum += loss
    finally:
        ref.release()
    total = sum(rows.values())
    if not total:
        return None, None, 0
    return sum(starts[w] * rows[w] for w in sorted(rows)) / total, loss_sum / total, total


def average_parameters(worker_params: DataFrame, params: str = "params", weight: str | None = "n") -> DataFrame:
    """``(pos int, value double)``: the row-weighted mean of the workers'
    parameter vectors (plain mean when ``weight`` is None), in no order."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return (
        worker_params.select(F.posexplode(params).alias("pos", "v"), w.alias("_w"))
        .groupBy("pos")
        .agg((F.sum(F.col("v") * F.col("_w")) / F.sum("_w")).alias("value"))
    )


def average_blocks(worker_params: DataFrame, params: str = "params", weight: str | None = "n", order: str | None = None,
                   block: int = AVERAGE_BLOCK) -> DataFrame:
    """``(block int, values array<double>, weight double)``: ``average_parameters`` by runs of ``block`` parameters.

    A vector crosses the shuffle as a row for every ``block`` of its parameters, not one for each; a block's rows are
    added in Arrow as they come, by ``order`` (if given, sums repeat bit for bit), so a task holds one block's sum."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    src = worker_params.select((F.col(order) if order else F.lit(0)).cast("long").alias("at"), w.alias("w"), F.col(params).cast("array<double>").alias("v"))

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            at, w = b.column(0).to_numpy(), b.column(1).to_numpy()
            for k in range(b.num_rows):
                v = np.asarray(b.column(2)[k].values)
                first = np.arange(0, len(v), block)
                offsets = pa.array(np.append(first, len(v)).astype(np.int32))
                n = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, at[k])), pa.array(np.full(n, w[k])),
                     pa.ListArray.from_arrays(offsets, pa.array(v * w[k]))], names=["block", "at", "w", "v"])

    def add(batches):
        import pyarrow as pa

        held, total, mass = None, None, 0.0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int32()), pa.array([(total / mass).tolist()], pa.list_(pa.float64())), pa.array([mass])],
                                              names=["block", "values", "weight"])

        for b in batches:
            number, w = b.column(0).to_numpy(), b.column(2).to_numpy()
            for k in range(b.num_rows):
                v = np.asarray(b.column(3)[k].values)
                if number[k] != held:
                    if held is not None:
                        yield out()
                    held, total, mass = int(number[k]), v.copy(), float(w[k])
                else:
                    total += v
                    mass += w[k]
        if held is not None:
            yield out()

    return (src.mapInArrow(cut, "block int, at long, w double, v array<double>")
            .repartition("block").sortWithinPartitions("block", "at")
            .mapInArrow(add, "block int, values array<double>, weight double"))


class PackedRounds:
    """A placement's minibatches as float64 matrices in a persisted RDD, for rounds too short to pay for a query each.

    A partition holds one worker's minibatches of ``rounds`` successive rounds (about ``PACK_BYTES``), in order. A round is a job on
    its workers' partitions alone, planned once: no scan, no filter, no shuffle. A lost partition is packed anew from the placement."""

    def __init__(self, rows: DataFrame, n_rounds: int, options: TrainOptions, n_in: int, n_out: int, rounds: int):
        self.workers, self.rounds, self.width, self.n_in = options.workers, rounds, n_in + n_out, n_in
        slots = -(-n_rounds // rounds) * options.workers
        packed = rows.select("worker", "batch_no", "round_no", *_flat_columns(rows, n_in, n_out)).mapInArrow(
            partial(_pack, n_in=n_in, n_out=n_out), "worker int, batch_no long, round_no long, data binary")
        dealt = (packed.repartitionById(slots, F.expr(f"cast((round_no div {rounds}) * {options.workers} + worker as int)"))
                 .sortWithinPartitions("batch_no"))
        self.rdd = dealt.rdd.map(lambda r: (r["round_no"], r["worker"], bytes(r["data"]))).persist(StorageLevel.MEMORY_AND_DISK)
        self.rdd.count()  # packed now, so that rounds only read

    @staticmethod
    def rounds_of(n_rounds: int, options: TrainOptions, width: int) -> int:
        """Rounds to a partition; 0 where a round's share is too long to be packed, or the rounds too many."""
        if options.averaging_frequency is None or not n_rounds:
            return 0
        share = options.batch_size * options.averaging_frequency * width * 8
        rounds = max(PACK_BYTES // share, -(-n_rounds * options.workers // PACK_MAX_PARTITIONS), 1)
        return rounds if share * rounds <= PACK_MAX_BYTES else 0

    def run(self, ref: ModelRef, round_no: int, learning_rate: float) -> list[tuple]:
        """(worker, params, n, loss) of the workers with rows in the round."""
        first = round_no // self.rounds * self.workers
        step = partial(_run_packed, ref=ref, round_no=round_no, learning_rate=learning_rate, width=self.width, n_in=self.n_in)
        return self.rdd.context.runJob(self.rdd, step, list(range(first, first + self.workers)))

    def release(self) -> None:
        self.rdd.unpersist()


def _pack(batches, n_in: int, n_out: int):
    """For ``mapInArrow``: sorted (worker, batch_no, round_no, x..., y...) rows to a row per minibatch."""
    import pyarrow as pa

    held, parts = None, []

    def row():
        return [pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int64()), pa.array([held[2]], pa.int64()),
                pa.array([b"".join(p.tobytes() for p in parts)], pa.binary())]

    names = ["worker", "batch_no", "round_no", "data"]
    for batch in batches:
        if not batch.num_rows:
            continue
        wk, bn, rn = (batch.column(c).to_numpy() for c in names[:3])
        m = _matrix(batch, batch.schema.names[3:])
        _refuse_missing(m[:, :n_in], m[:, n_in:])
        change = np.flatnonzero((wk[1:] != wk[:-1]) | (bn[1:] != bn[:-1])) + 1
        bounds = np.concatenate([[0], change, [len(wk)]])
        for s, e in zip(bounds[:-1], bounds[1:]):
            key = (int(wk[s]), int(bn[s]), int(rn[s]))
            if key != held:
                if parts:
                    yield pa.RecordBatch.from_arrays(row(), names=names)
                held, parts = key, []
            parts.append(m[s:e].copy())
    if parts:
        yield pa.RecordBatch.from_arrays(row(), names=names)


def _run_packed(items, ref: ModelRef, round_no: int, learning_rate: float, width: int, n_in: int) -> list[tuple]:
    """One round over a worker's packed minibatches, in order."""
    m = ref.get()
    params, worker, n, loss = m.params(), None, 0, 0.0
    for r, w, data in items:
        if r != round_no:
            continue
        xy = np.frombuffer(data, np.float64).reshape(-1, width)
        part, grad = loss_grad_sums(m, np.ascontiguousarray(xy[:, :n_in]), np.ascontiguousarray(xy[:, n_in:]))
        params = params - learning_rate * (grad / len(xy))
        m = m.with_params(params)
        worker, n, loss = w, n + len(xy), loss + part
    return [] if worker is None else [(worker, params, n, loss / n)]


def _averaged_round(placed: DataFrame, model: Model, round_no: int | None, learning_rate: float,
                    workers: int, packed: PackedRounds | None = None):
    """Run one round, on the packed minibatches if there are any; return (averaged params, mean loss, rows).

    With at most ``DRIVER_AVERAGE_MAX`` values in ``workers x params`` the
    worker rows themselves are collected (what a tree aggregate would bring
    to the driver anyway) and averaged in numpy, saving a shuffle stage per
    round.  Above it, the vectors are averaged in blocks on Spark
    (``average_blocks``), with the loss riding along as one more position.
    """
    ref = ModelRef(model, placed.sparkSession.sparkContext)
    try:
        if packed is not None and workers * (model.n_params + 1) <= DRIVER_AVERAGE_MAX:
            return _average_vectors(packed.run(ref, round_no, learning_rate))
        return _average_round_rows(fit_round(placed, model, round_no, learning_rate, workers=workers,
                                             model_ref=ref), model, workers)
    finally:
        ref.release()  # a per-round broadcast (large models only) is dropped once used


def _average_vectors(got: list[tuple]):
    """The row-weighted average of (worker, params, n, loss) rows."""
    if not got:
        return None, None, 0
    _, params, n, loss = zip(*sorted(got, key=lambda r: r[0]))  # in one order, so that sums repeat bit for bit
    params, n, loss = (np.array(v, dtype=np.float64) for v in (params, n, loss))
    return (params * n[:, None]).sum(axis=0) / n.sum(), float((loss * n).sum() / n.sum()), int(n.sum())


def _average_round_rows(wp: DataFrame, model: Model, workers: int):
    if workers * (model.n_params + 1) <= DRIVER_AVERAGE_MAX:
        return _average_vectors(wp.collect())
    packed = wp.select("worker", F.concat("params", F.array(F.col("loss"))).alias("params"), "n")
    got = sorted(average_blocks(packed, order="worker").collect(), key=lambda r: r["block"])  # model-sized
    if not got:
        return None, None, 0
    vec = np.concatenate([np.array(r["values"]) for r in got])
    return vec[:-1], float(vec[-1]), int(got[0]["weight"])


class Placement(tuple):
    """``(placed DataFrame, n_rounds)``; ``release()`` frees what ``place``
    made: the persisted copy, or the tables written under the checkpoint
    folder, so repeated training runs do not pile up data."""

    def __new__(cls, df: DataFrame, rounds: int, batches: int = 0, paths: list[str] | None = None, units: Units | None = None):
        obj = super().__new__(cls, (df, rounds))
        obj.paths = paths or []
        obj.batches = batches  # of the longest worker
        obj.units = units      # of a written placement: its files
        obj._rows = None
        obj._view = None
        obj._packed = None
        return obj

    def packed(self, options: "TrainOptions", n_in: int, n_out: int) -> PackedRounds | None:
        """The minibatches packed, made once; None where a query per round serves better (see ``PackedRounds.rounds_of``)."""
        if self._packed is None and self.batches:
            rounds = PackedRounds.rounds_of(self[1], options, n_in + n_out)
            if rounds:
                self._packed = PackedRounds(self.round_rows(options), self[1], options, n_in, n_out, rounds)
        return self._packed

    def unpack(self) -> None:
        """Frees the packed minibatches; the placement stays."""
        if self._packed is not None:
            self._packed.release()
            self._packed = None

    def round_rows(self, options: "TrainOptions") -> DataFrame:
        """The placed rows in a session of their own on the same SparkContext, made once: round jobs run there.

        Adaptive planning is off (nothing is shuffled, so it has nothing to re-plan, and it would add latency to each of
        many small jobs), an Arrow batch holds a worker's round where that is bounded, and a written placement's files
        are read one to a task. The caller's settings are not touched."""
        if self._rows is None:
            df = self[0]
            spark = df.sparkSession
            arrow_key = "spark.sql.execution.arrow.maxRecordsPerBatch"
            per_round = options.batch_size * (options.averaging_frequency or 1)
            session = spark.newSession()
            for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
                session.conf.set(key, spark.conf.get(key))
            session.conf.set("spark.sql.adaptive.enabled", "false")
            session.conf.set(arrow_key, str(max(int(spark.conf.get(arrow_key, "10000")), min(per_round, ROUND_ARROW_MAX_ROWS))))
            if self.units:
                # a file is never cut, and its opening counts as a whole task's share, so no two meet in a task
                for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
                    session.conf.set(key, str(WHOLE_FILE_BYTES))
                self._rows = session.read.schema(df.schema).parquet(self.paths[0])
                self._rows._parallax_units = self.units
            else:
                self._view = f"parallax_placed_{uuid.uuid4().hex}"
                df.createGlobalTempView(self._view)  # finds the persisted copy from the other session
                self._rows = session.table(f"global_temp.{self._view}")
        return self._rows

    def release(self) -> None:
        self.unpack()
        df = self[0]
        if self._view:
            df.sparkSession.catalog.dropGlobalTempView(self._view)
        self._rows = self._view = None
        if df.is_cached:
            df.unpersist()
        for path in self.paths:
            delete_path(df.sparkSession, path)
        self.paths = []


def place(examples: DataFrame, options: TrainOptions, worker_col: str | None = None,
          order_col: str | None = None, n_inputs: int | None = None,
          n_outputs: int | None = None, layout: str = "auto") -> Placement:
    """Assign, place and materialise the examples; returns ``(placed, n_rounds)``.

    With the widths given, features and label are stored as plain double
    columns ``x0..``, ``y0..`` (cheaper to cache, scan and ship to Arrow);
    arrays of other widths raise an error.

    ``worker`` layout: persisted as placed.  ``range`` layout, or
    ``storage="checkpoint"``: written as Parquet under the shared checkpoint
    folder, a directory per unit and worker with one file in it, rows in order. A task
    writes whole files, each of at most ``ROUND_TASK_MAX_ROWS`` rows (a longer minibatch is
    several files, whose order does not matter: its gradient is a sum), so neither a hot worker nor a long round
    meets in one task. A round reads its unit's files, less the row groups of other rounds, and shuffles nothing.

    Where rounds are short, their minibatches are packed here as well (``PackedRounds``), from either kind of placement.
    """
    spark = examples.sparkSession
    assigned = assign_workers(examples, options.workers, options.batch_size, options.averaging_frequency,
                              options.seed, worker_col, order_col, layout=layout, keep_position=options.storage == "checkpoint")
    paths, rows = assigned._parallax_paths, assigned._parallax_rows
    written = "_pos" in assigned.columns
    if n_inputs is not None and n_outputs is not None:
        assigned = assigned.select("worker", "batch_no", "round_no", *(["_pos"] if written else []),
                                   *_flat_columns(assigned, n_inputs, n_outputs))
    if written:
        placement = _write_placed(assigned, options, paths, rows)
    else:
        placed = assigned.persist(StorageLevel.MEMORY_AND_DISK)
        placement = Placement(placed, *_extent(placed))
    if n_inputs is not None and n_outputs is not None:
        placement.packed(options, n_inputs, n_outputs)
    return placement


def _extent(placed: DataFrame) -> tuple[int, int]:
    """Rounds, and minibatches of the longest worker."""
    last = placed.agg(F.max(F.struct("batch_no", "round_no")).alias("top")).first()["top"]
    return (0, 0) if last is None else (int(last["round_no"]) + 1, int(last["batch_no"]) + 1)


def _write_placed(assigned: DataFrame, options: TrainOptions, paths: list[str], n_rows: int | None = None) -> Placement:
    """Rows with ``worker, batch_no, round_no, _pos`` as a written placement: a file per worker and unit.

    The files are dealt in turn over at least ``n_rows / ROUND_TASK_MAX_ROWS`` tasks, so a task sorts one or two. A minibatch longer than a file
    is a sum, in any order: its rows are written where they lie."""
    spark = assigned.sparkSession
    path = scratch_path(spark, "placed")
    units = Units.of(options)
    rows = assigned.withColumn("unit", F.expr(units.column()))
    dealt = rows
    if options.batch_size <= ROUND_TASK_MAX_ROWS:
        tasks = max(_shuffle_width(rows, options.workers), -(-(n_rows or 0) // ROUND_TASK_MAX_ROWS) + options.workers)
        while math.gcd(tasks, options.workers) > 1:  # so one worker's files go round all tasks
            tasks += 1
        dealt = rows.repartitionById(tasks, F.expr(f"cast((unit * {options.workers} + worker) % {tasks} as int)")).sortWithinPartitions("unit", "worker", "_pos")
    dealt.write.option("maxRecordsPerFile", ROUND_TASK_MAX_ROWS).partitionBy("unit", "worker").parquet(path)
    placed = _read_placed(spark, path, rows)
    return Placement(placed, *_extent(placed), [path, *paths], units)


def _read_placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def write_minibatches(examples: DataFrame, path: str, options: TrainOptions, worker_col: str | None = None, order_col: str | None = None,
                      layout: str = "auto") -> None:
    """Each minibatch of a placement as one Parquet file of ``features`` and ``label``, rows in order; the paths' order is
    that of batch and worker, as ``place_files`` deals them."""
    assigned = assign_workers(examples, options.workers, options.batch_size, options.averaging_frequency,
                              options.seed, worker_col, order_col, layout=layout, keep_position=True)
    number = F.lpad((F.col("batch_no") * options.workers + F.col("worker")).cast("string"), 18, "0")
    (assigned.withColumn("minibatch", number).repartition(_shuffle_width(assigned, options.workers), "minibatch")
     .sortWithinPartitions("minibatch", "_pos").select("minibatch", "features", "label")
     .write.option("maxRecordsPerFile", 0).partitionBy("minibatch").parquet(path))
    for written in assigned._parallax_paths:
        delete_path(examples.sparkSession, written)


def place_files(spark: SparkSession, paths: str | list[str], options: TrainOptions, n_inputs: int, n_outputs: int,
                features: str = "features", label: str = "label") -> Placement:
    """A placement of minibatch files: the k-th file by path is minibatch ``k div workers`` of worker ``k mod workers``.

    ``paths``: Parquet files or folders of them, each file one minibatch of at most ``options.batch_size`` rows, in its own order.
    The files' row counts are read first (no data column), then each task reads whole files' rows and writes them to
    their worker's unit, as ``place`` does, so rounds shuffle nothing. Files of no rows are passed over."""
    scan = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    path = scratch_path(spark, "minibatch-files")
    # one row per file, as in the driver's own list of the scan's files
    (file_offsets(scan).withColumn("k", (F.row_number().over(Window.orderBy("file")) - 1).cast("long"))
     .select("file", "rows", "k").write.parquet(path))
    files = spark.read.parquet(path)
    longest, n_rows = files.agg(F.max("rows"), F.sum("rows")).first()
    if longest is not None and longest > options.batch_size:
        raise ValueError(f"a minibatch file holds {longest} rows, the batch size is {options.batch_size}")
    rows = scan.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_i"), *_flat_columns(scan, n_inputs, n_outputs, features, label))
    f = options.averaging_frequency
    assigned = (rows.join(files, F.col("_file") == F.col("file"))
                .withColumn("worker", (F.col("k") % options.workers).cast("int")).withColumn("batch_no", F.expr(f"k div {options.workers}"))
                .withColumn("round_no", F.lit(0).cast("long") if f is None else F.expr(f"batch_no div {f}"))
                .withColumn("_pos", F.col("batch_no") * options.batch_size + F.col("_i"))
                .select("worker", "batch_no", "round_no", "_pos", *(f"x{i}" for i in range(n_inputs)), *(f"y{j}" for j in range(n_outputs))))
    return _write_placed(assigned, options, [path], n_rows)


def fit_paths(spark: SparkSession, paths: str | list[str], model: Model, epochs: int = 1, options: TrainOptions = TrainOptions(),
              features: str = "features", label: str = "label"):
    """``fit`` on minibatch files (see ``place_files``); returns ``(model, history)``."""
    placed = place_files(spark, paths, options, model.n_inputs, model.n_outputs, features, label)
    try:
        return fit(placed[0], model, epochs, options, placed=placed)
    finally:
        placed.release()


class Journal:
    """What a training run needs to go on after its driver is lost, in a folder that the next driver can reach.

    ``placement``: the options, the model's shape and the written placement; ``state-<n>``: after n rounds (of all
    epochs), the parameters bit for bit, and the epoch's loss and rows so far. A state is written beside its name and
    renamed, so a torn one is never read; the last two are kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _put(self, name: str, head: dict, body: bytes = b"") -> None:
        write_bytes(self.spark, f"{self.path}/{name}", json.dumps(head).encode() + b"\n" + body)

    def _get(self, name: str) -> tuple[dict, bytes]:
        head, _, body = read_bytes(self.spark, f"{self.path}/{name}").partition(b"\n")
        return json.loads(head), body

    def placement(self, run: dict) -> dict | None:
        """The placement that this run wrote, if its files are still there; another run's journal is refused."""
        if not path_exists(self.spark, f"{self.path}/placement"):
            return None
        head, _ = self._get("placement")
        if head["run"] != run:
            raise ValueError(f"the journal in {self.path} belongs to a run with other options, model or columns: {head['run']}")
        return head if path_exists(self.spark, f"{head['paths'][0]}/_SUCCESS") else None

    def keep_placement(self, run: dict, placed: Placement) -> None:
        self._put("placement", {"run": run, "paths": placed.paths, "rounds": placed[1], "batches": placed.batches,
                                "units": asdict(placed.units), "schema": placed[0].schema.json()})

    def _states(self) -> list[int]:
        return sorted(int(n[6:]) for n in list_files(self.spark, self.path) if n.startswith("state-") and n[6:].isdigit())

    def keep_state(self, n: int, params: np.ndarray, head: dict) -> None:
        self._put(f"state-{n}", head, params.astype("<f8").tobytes())
        for old in self._states()[:-2]:
            delete_path(self.spark, f"{self.path}/state-{old}")

    def state(self) -> tuple[int, dict, np.ndarray] | None:
        """Rounds done, the state's head and the parameters."""
        done = self._states()
        if not done:
            return None
        head, body = self._get(f"state-{done[-1]}")
        return done[-1], head, np.frombuffer(body, "<f8").astype(np.float64)


def _journaled_placement(journal: Journal, run: dict, make) -> Placement:
    spark = journal.spark
    known = journal.placement(run)
    if known is None:
        placed = make()
        journal.keep_placement(run, placed)
        return placed
    schema = T.StructType.fromJson(json.loads(known["schema"]))
    df = spark.read.schema(schema).parquet(known["paths"][0]).select(*schema.names)
    return Placement(df, known["rounds"], known["batches"], known["paths"], Units(**known["units"]))


def fit(examples: DataFrame, model: Model, epochs: int = 1, options: TrainOptions = TrainOptions(),
        worker_col: str | None = None, order_col: str | None = None, placed: tuple[DataFrame, int] | None = None,
        layout: str = "auto", journal: str | None = None, journal_every: int = 1, max_rounds: int | None = None):
    """Train ``model`` for ``epochs`` passes; returns ``(model, history)``.

    ``history`` has one entry per epoch: ``epoch, rounds, rows, loss,
    seconds`` (``loss`` is the row-weighted mean minibatch loss of the epoch).
    ``placed`` reuses an earlier ``place`` result (e.g. across benchmark runs).

    ``journal`` names a folder on shared storage: the placement is written (as with ``storage="checkpoint"``) and
    noted there, and after every ``journal_every`` rounds the parameters are. A later call with the same arguments, from
    another driver too, goes on after the last noted round and gives the parameters of a run that was never stopped,
    bit for bit (but for minibatches above ``ROUND_TASK_MAX_ROWS``, whose sums have no fixed order). More ``epochs`` go on
    from a finished run. ``max_rounds`` ends a call after so many rounds; the epoch under way has no history entry yet.

    Rounds run in a session of their own on the same SparkContext
    (``Placement.round_rows``); the caller's session settings are not touched.
    """
    own = placed is None
    book = None
    if own:
        if journal is not None:
            options = replace(options, storage="checkpoint")
        make = lambda: place(examples, options, worker_col, order_col, model.n_inputs, model.n_outputs, layout)
        if journal is None:
            placed = make()
        else:
            book = Journal(examples.sparkSession, journal)
            run = {"options": asdict(options), "worker_col": worker_col, "order_col": order_col, "layout": layout,
                   "layers": [[layer.n_in, layer.n_out, layer.activation] for layer in model.layers], "columns": examples.columns}
            placed = _journaled_placement(book, run, make)
    elif journal is not None:
        raise ValueError("a journal keeps its own placement")
    if not isinstance(placed, Placement):
        placed = Placement(*placed)
    n_rounds = placed[1]
    history: list[dict] = []
    done, loss_sum, rows, spent = 0, 0.0, 0, 0.0
    state = book.state() if book else None
    if state:
        done, head, params = state
        model = model.with_params(params)
        history, loss_sum, rows, spent = head["history"], head["loss_sum"], head["rows"], head["seconds"]
    finished = False
    try:
        rows_df = placed.round_rows(options)
        batches = placed.batches
        share = options.batch_size * (options.averaging_frequency or max(1, batches))
        long = placed.units is not None and batches and min(share, options.batch_size * batches) > ROUND_TASK_MAX_ROWS
        packed = None if long or (epochs * n_rounds <= done) else placed.packed(options, model.n_inputs, model.n_outputs)
        stop = epochs * n_rounds if max_rounds is None else min(epochs * n_rounds, done + max_rounds)
        t0 = time.perf_counter()
        while done < stop:
            epoch, r = divmod(done, n_rounds)
            if long:
                vec, loss, n = _long_round(rows_df, model, r, options, batches)
            else:
                vec, loss, n = _averaged_round(rows_df, model, r, options.learning_rate, options.workers, packed)
            if vec is not None:
                model = model.with_params(vec)
                loss_sum += loss * n
                rows += n
            done += 1
            if r == n_rounds - 1:
                now = time.perf_counter()
                history.append({"epoch": epoch, "rounds": n_rounds, "rows": rows, "loss": (loss_sum / rows) if rows else None,
                                "seconds": spent + now - t0})
                t0, loss_sum, rows, spent = now, 0.0, 0, 0.0
            if book and (done % journal_every == 0 or done == stop):
                book.keep_state(done, model.params(), {"history": history, "loss_sum": loss_sum, "rows": rows,
                                                       "seconds": spent + time.perf_counter() - t0})
        if not n_rounds:
            history = [{"epoch": e, "rounds": 0, "rows": 0, "loss": None, "seconds": 0.0} for e in range(epochs)]
        finished = done >= epochs * n_rounds
    finally:
        if own:
            placed.unpack()
        if own and (book is None or finished):
            placed.release()  # a journal's placement stays until the run is over
    return model, history
