"""Timed scoring and training jobs, and their summaries.

A timed scoring pass ends in the ``noop`` sink: every row is produced and
dropped.  ``count()`` is not used as the forcing action because Catalyst
prunes the prediction column (and any UDF computing it) from a count's plan,
so it would time the scan only.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from parallax.model import Model
from parallax.operators.train import TrainOptions, fit, place
from parallax.plans.accounting import run_group

BENCH_RUNS_SCHEMA = "name string, iteration int, n_records bigint, ns bigint"


def run_pass(df: DataFrame) -> int:
    """Materialise every row of ``df`` into the noop sink; returns nanoseconds."""
    t0 = time.perf_counter_ns()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter_ns() - t0


def run_counted_pass(df: DataFrame) -> tuple[int, int]:
    """``run_pass`` that also counts the rows it wrote (an ``Observation``
    on the same pass: no second job over the data)."""
    obs = Observation("parallax_rows")
    t0 = time.perf_counter_ns()
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    ns = time.perf_counter_ns() - t0
    return ns, int(obs.get["rows"])


def count_predictions(scored: DataFrame, prediction: str = "prediction") -> DataFrame:
    """``n_records``: a global count of the rows whose first output is not null, so every row is scored."""
    return scored.agg(F.count(F.col(prediction)[0]).alias("n_records"))


def bench_score(spark: SparkSession, scored: DataFrame, iterations: int = 50, name: str = "score",
                n_records: int | None = None) -> DataFrame:
    """``bench_runs``: one row per timed pass of ``scored`` (scan, parse and score
    are all inside each pass, as they are re-done every time).

    Records are counted during each pass (an ``Observation``), unless
    ``n_records`` is given; no extra pass over the data either way. Each pass is a job group of its own:
    ``plans.accounting.run_metrics`` tells from the event log what it cost.
    """
    rows = []
    for i in range(iterations):
        with run_group(spark, name, i):
            if n_records is None:
                ns, n = run_counted_pass(scored)
            else:
                ns, n = run_pass(scored), n_records
        rows.append((name, i, n, ns))
    return spark.createDataFrame(rows, BENCH_RUNS_SCHEMA)


def bench_fit(spark: SparkSession, examples: DataFrame, model: Model, epochs: int = 50, iterations: int = 1,
              warmup: int = 0, options: TrainOptions = TrainOptions(), name: str = "fit",
              worker_col: str | None = None, order_col: str | None = None, layout: str = "auto"):
    """Warm-up ``warmup x epochs`` untimed, then ``iterations x epochs`` timed.

    Returns ``(bench_runs, model, history)``; one run row per iteration, with
    ``n_records`` = rows trained on.  Placement is done once, untimed, and
    reused by every iteration.
    """
    placed = place(examples, options, worker_col, order_col, model.n_inputs, model.n_outputs, layout)
    try:
        for _ in range(warmup):
            model, _h = fit(examples, model, epochs, options, placed=placed)
        rows, history = [], []
        for i in range(iterations):
            with run_group(examples.sparkSession, name, i):
                t0 = time.perf_counter_ns()
                model, h = fit(examples, model, epochs, options, placed=placed)
                ns = time.perf_counter_ns() - t0
            rows.append((name, i, sum(e["rows"] for e in h), ns))
            history.extend(h)
    finally:
        placed.release()
    return spark.createDataFrame(rows, BENCH_RUNS_SCHEMA), model, history


def summarise_runs(runs: DataFrame) -> DataFrame:
    """Per benchmark name: runs, records, total ms and mean ns per record.

    The mean is an exact integer division and null when no records were seen
    (never a division by zero).
    """
    return runs.groupBy("name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("n_records").alias("n_records"),
        F.expr("sum(ns) div 1000000").alias("total_ms"),
        F.expr("sum(ns) div nullif(sum(n_records), 0)").alias("mean_ns_per_record"),
    )
