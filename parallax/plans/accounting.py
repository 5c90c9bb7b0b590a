"""What timed runs cost, from Spark's event log: tasks, time in tasks, rows and bytes read, rows and bytes shuffled.

A timed pass runs under a job group of its own (``run_group``), so every job, stage and task of it can be told in
the log (``spark.eventLog.enabled``, ``spark.eventLog.dir``) while it grows or after the application has ended. The log
is read by Spark as JSON lines with a fixed schema, so a log of any length is aggregated by tasks, not by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = "parallax-run:"
_GROUP_KEY = "spark.jobGroup.id"
# The fields of the log's events that are read.
EVENT_SCHEMA = """
  Event string, `Job ID` long, `Stage IDs` array<long>, Properties map<string,string>, `Stage ID` long,
  `Task Info` struct<Failed: boolean, Killed: boolean>,
  `Task Metrics` struct<
    `Executor Run Time`: long, `Executor CPU Time`: long,
    `Input Metrics`: struct<`Bytes Read`: long, `Records Read`: long>,
    `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: long, `Shuffle Records Written`: long>>
"""


@contextmanager
def run_group(spark: SparkSession, name: str, iteration: int) -> Iterator[None]:
    """Jobs started inside belong to the run; the job group before is set again after."""
    sc = spark.sparkContext
    before = sc.getLocalProperty(_GROUP_KEY)
    sc.setLocalProperty(_GROUP_KEY, f"{GROUP}{iteration}:{name}")
    try:
        yield
    finally:
        sc.setLocalProperty(_GROUP_KEY, before)


def run_metrics(spark: SparkSession, event_log: str) -> DataFrame:
    """(name, iteration, jobs, stages, tasks, task_ms, cpu_ms, rows_read, bytes_read, shuffle_rows, shuffle_bytes) of every
    run in an event log (a file, a folder, or a pattern); failed tasks count, as their time was spent.

    A stage that an earlier job has computed runs no tasks again, and one whose work the optimiser has pruned away shows
    little time and no rows, which a wall-clock time alone does not tell. A stage belongs to the first run that lists it."""
    events = spark.read.schema(EVENT_SCHEMA).json(event_log)
    group = F.col("Properties")[_GROUP_KEY]
    jobs = events.filter((F.col("Event") == "SparkListenerJobStart") & group.startswith(GROUP)).select(
        F.col("Job ID").alias("job"), F.substring(group, len(GROUP) + 1, 2 ** 31 - 1).alias("run"), F.explode("Stage IDs").alias("stage"))
    owner = jobs.groupBy("stage").agg(F.min(F.struct("job", "run")).alias("first")).select("stage", "first.run")
    m, at = F.col("Task Metrics"), lambda outer, inner: F.coalesce(F.col("Task Metrics")[outer][inner], F.lit(0))
    tasks = events.filter(F.col("Event") == "SparkListenerTaskEnd").select(
        F.col("Stage ID").alias("stage"), F.coalesce(m["Executor Run Time"], F.lit(0)).alias("ms"), F.coalesce(m["Executor CPU Time"], F.lit(0)).alias("ns"),
        at("Input Metrics", "Records Read").alias("rows"), at("Input Metrics", "Bytes Read").alias("bytes"),
        at("Shuffle Write Metrics", "Shuffle Records Written").alias("srows"), at("Shuffle Write Metrics", "Shuffle Bytes Written").alias("sbytes"))
    by_stage = tasks.groupBy("stage").agg(F.count(F.lit(1)).alias("tasks"), *(F.sum(c).alias(c) for c in ("ms", "ns", "rows", "bytes", "srows", "sbytes")))
    spent = owner.join(by_stage, "stage").groupBy("run").agg(
        F.count(F.lit(1)).alias("stages"), F.sum("tasks").alias("tasks"), F.sum("ms").alias("task_ms"), F.expr("sum(ns) div 1000000").alias("cpu_ms"),
        F.sum("rows").alias("rows_read"), F.sum("bytes").alias("bytes_read"), F.sum("srows").alias("shuffle_rows"), F.sum("sbytes").alias("shuffle_bytes"))
    counted = jobs.groupBy("run").agg(F.countDistinct("job").alias("jobs"))
    measures = ["stages", "tasks", "task_ms", "cpu_ms", "rows_read", "bytes_read", "shuffle_rows", "shuffle_bytes"]
    return counted.join(spent, "run", "left").select(
        F.expr("substring(run, instr(run, ':') + 1)").alias("name"), F.substring_index("run", ":", 1).cast("int").alias("iteration"), "jobs",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in measures))


def with_metrics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """``bench_runs`` with the columns of ``run_metrics``; zeros for a run that the log does not have."""
    added = [c for c in metrics.columns if c not in ("name", "iteration")]
    return runs.join(metrics, ["name", "iteration"], "left").fillna(0, added)
