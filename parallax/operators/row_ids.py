"""Dense row ids: a row's number in its file plus the rows of the files before; nothing is hashed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parallax.session import scratch_path


def file_offsets(scan: DataFrame) -> DataFrame:
    """(file, rows, first): the files of a Parquet scan, their rows, and the rows of all files before, by path.

    Row numbers alone are read, no data column. One row per file meets in one task, as in the driver's own list of the
    scan's files."""
    counts = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i")).groupBy("file").agg(
        (F.max("i") + 1).alias("rows"))
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0)).cast("long"))


def with_dense_id(scan: DataFrame, row_id: str = "row_id") -> DataFrame:
    """A Parquet scan (as read, before any filter) with ``row_id`` 0, 1, ... without gaps, in the order of the files' paths
    and of the rows in each.

    The same files give the same ids on every read, however they are split over tasks. The offsets are written
    once to the shared folder and joined back by path; where they are too many to be sent to every task, adaptive
    execution splits a large file's side of the join. An empty scan gives no rows; other formats are written as
    Parquet first."""
    path = scratch_path(scan.sparkSession, "file-offsets")
    file_offsets(scan).write.parquet(path)
    offsets = scan.sparkSession.read.parquet(path).select(F.col("file").alias("_file"), F.col("first").alias("_first"))
    rows = scan.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_i"))
    keep = [c for c in scan.columns if c != row_id]
    return rows.join(offsets, F.col("_path") == F.col("_file")).select((F.col("_first") + F.col("_i")).alias(row_id), *keep)
