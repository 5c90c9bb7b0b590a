"""Text-line scan (local paths, ``hdfs://``, ``s3a://``: whatever Spark reads)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``DataFrame[value string]``, one row per line; lazy like any scan.

    Files are split by ``spark.sql.files.maxPartitionBytes``, so a large
    file spreads over many tasks.
    """
    return spark.read.text(path)
