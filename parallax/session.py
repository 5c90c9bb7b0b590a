"""Session helpers: shared scratch/checkpoint locations and a local test session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


# Scratch paths made by this process and not yet deleted by ``delete_scratch``.
_made: list[str] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a ``local[...]`` session without one (tests, local runs) gets a
    fresh local folder, kept on the SparkContext (the setting itself is static
    and never written); elsewhere a missing setting is an error, since a
    machine-local folder is not shared by the executors.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        held = sc.getCheckpointDir()
        if held:
            return held
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster (HDFS, object store); "
                               "a machine-local folder is not reachable from every executor")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="parallax-ckpt-"))
        return sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/parallax-{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def delete_scratch(spark: SparkSession) -> int:
    """Deletes every scratch path that this process has made; returns their number.

    Call it when no DataFrame that reads them is used any more: a query's result is lazy."""
    n = len(_made)
    while _made:
        delete_path(spark, _made.pop())
    return n


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "parallax",
                  driver_memory: str | None = None) -> SparkSession:
    """A ``local[N]`` session for tests and the bench (UI off, AQE on)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("PARALLAX_LOG_LEVEL", "ERROR"))
    return spark


def free_arrow() -> None:
    """In a task: gives the memory that Arrow keeps for later batches back to the system; a worker outlives its tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursively delete ``path`` on whatever file system it names (HDFS,
    object store, local), through Hadoop's FileSystem API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, on whatever file system it names."""
    p, fs = _file_system(spark, path)
    return bool(fs.exists(p))


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files directly in ``path``; none if it is not there."""
    p, fs = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()] if fs.exists(p) else []


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, whole or not at all: written beside its name, then renamed to it."""
    p, fs = _file_system(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.part")
    out = fs.create(part, True)
    out.write(data)
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"cannot write {path}")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's bytes."""
    p, fs = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
    finally:
        stream.close()
