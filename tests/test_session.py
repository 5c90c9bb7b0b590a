import os
import subprocess
import sys

import pytest

from parallax.session import checkpoint_dir


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value if key == "spark.checkpoint.dir" else default

    def set(self, key, value):
        self.value = value


class _Context:
    def __init__(self, master):
        self.master = master
        self.dirs = []

    def setCheckpointDir(self, d):
        self.dirs.append(d)

    def getCheckpointDir(self):
        return self.dirs[-1] if self.dirs else None


class _Session:
    def __init__(self, master, value=None):
        self.conf = _Conf(value)
        self.sparkContext = _Context(master)


def test_cluster_without_shared_checkpoint_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(_Session("yarn"))


def test_configured_folder_is_used_as_is():
    s = _Session("spark://cluster:7077", "hdfs:///shared/ckpt")
    assert checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert s.sparkContext.dirs == ["hdfs:///shared/ckpt"]


STOCK = """
from pyspark.sql import SparkSession
from parallax.session import checkpoint_dir, scratch_path
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert s.conf.get("spark.checkpoint.dir", None) is None
a, b = checkpoint_dir(s), checkpoint_dir(s)
assert a == b and "parallax-ckpt-" in a, (a, b)
assert s.range(5).checkpoint().count() == 5
s.range(3).write.parquet(scratch_path(s, "t"))
print("STOCK OK")
"""


def test_stock_local_session_gets_a_temp_folder(tmp_path):
    """A real session whose configuration folder is empty, so no default sets the folder."""
    (tmp_path / "conf").mkdir()
    (tmp_path / "tmp").mkdir()
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": root, "TMPDIR": str(tmp_path / "tmp")}
    run = subprocess.run([sys.executable, "-c", STOCK], env=env, capture_output=True, text=True, timeout=180)
    assert "STOCK OK" in run.stdout, run.stderr[-2000:]


def test_scratch_paths_are_deleted_together(spark):
    from parallax import session

    kept, session._made[:] = list(session._made), []
    try:
        paths = [session.scratch_path(spark, "gone") for _ in range(2)]
        spark.range(3).write.parquet(paths[0])
        assert session.delete_scratch(spark) == 2 and session._made == []
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(paths[0])
        assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    finally:
        session._made[:] = kept
