"""What runs cost, by the event log of another application."""

import os
import subprocess
import sys

from data_dirs import SF001
from parallax.plans.accounting import run_group, run_metrics, with_metrics


def test_runs_are_told_apart_in_the_event_log(spark, tmp_dir):
    helper = os.path.join(os.path.dirname(__file__), "helpers", "logged_run.py")
    done = subprocess.run([sys.executable, helper, tmp_dir, SF001], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    got = {(r["name"], r["iteration"]): r for r in run_metrics(spark, tmp_dir + "/*").collect()}
    assert set(got) == {("score: all", 0), ("score: all", 1), ("fit", 0)}
    for k in (0, 1):
        r = got["score: all", k]
        assert r["jobs"] == 1 and r["rows_read"] == 6000 and r["bytes_read"] > 0 and r["shuffle_rows"] == 0 and r["task_ms"] > 0
    fit = got["fit", 0]
    assert fit["jobs"] == 3 and fit["tasks"] >= 6 and fit["shuffle_rows"] == 0  # three rounds, no shuffle
    runs = spark.createDataFrame([("score: all", 0, 6000, 5), ("not logged", 0, 1, 1)], "name string, iteration int, n_records bigint, ns bigint")
    joined = {r["name"]: r for r in with_metrics(runs, run_metrics(spark, tmp_dir + "/*")).collect()}
    assert joined["score: all"]["rows_read"] == 6000 and joined["not logged"]["tasks"] == 0


def test_the_job_group_before_is_set_again(spark):
    sc = spark.sparkContext
    sc.setLocalProperty("spark.jobGroup.id", "mine")
    try:
        with run_group(spark, "x", 3):
            assert sc.getLocalProperty("spark.jobGroup.id") == "parallax-run:3:x"
        assert sc.getLocalProperty("spark.jobGroup.id") == "mine"
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
