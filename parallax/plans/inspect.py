"""Physical-plan checks used by tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame

PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonMapInArrow")


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def has_python_node(df: DataFrame) -> bool:
    plan = physical_plan(df)
    return any(n in plan for n in PYTHON_NODES)


def shuffle_count(df: DataFrame) -> int:
    plan = physical_plan(df)
    return plan.count("Exchange ") + plan.count("Exchange\n")
