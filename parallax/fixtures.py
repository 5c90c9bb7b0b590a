"""Derived inputs used by the registered queries, tests and the bench.

The driver's tables have no learnable numeric relation between natural
columns, so the regression target is derived:
``x1 = l_extendedprice / 1e5``, ``x2 = l_discount``, ``y = x1 * (1 - x2)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax.model import Model

PRICE_SCALE = 1e5


def net_price_x1() -> Column:
    return F.col("l_extendedprice") / F.lit(PRICE_SCALE)


def net_price_x2() -> Column:
    return F.col("l_discount")


def net_price_records(lineitem: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``(keep..., x1, x2, y)`` from lineitem: two features and a learnable label."""
    x1, x2 = net_price_x1(), net_price_x2()
    return lineitem.select(*(keep or []), x1.alias("x1"), x2.alias("x2"), (x1 * (F.lit(1.0) - x2)).alias("y"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# The fixture networks' weights (rows = inputs, cols = units).
LINEAR_2_1 = [
    ([[0.5], [-0.25]], [0.1], "identity"),
]
RELU_2_3_1 = [
    ([[0.5, 0.125, -0.6], [-0.25, 0.75, 0.3]], [0.1, -0.2, 0.05], "relu"),
    ([[0.3], [-0.4], [0.7]], [0.01], "identity"),
]


def linear_2_1() -> Model:
    return Model.from_lists(LINEAR_2_1)


def relu_2_3_1() -> Model:
    return Model.from_lists(RELU_2_3_1)


def relu_2_8_1(seed: int = 7) -> Model:
    return Model.random([2, 8, 1], ["relu", "identity"], seed=seed)
