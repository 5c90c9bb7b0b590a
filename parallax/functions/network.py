"""A network's forward pass as plain Spark ``Column`` expressions.

Every weight becomes a double literal, so a small network runs entirely inside
whole-stage codegen with no Python worker.  Each unit is built as the left fold
``((x0*w0 + x1*w1) + ...) + b`` so that an SQL engine evaluating
``x0*w0 + x1*w1 + ... + b`` produces bit-identical doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parallax.model import Dense


def activation_column(z: Column, name: str) -> Column:
    if name == "identity":
        return z
    if name == "relu":
        # not ``greatest(z, 0)``: greatest skips nulls, so a missing input
        # would turn into 0 instead of staying null
        return F.when(z < F.lit(0.0), F.lit(0.0)).otherwise(z)
    if name == "tanh":
        return F.tanh(z)
    if name == "sigmoid":
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    raise ValueError(f"unknown activation {name!r}")


def dense_sum_columns(inputs: list[Column], layer: Dense) -> list[Column]:
    """The pre-activation sum of every unit of ``layer``."""
    if len(inputs) != layer.n_in:
        raise ValueError(f"layer expects {layer.n_in} inputs, got {len(inputs)}")
    outs = []
    for j in range(layer.n_out):
        z = inputs[0] * F.lit(float(layer.weights[0, j]))
        for i in range(1, layer.n_in):
            z = z + inputs[i] * F.lit(float(layer.weights[i, j]))
        outs.append(z + F.lit(float(layer.bias[j])))
    return outs
