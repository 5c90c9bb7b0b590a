"""Keyed batched forward pass: one prediction per input row, key carried through.

Two physical forms, one behaviour:

* ``score_expr``: the network as generated ``Column`` expressions, one
  projection per layer, so hidden units are computed once and the whole pass
  stays inside the scan's whole-stage-codegen stage (no Python, no shuffle).
  Plan size grows with the weight count, so it is for small networks.
* ``score_batched``: an Arrow UDF running the numpy forward pass over
  ``batch_size``-row batches, for wider networks.  The model travels in
  the task closure, or as a broadcast variable (once per executor) above
  ``model.CLOSURE_MAX_PARAMS`` parameters.

On both, a row with a null feature (or a null feature array) gets an array of
``n_outputs`` nulls, NaN and infinities flow through the arithmetic as doubles,
and a feature array of another width than the model's input raises an error.
Values agree within rounding: layers up to ``model.FOLD_MAX_WEIGHTS`` weights
are summed in the same order on both (identity and ReLU layers give the same
bits), wider ones by a matrix product (relative difference about 1e-15 per sum).

Neither shuffles: scoring is a narrow map over the input partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.functions.network import activation_column, dense_sum_columns
from parallax.model import Model, ModelRef, forward

# Networks with at most this many weights are scored as expressions.  Measured
# on 600k rows (8 splits), seconds per pass, expressions vs Arrow: 2-8-1 (33
# weights) 0.12 vs 0.22, 2-24-1 (97) 0.12 vs 0.26, 2-6-6-6-1 (109) 0.09 vs
# 0.20, but 2-28-1 (113) 1.64 vs 0.25 and 2-10-10-1 (151) 1.26 vs 0.22: past
# some size the fused generated method is too large for the JIT and runs
# slowly (the null-propagating ReLU is a CASE, which moves that point lower
# than ``greatest`` did).
EXPR_MAX_WEIGHTS = 100
# ... and no layer wider than this (2-24-1 was fast, 2-28-1 was not).
EXPR_MAX_UNITS = 24


def prefers_expressions(model: Model) -> bool:
    """Whether ``score`` picks the expression path for ``model``."""
    return model.n_params <= EXPR_MAX_WEIGHTS and max(l.n_out for l in model.layers) <= EXPR_MAX_UNITS


def _passthrough(df: DataFrame, features: str, keep: list[str] | None) -> list[str]:
    if keep is not None:
        return list(keep)
    return [c for c in df.columns if c != features]


def checked_features(features: str, n_inputs: int) -> Column:
    """The feature array as doubles; an array of another width than ``n_inputs`` raises an error."""
    x = F.col(features).cast("array<double>")
    wrong = F.concat(F.lit(f"the model takes {n_inputs} features, a row has "), F.size(features).cast("string"))
    return F.when(F.col(features).isNull() | (F.size(features) == n_inputs), x).otherwise(F.raise_error(wrong).cast("array<double>"))


def score_expr(df: DataFrame, model: Model, features: str = "features", output: str = "prediction",
               keep: list[str] | None = None) -> DataFrame:
    """Predictions as codegen'd expressions; other columns (or ``keep``) pass through."""
    keep = _passthrough(df, features, keep)
    names = [f"__in_{i}" for i in range(model.n_inputs)]
    cur = df.select(*keep, checked_features(features, model.n_inputs).alias("__x"))
    cur = cur.select(*keep, *[F.col("__x")[i].alias(n) for i, n in enumerate(names)])
    for li, layer in enumerate(model.layers):
        # sums first, activations in the next projection, so an activation
        # that reads its input twice (ReLU as a CASE) does not repeat the sum
        sums = dense_sum_columns([F.col(n) for n in names], layer)
        znames = [f"__z{li}_{j}" for j in range(layer.n_out)]
        cur = cur.select(*keep, *[c.alias(n) for c, n in zip(sums, znames)])
        names = [f"__l{li}_{j}" for j in range(layer.n_out)]
        cur = cur.select(*keep, *[activation_column(F.col(z), layer.activation).alias(n)
                                  for z, n in zip(znames, names)])
    return cur.select(*keep, F.array(*[F.col(n) for n in names]).alias(output))


def _batched_udf(ref: ModelRef, batch_size: int, n_in: int, n_out: int):
    """An iterator Arrow UDF over arrays of ``n_in`` doubles without nulls: each batch's flat values become one
    numpy matrix, the forward pass runs over ``batch_size``-row slices, and one flat buffer goes back."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = ref.get()  # once per task (a broadcast is fetched once per executor)
        for a in batches:
            x = a.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_in)
            parts = [forward(model, x[i : i + batch_size]) for i in range(0, len(x), batch_size)]
            out = np.concatenate(parts) if parts else np.empty((0, n_out))
            offsets = np.arange(0, (len(x) + 1) * n_out, n_out, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(out).reshape(-1)))

    return predict


def score_batched(df: DataFrame, model: Model, batch_size: int = 8192, features: str = "features",
                  output: str = "prediction", keep: list[str] | None = None) -> DataFrame:
    """Predictions from a forward pass over ``batch_size``-row batches
    (an Arrow UDF; the batches are slices of each Arrow batch, so set
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` to a multiple of
    ``batch_size`` for exactly equal batches).

    Batch size changes speed, and results by no more than rounding (layers above
    ``model.FOLD_MAX_WEIGHTS`` weights: a matrix product may sum a short batch in another order).
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    keep = _passthrough(df, features, keep)
    n_in, n_out = model.n_inputs, model.n_outputs
    udf = _batched_udf(ModelRef(model, df.sparkSession.sparkContext), batch_size, n_in, n_out)
    # Null is decided here, on the JVM side: the UDF sees whole arrays of doubles only (zeros for a row with a
    # null in it), so NaN stays NaN and no object list is built.
    src = df.select(*keep, checked_features(features, n_in).alias("__x"))
    whole = F.col("__x").isNotNull()
    for i in range(n_in if n_in <= EXPR_MAX_UNITS else 0):
        whole = whole & F.col("__x")[i].isNotNull()
    if n_in > EXPR_MAX_UNITS:
        whole = whole & ~F.exists("__x", lambda v: v.isNull())
    src = src.select(*keep, "__x", F.coalesce(whole, F.lit(False)).alias("__whole"))
    zeros = F.array(*[F.lit(0.0)] * n_in) if n_in <= EXPR_MAX_UNITS else F.array_repeat(F.lit(0.0), n_in)
    pred = udf(F.when(F.col("__whole"), F.col("__x")).otherwise(zeros))
    nulls = F.array_repeat(F.lit(None).cast("double"), n_out)
    return src.select(*keep, F.when(F.col("__whole"), pred).otherwise(nulls).alias(output))


def score(df: DataFrame, model: Model, batch_size: int = 8192, features: str = "features",
          output: str = "prediction", keep: list[str] | None = None, method: str = "auto") -> DataFrame:
    """Score with expressions for small networks, Arrow batches otherwise."""
    if method == "auto":
        method = "expr" if prefers_expressions(model) else "batched"
    if method == "expr":
        return score_expr(df, model, features, output, keep)
    if method == "batched":
        return score_batched(df, model, batch_size, features, output, keep)
    raise ValueError(f"unknown method {method!r}")
