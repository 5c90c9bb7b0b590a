"""The model as a table: save to / load from any path Spark can write/read.

Schema ``model_weights``: ``layer int, row int, col int, value double,
activation string``; ``row = -1`` holds the bias, ``activation`` repeats on
every row of its layer.  Loading collects the table to the driver, so its row
count is checked first: the driver must hold the model to ship it to tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parallax.model import Dense, Model

MODEL_SCHEMA = "layer int, row int, col int, value double, activation string"
# Above this many weights a model no longer belongs in the driver/closure.
MAX_MODEL_WEIGHTS = 50_000_000


def model_table(model: Model) -> pa.Table:
    """The weights table, column by column from numpy index arrays."""
    parts = []
    for li, l in enumerate(model.layers):
        row = np.concatenate([np.repeat(np.arange(l.n_in), l.n_out), np.full(l.n_out, -1)])
        col = np.concatenate([np.tile(np.arange(l.n_out), l.n_in), np.arange(l.n_out)])
        parts.append(pa.table({
            "layer": pa.array(np.full(len(row), li, np.int32)),
            "row": pa.array(row.astype(np.int32)),
            "col": pa.array(col.astype(np.int32)),
            "value": pa.array(np.concatenate([l.weights.ravel(), l.bias])),
            "activation": pa.array([l.activation]).take(pa.array(np.zeros(len(row), np.int32))),
        }))
    return pa.concat_tables(parts)


def model_to_df(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame(model_table(model), MODEL_SCHEMA)


def save_model(spark: SparkSession, model: Model, path: str, mode: str = "errorifexists") -> None:
    """Write the weights table as Parquet (one small file)."""
    model_to_df(spark, model).coalesce(1).write.mode(mode).parquet(path)


def model_from_df(weights: DataFrame, max_weights: int = MAX_MODEL_WEIGHTS) -> Model:
    """Assemble a ``Model`` from a ``model_weights`` DataFrame (size-checked collect)."""
    n = weights.count()
    if n > max_weights:
        raise ValueError(f"model has {n} weights; more than the {max_weights} a driver-held model allows")
    if n == 0:
        raise ValueError("empty weights table")
    pdf = weights.select("layer", "row", "col", "value", "activation").toPandas()
    layers = []
    for li, g in pdf.groupby("layer", sort=True):
        acts = g["activation"].unique()
        if len(acts) != 1:
            raise ValueError(f"layer {li} has more than one activation: {list(acts)}")
        w_rows = g[g["row"] >= 0]
        b_rows = g[g["row"] == -1]
        n_in = int(w_rows["row"].max()) + 1
        n_out = int(g["col"].max()) + 1
        w = np.full((n_in, n_out), np.nan)
        w[w_rows["row"].to_numpy(), w_rows["col"].to_numpy()] = w_rows["value"].to_numpy()
        b = np.full(n_out, np.nan)
        b[b_rows["col"].to_numpy()] = b_rows["value"].to_numpy()
        if np.isnan(w).any() or np.isnan(b).any():
            raise ValueError(f"layer {li} is missing weights")
        layers.append(Dense(w, b, str(acts[0])))
    if [int(k) for k in sorted(pdf["layer"].unique())] != list(range(len(layers))):
        raise ValueError("layer numbers must run 0, 1, 2, ...")
    return Model(tuple(layers))


def load_model(spark: SparkSession, path: str, max_weights: int = MAX_MODEL_WEIGHTS) -> Model:
    """Read a weights table written by ``save_model``; more than ``max_weights`` weights raise an error."""
    return model_from_df(spark.read.schema(MODEL_SCHEMA).parquet(path), max_weights)
