"""Prediction sinks: files (text / CSV / Parquet) and a bounded console print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def format_prediction(key: str = "key", prediction: str = "prediction") -> Column:
    """``key: [v0, v1, ...]`` as one string column; a null value, key or prediction is written as ``null``."""
    body = F.array_join(F.transform(F.col(prediction), lambda v: v.cast("string")), ", ", "null")
    return F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "),
                    F.coalesce(F.concat(F.lit("["), body, F.lit("]")), F.lit("null")))


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists",
                      key: str = "key", prediction: str = "prediction", width: int | None = None) -> None:
    """Write scored rows.  ``mode`` defaults to failing on an existing path.

    * ``parquet`` keeps every column, the prediction as an array;
    * ``csv`` spreads the prediction over ``p0 .. pN`` columns (``width`` =
      the model's output count; found with one extra pass when not given);
    * ``text`` writes one ``key: [v0, ...]`` line per row.
    """
    writer_df = df
    if fmt == "text":
        writer_df = df.select(format_prediction(key, prediction).alias("value"))
    elif fmt == "csv":
        if width is None:
            width = df.select(F.max(F.size(prediction))).first()[0] or 0
        others = [c for c in df.columns if c != prediction]
        writer_df = df.select(*others, *[F.col(prediction)[i].alias(f"p{i}") for i in range(width)])
    elif fmt != "parquet":
        raise ValueError(f"unknown format {fmt!r}")
    writer_df.write.mode(mode).format(fmt).save(path)


def show_predictions(df: DataFrame, n: int = 20, key: str = "key", prediction: str = "prediction") -> list[str]:
    """Print and return at most ``n`` formatted lines (never collects everything)."""
    lines = [r[0] for r in df.select(format_prediction(key, prediction)).limit(n).collect()]
    for line in lines:
        print(line)
    return lines
