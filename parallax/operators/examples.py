"""Records -> (features, label) examples -> keyed feature rows.

All plain projections: they fuse into the scan's codegen stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOUBLE_ARRAY = T.ArrayType(T.DoubleType())

# Fixed value: the constant key the scoring jobs attach to every row.
DEFAULT_KEY = "carparkOccupancy"


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A 64-bit id from all (or the given) columns: stable across runs and
    partitionings, unlike ``monotonically_increasing_id``."""
    return F.xxhash64(*[F.col(c) for c in (columns or df.columns)])


def with_scan_id(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """A Parquet scan with ``row_id``, a hash of the file's path and the row's number in it: the same in every
    plan over the same files, unique up to 64-bit hash collisions."""
    return df.withColumn(row_id, F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")))


def _vector(df: DataFrame, cols: str | list[str]) -> Column:
    if isinstance(cols, str):
        dt = df.schema[cols].dataType
        if isinstance(dt, T.ArrayType):
            return F.col(cols).cast(DOUBLE_ARRAY)
        cols = [cols]
    return F.array(*[F.col(c).cast("double") for c in cols])


def to_examples(df: DataFrame, features: str | list[str], label: str | list[str] | None,
                row_id: str | None = "row_id", keep: list[str] | None = None,
                id_cols: list[str] | None = None) -> DataFrame:
    """``examples``: ``row_id bigint, features array<double>, label array<double>``.

    ``features`` / ``label`` are column lists, or one array column.  ``row_id``
    names a row, equal rows apart: the input's own ``row_id`` column if it has
    one (``with_scan_id`` makes one), ``xxhash64`` of ``id_cols`` when a natural
    key exists (then a wide input is not read whole just to hash it), else
    ``xxhash64`` of every input column and the row's place in the input.  The
    last is the same on every read of the same files; after a shuffle whose row
    order may change on a retry, give ``id_cols`` or make the id at the scan.
    ``row_id=None`` leaves it out.  ``keep`` carries source columns through.
    """
    out = []
    if row_id and row_id in df.columns:
        out.append(F.col(row_id))
    elif row_id and (id_cols or df.isStreaming):
        out.append(row_hash(df, id_cols).alias(row_id))  # a stream has no places: equal rows share an id there
    elif row_id:
        out.append(F.xxhash64(*[F.col(c) for c in df.columns], F.monotonically_increasing_id()).alias(row_id))
    out += [F.col(c) for c in (keep or [])]
    out.append(_vector(df, features).alias("features"))
    if label is not None:
        out.append(_vector(df, label).alias("label"))
    return df.select(*out)


def split_by_position(records: DataFrame, label_index: int, num_labels: int = 1,
                      row_id: str | None = "row_id") -> DataFrame:
    """Regression split by position: columns ``[label_index, label_index+num_labels)``
    are the label, every other data column a feature (``_bad`` is ignored)."""
    cols = [c for c in records.columns if c not in ("_bad", row_id)]
    if not 0 <= label_index or label_index + num_labels > len(cols) or num_labels < 1:
        raise ValueError(f"label columns {label_index}..{label_index + num_labels - 1} outside {len(cols)} columns")
    label = cols[label_index : label_index + num_labels]
    features = [c for c in cols if c not in label]
    if not features:
        raise ValueError("no feature columns left")
    held = [row_id] if row_id in records.columns else []
    return to_examples(records.select(*held, *cols), features, label, row_id=row_id)


def features_only(examples: DataFrame) -> DataFrame:
    """Drop the label (and anything else) before scoring."""
    return examples.select(*[c for c in examples.columns if c != "label"])


def key_examples(examples: DataFrame, key: str = DEFAULT_KEY, row_id: str = "row_id",
                 keep: list[str] | None = None) -> DataFrame:
    """``keyed_examples``: ``key string, row_id bigint, features array<double>``.

    The key is constant, as in the scoring jobs; ``row_id`` keeps each
    prediction joinable to its input.
    """
    cols = [F.lit(key).alias("key")]
    if row_id in examples.columns:
        cols.append(F.col(row_id))
    cols += [F.col(c) for c in (keep or [])]
    cols.append(F.col("features"))
    return examples.select(*cols)
