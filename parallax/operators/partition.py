"""Partitioning a dataset: in memory (shuffle) or on disk (directory layout)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cuts of the sketch to a part: a value is split only where it holds about this share of a part, and sizes differ by as much.
CUTS_PER_PART = 16
# The sketch's rank error, as a share of a cut's rows, is at most one over this.
CUT_ACCURACY = 4


def partition_dataset(df: DataFrame, num_partitions: int, by: list[str] | None = None,
                      salt: int | None = None) -> DataFrame:
    """``num_partitions`` partitions: round-robin when ``by`` is None, else
    hash-partitioned on ``by``.

    Hash partitioning puts every row of a key in one partition; when a key
    may be hot, ``salt = k`` spreads each key over up to ``k`` partitions
    (by a hash of the whole row, so it is deterministic under retries).
    """
    if num_partitions < 1:
        raise ValueError("num_partitions must be positive")
    if not by:
        return df.repartition(num_partitions)
    keys = [F.col(c) for c in by]
    if salt and salt > 1:
        keys.append(F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt)))
    return df.repartition(num_partitions, *keys)


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet",
                      mode: str = "errorifexists") -> None:
    """Write one directory per value of ``by`` (readers prune on it).

    A ``rebalance`` hint on ``by`` brings the rows of a value together, so a
    value gets few files, while adaptive execution splits a value that holds
    much of the data into tasks of the advisory partition size, and merges
    small ones.
    """
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode(mode).partitionBy(*by).format(fmt).save(path)


def _as_number(df: DataFrame, by: list[str]) -> Column:
    """What the sketch sees of a row: one numeric or temporal column's value as a double (nulls first, NaN last), else a
    32-bit hash of the columns. Both are exact as doubles or at least keep the order, and equal values stay equal."""
    kind = df.schema[by[0]].dataType if len(by) == 1 else None
    if isinstance(kind, (T.NumericType, T.TimestampType, T.DateType)):
        c = F.unix_date(by[0]) if isinstance(kind, T.DateType) else F.col(by[0])
        v = c.cast("double")
        v = F.when(F.isnan(v), F.lit(float(np.finfo(np.float64).max))).otherwise(v)
        return F.coalesce(v, F.lit(float(np.finfo(np.float64).min)))
    return F.hash(*[F.col(c) for c in by]).cast("double")


def balanced_partitions(df: DataFrame, num_partitions: int, by: list[str], part_col: str | None = None) -> DataFrame:
    """``num_partitions`` partitions of nearly equal size, ranges of ``by`` (of one numeric or temporal column, else of a hash
    of the columns), hot values split.

    One pass builds a mergeable quantile sketch (``percentile_approx``: partial sketches in the tasks, merged), which gives
    ``CUTS_PER_PART`` cuts to a part. A value on which several cuts fall holds as many shares of the rows; its rows
    are dealt over them by their place in the input, equal rows too. Every other value lies in one partition.
    What reaches the driver and the tasks is the cuts. ``part_col`` keeps the partition's number as a column."""
    if num_partitions < 1:
        raise ValueError("num_partitions must be positive")
    if not by:
        raise ValueError("name the columns to partition by")
    fine = num_partitions * CUTS_PER_PART
    shares = [k / fine for k in range(1, fine)]
    number = _as_number(df, by)
    got = df.select(number.alias("v")).agg(F.percentile_approx("v", shares, fine * CUT_ACCURACY).alias("cuts")).first()["cuts"] if shares else []
    cuts = np.array(got or [], np.float64)

    @F.pandas_udf("int")
    def part(v: pd.Series, place: pd.Series) -> pd.Series:
        x = v.to_numpy(np.float64)
        low, high = np.searchsorted(cuts, x, side="left"), np.searchsorted(cuts, x, side="right")
        # places are dealt evenly over the shares by the fractions of their multiples of the golden section
        at = (place.to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(11)).astype(np.float64) / 2.0 ** 53
        several = high - low > 1
        bucket = np.where(several, low + np.floor(at * (high - low) + 0.5).astype(np.int64), low)
        return pd.Series((bucket // CUTS_PER_PART).clip(0, num_partitions - 1).astype(np.int32))

    name = part_col or "_part"
    out = df.withColumn(name, part(number, F.monotonically_increasing_id())).repartitionById(num_partitions, F.col(name))
    return out if part_col else out.drop(name)
