"""Dense row ids and partitions balanced by a sketch."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parallax.operators.examples import to_examples
from parallax.operators.partition import balanced_partitions
from parallax.operators.row_ids import with_dense_id


def _write(spark, path, sizes):
    """Files of so many rows, numbered through in the order of their names."""
    at = 0
    for k, n in enumerate(sizes):
        (spark.range(at, at + n).withColumn("x", F.col("id") % 3).coalesce(1).write.mode("append").parquet(f"{path}/part={k:03d}"))
        at += n
    return spark.read.parquet(path)


def test_dense_ids_are_gapless_and_in_file_order(spark, tmp_dir):
    df = _write(spark, f"{tmp_dir}/a", [5, 0, 1, 700, 13, 0, 200])
    got = with_dense_id(df).select("row_id", "id").collect()
    assert sorted(r["row_id"] for r in got) == list(range(919))
    assert all(r["row_id"] == r["id"] for r in got)


def test_dense_ids_do_not_depend_on_how_files_are_split(spark, tmp_dir):
    spark.range(50_000).withColumn("t", F.sha2(F.col("id").cast("string"), 256)).repartition(3).write.option("parquet.block.size", 100_000).parquet(f"{tmp_dir}/b")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    seen = []
    try:
        for size in ("128m", "64k"):
            spark.conf.set(key, size)
            df = with_dense_id(spark.read.parquet(f"{tmp_dir}/b"))
            seen.append({r["row_id"]: r["id"] for r in df.select("row_id", "id").collect()})
    finally:
        spark.conf.set(key, before)
    assert seen[0] == seen[1] and sorted(seen[0]) == list(range(50_000))


def test_dense_ids_name_examples(spark, tmp_dir):
    df = _write(spark, f"{tmp_dir}/c", [10, 20]).withColumnRenamed("id", "row_id")
    out = with_dense_id(df)
    assert out.columns == ["row_id", "x", "part"]  # a column of that name gives way
    ex = to_examples(out, ["x"], ["part"])
    assert sorted(r["row_id"] for r in ex.collect()) == list(range(30))


def test_dense_ids_of_an_empty_table(spark, tmp_dir):
    spark.range(0).write.parquet(f"{tmp_dir}/d")
    assert with_dense_id(spark.read.parquet(f"{tmp_dir}/d")).collect() == []


def _sizes(df, n):
    rows = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    return sorted([r["count"] for r in rows] + [0] * (n - len(rows)))


@pytest.mark.parametrize("key", [
    "CASE WHEN id % 3 = 0 THEN 7 ELSE id END",                                        # a third on one value
    "CASE WHEN id % 3 = 0 THEN NULL ELSE id END",                                     # or null
    "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END",                    # text, by hash
    "CASE WHEN id % 3 = 0 THEN CAST('NaN' AS DOUBLE) ELSE id / 7 END",
    "CASE WHEN id % 3 = 0 THEN DATE'2020-01-01' ELSE date_add(DATE'2020-01-01', CAST(id % 9000 - 100 AS INT)) END",
    "id * id",                                                                        # skewed ranges
])
def test_parts_are_within_half_of_the_median(spark, key):
    n = 20
    df = spark.range(0, 60_000, 1, 6).selectExpr(f"{key} AS k", "1 AS same")
    out = balanced_partitions(df, n, ["k"])
    assert out.columns == ["k", "same"]
    sizes = _sizes(out, n)
    assert sum(sizes) == 60_000 and sizes[-1] <= 1.5 * sizes[n // 2] and sizes[0] > 0


def test_two_columns_and_few_values(spark):
    df = spark.range(0, 10_000, 1, 3).selectExpr("id % 2 AS a", "'x' AS b")
    out = balanced_partitions(df, 4, ["a", "b"])
    assert _sizes(out, 4)[-1] <= 1.5 * 2500
    assert _sizes(balanced_partitions(df, 1, ["a"]), 1) == [10_000]
    assert balanced_partitions(df.filter("a > 5"), 4, ["a"]).count() == 0
    with pytest.raises(ValueError):
        balanced_partitions(df, 0, ["a"])


def test_only_hot_values_are_split_and_parts_are_ranges(spark):
    df = spark.range(0, 30_000, 1, 5).selectExpr("CASE WHEN id % 3 = 0 THEN 5000 ELSE id % 10000 END AS k")
    parts = balanced_partitions(df, 8, ["k"], part_col="p").groupBy("k").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).orderBy("k").collect()
    assert [r["k"] for r in parts if r["lo"] != r["hi"]] == [5000]
    assert all(a["hi"] <= b["lo"] for a, b in zip(parts, parts[1:], strict=False))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), max_size=60), st.integers(1, 7))
def test_no_row_is_lost(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "k long").repartition(3)
    got = sorted((r["k"] for r in balanced_partitions(df, n, ["k"]).collect()), key=lambda v: (v is not None, v))
    assert got == sorted(values, key=lambda v: (v is not None, v))
