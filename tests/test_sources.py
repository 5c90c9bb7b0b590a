import os

import pytest
from pyspark.sql import functions as F

from parallax.fixtures import relu_2_3_1, relu_2_8_1
from parallax.sources.csv import bad_records, good_records, parse_lines, read_records, split_records
from parallax.sources.model_store import load_model, model_to_df, model_from_df, save_model
from parallax.sources.sinks import show_predictions, write_predictions
from parallax.sources.text import read_lines


def _write(path, name, text):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, name), "w") as f:
        f.write(text)


def test_read_lines_round_trip(spark, tmp_dir):
    _write(tmp_dir, "a.txt", "1,2,3\n4,5,6\n")
    assert sorted(r.value for r in read_lines(spark, tmp_dir).collect()) == ["1,2,3", "4,5,6"]


def test_bad_records_are_split_out(spark, tmp_dir):
    _write(tmp_dir, "a.csv", "1,2,3\n4,5\nx,1,2\n7,8,9,10\n\nc0,c1,c2\n\"1.5\",2e3,-4\n1,,3\n")
    checked = read_records(spark, tmp_dir, 3)
    good, bad = split_records(checked)
    assert sorted(tuple(r) for r in good.collect()) == [(1.0, 2.0, 3.0), (1.5, 2000.0, -4.0)]
    assert sorted(r._bad for r in bad.collect()) == ["1,,3", "4,5", "7,8,9,10", "c0,c1,c2", "x,1,2"]
    # pruning a later projection must not let a bad row through
    assert good.select("c0").count() == 2
    assert sorted(r.c0 for r in good.select("c0").collect()) == [1.0, 1.5]
    # bad rows carry no partial values
    assert checked.filter(F.col("_bad").isNotNull() & F.col("c0").isNotNull()).count() == 0


def test_header_dropped_per_file_even_when_split(spark, tmp_dir):
    for i in range(3):
        _write(tmp_dir, f"f{i}.csv", "a,b,c\n" + "".join(f"{i},{j},{j * 2}\n" for j in range(50)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        checked = read_records(spark, tmp_dir, ["a", "b", "c"], header=True)
        assert checked.rdd.getNumPartitions() > 3
        assert bad_records(checked).count() == 0
        assert good_records(checked).count() == 150
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # without header handling the header lines are bad records
    assert bad_records(read_records(spark, tmp_dir, 3)).count() == 3


def test_parse_lines_other_separator(spark):
    lines = spark.createDataFrame([("1;2",), ("3;x",)], "value string")
    got = parse_lines(lines, ["u", "v"], sep=";").collect()
    assert sorted((r.u, r.v, r._bad) for r in got if r._bad is None) == [(1.0, 2.0, None)]


def test_model_round_trip(spark, tmp_dir):
    m = relu_2_8_1(seed=3)
    path = os.path.join(tmp_dir, "model")
    save_model(spark, m, path)
    back = load_model(spark, path)
    assert [l.activation for l in back.layers] == ["relu", "identity"]
    assert (back.params() == m.params()).all()
    with pytest.raises(Exception):
        save_model(spark, m, path)  # errorifexists by default
    save_model(spark, relu_2_3_1(), path, mode="overwrite")
    assert load_model(spark, path).n_params == relu_2_3_1().n_params


def test_model_table_rejects_gaps(spark):
    df = model_to_df(spark, relu_2_3_1()).filter("not (layer = 0 and row = 1 and col = 2)")
    with pytest.raises(ValueError):
        model_from_df(df)
    with pytest.raises(ValueError):
        model_from_df(model_to_df(spark, relu_2_3_1()), max_weights=3)


def _preds(spark):
    return spark.createDataFrame([("k", 1, [0.5]), ("k", 2, [-1.25])], "key string, row_id bigint, prediction array<double>")


def test_sinks(spark, tmp_dir, capsys):
    df = _preds(spark)
    write_predictions(df, os.path.join(tmp_dir, "t"), fmt="text")
    assert sorted(r.value for r in spark.read.text(os.path.join(tmp_dir, "t")).collect()) == ["k: [-1.25]", "k: [0.5]"]
    write_predictions(df, os.path.join(tmp_dir, "c"), fmt="csv")
    back = spark.read.schema("key string, row_id bigint, p0 double").csv(os.path.join(tmp_dir, "c"))
    assert sorted(r.p0 for r in back.collect()) == [-1.25, 0.5]
    write_predictions(df, os.path.join(tmp_dir, "p"))
    assert spark.read.parquet(os.path.join(tmp_dir, "p")).count() == 2
    with pytest.raises(Exception):
        write_predictions(df, os.path.join(tmp_dir, "p"))
    lines = show_predictions(df, n=1)
    assert len(lines) == 1 and capsys.readouterr().out.strip() == lines[0]


def test_each_line_is_parsed_once(spark, tmp_dir):
    _write(tmp_dir, "a.csv", "1,2,3\n4,5\n")
    plan = good_records(read_records(spark, tmp_dir, 3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_csv(") == 1


def test_partitioned_write_gives_few_files_and_splits_a_hot_value(spark, tmp_dir):
    from parallax.operators.partition import partition_dataset, write_partitioned

    df = spark.range(20000).selectExpr("id", "xxhash64(id) AS v", "CASE WHEN id % 3 = 0 THEN 'rare' ELSE 'hot' END AS flag").repartition(6)
    files = lambda name, flag: [f for d, _, fs in os.walk(os.path.join(tmp_dir, name, f"flag={flag}")) for f in fs if f.endswith(".parquet")]
    write_partitioned(df, os.path.join(tmp_dir, "w"), ["flag"])
    back = spark.read.parquet(os.path.join(tmp_dir, "w"))
    assert back.count() == 20000 and back.filter("flag = 'rare'").count() == 6667
    assert len(files("w", "hot")) == len(files("w", "rare")) == 1  # not one from each input split
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64k")
        write_partitioned(df, os.path.join(tmp_dir, "s"), ["flag"])
    finally:
        spark.conf.set(key, before)
    assert len(files("s", "hot")) > 1  # a value above the advisory size is written by several tasks
    assert partition_dataset(df, 6, ["flag"]).rdd.getNumPartitions() == 6


def test_salted_partitioning_spreads_a_hot_key(spark):
    from pyspark.sql import functions as F

    from parallax.operators.partition import partition_dataset

    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 0 ELSE id % 7 END AS k")
    plain = partition_dataset(df, 8, ["k"]).withColumn("p", F.spark_partition_id())
    salted = partition_dataset(df, 8, ["k"], salt=4).withColumn("p", F.spark_partition_id())
    assert plain.filter("k = 0").select("p").distinct().count() == 1
    assert salted.filter("k = 0").select("p").distinct().count() > 1
    assert salted.count() == 3000


def test_io_through_filesystem_uris(spark, tmp_dir):
    """Paths go through Hadoop's FileSystem, as hdfs:// or s3a:// would."""
    from parallax.session import delete_path

    uri = "file://" + tmp_dir
    os.makedirs(os.path.join(tmp_dir, "d"))
    _write(os.path.join(tmp_dir, "d"), "a.csv", "h1,h2,h3\n1,2,3\n4,5,6\n")
    checked = read_records(spark, uri + "/d", 3, header=True)
    assert sorted(tuple(r) for r in good_records(checked).collect()) == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    save_model(spark, relu_2_3_1(), uri + "/model")
    assert load_model(spark, uri + "/model").n_params == relu_2_3_1().n_params
    write_predictions(_preds(spark), uri + "/pred", fmt="text")
    assert len(read_lines(spark, uri + "/pred").collect()) == 2
    assert delete_path(spark, uri + "/pred") and not os.path.exists(os.path.join(tmp_dir, "pred"))
