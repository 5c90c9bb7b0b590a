"""Registered queries (Spark) and their DuckDB oracles (SQL), by name.

Every query reads the driver's tables (or data Spark derives from them and
writes to the shared scratch folder first), so its work grows with them.
Array outputs are spread into scalar columns so both sides compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parallax.fixtures import linear_2_1, net_price_records, read_table, relu_2_3_1, relu_2_8_1
from parallax.model import Dense, Model
from parallax.operators.examples import DEFAULT_KEY, key_examples, split_by_position, to_examples, with_scan_id
from parallax.operators.partition import balanced_partitions, partition_dataset, write_partitioned
from parallax.operators.row_ids import with_dense_id
from parallax.operators.score import score, score_batched, score_expr
from parallax.operators.train import TrainOptions, assign_workers, average_blocks, average_parameters, fit, fit_paths, fit_round, write_minibatches
from parallax.plans.bench import bench_fit, bench_score, count_predictions, summarise_runs
from parallax.session import scratch_path
from parallax.sources.csv import good_records, read_records
from parallax.sources.model_store import load_model, save_model
from parallax.sources.sinks import format_prediction, write_predictions
from parallax.sources.text import read_lines

KEY = DEFAULT_KEY
ID_COLS = ["l_orderkey", "l_linenumber"]

# The malformed-input fixture appended to the part lines.
BAD_LINES = ["1,2,3", "4,5", "x,1,2", "7,8,9,10", "", "c0,c1,c2", "NaN,1,2", "1,Infinity,2", "1,2,-Infinity", "1d,2,3",
             "1e400,2,3", "1e2,-2.5,+3"]


# --------------------------------------------------------------- helpers ----

def _lineitem_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = net_price_records(read_table(spark, sf_dir, "lineitem"), keep=ID_COLS)
    return key_examples(to_examples(rec, ["x1", "x2"], ["y"], keep=ID_COLS), KEY, keep=ID_COLS)


def _flat_prediction(scored: DataFrame, cols: list[str]) -> DataFrame:
    return scored.select(*cols, F.col("prediction")[0].alias("prediction"))


def _part_lines_dir(spark: SparkSession, sf_dir: str, header: bool = False) -> str:
    """The part table's (p_partkey, p_size, p_retailprice) as CSV text files."""
    path = scratch_path(spark, "part-csv")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    # several files, so per-file header handling is exercised
    part.repartition(4).write.option("header", header).csv(path)
    return path


def wide_64() -> Model:
    """A 64-input linear unit whose weights follow a rule: w_i = (i + 1) / 64 - 0.5."""
    w = np.array([[(i + 1) / 64.0 - 0.5] for i in range(64)])
    return Model((Dense(w, np.array([0.25]), "identity"),))


# ------------------------------------------------------------ SQL pieces ----

X1 = "(l_extendedprice / CAST(1e5 AS DOUBLE))"
X2 = "l_discount"
Y = f"({X1} * (CAST(1.0 AS DOUBLE) - l_discount))"


def _d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def model_sql(model: Model, inputs: list[str]) -> list[str]:
    """The network as SQL expressions, same operand order as the Column form."""
    cur = inputs
    for layer in model.layers:
        outs = []
        for j in range(layer.n_out):
            z = " + ".join(f"({x}) * {_d(layer.weights[i, j])}" for i, x in enumerate(cur))
            z = f"{z} + {_d(layer.bias[j])}"
            if layer.activation == "relu":
                z = f"greatest({z}, CAST(0.0 AS DOUBLE))"
            elif layer.activation != "identity":
                raise ValueError("oracle SQL covers identity and relu only")
            outs.append(z)
        cur = outs
    return cur


LINEAR_SQL = f"{X1} * {_d(0.5)} + {X2} * {_d(-0.25)} + {_d(0.1)}"
RELU_SQL = (
    f"greatest({X1} * {_d(0.5)} + {X2} * {_d(-0.25)} + {_d(0.1)}, {_d(0.0)}) * {_d(0.3)}"
    f" + greatest({X1} * {_d(0.125)} + {X2} * {_d(0.75)} + {_d(-0.2)}, {_d(0.0)}) * {_d(-0.4)}"
    f" + greatest({X1} * {_d(-0.6)} + {X2} * {_d(0.3)} + {_d(0.05)}, {_d(0.0)}) * {_d(0.7)}"
    f" + {_d(0.01)}"
)


def _scored_sql(pred: str) -> str:
    return f"SELECT '{KEY}' AS key, l_orderkey, l_linenumber, {pred} AS prediction FROM lineitem"


# -------------------------------------------------------------- queries ----

def q_read_lines(spark, sf_dir):
    return read_lines(spark, _part_lines_dir(spark, sf_dir))


def q_parse_records(spark, sf_dir):
    return good_records(read_records(spark, _part_lines_dir(spark, sf_dir), 3))


def q_parse_records_header(spark, sf_dir):
    return good_records(read_records(spark, _part_lines_dir(spark, sf_dir, header=True), 3, header=True))


def q_bad_records(spark, sf_dir):
    extra = scratch_path(spark, "bad-lines")
    spark.createDataFrame([(s,) for s in BAD_LINES], "value string").coalesce(1).write.text(extra)
    return read_records(spark, [_part_lines_dir(spark, sf_dir), extra], 3)


def q_to_examples(spark, sf_dir):
    rec = net_price_records(read_table(spark, sf_dir, "lineitem"), keep=ID_COLS)
    ex = to_examples(rec, ["x1", "x2"], ["y"], keep=ID_COLS)
    return ex.select(*ID_COLS, F.col("features")[0].alias("x1"), F.col("features")[1].alias("x2"),
                     F.col("label")[0].alias("y"))


def q_key_examples(spark, sf_dir):
    k = _lineitem_keyed(spark, sf_dir)
    return k.select("key", *ID_COLS, F.col("features")[0].alias("x1"), F.col("features")[1].alias("x2"))


def q_score_linear(spark, sf_dir):
    return _flat_prediction(score_expr(_lineitem_keyed(spark, sf_dir), linear_2_1()), ["key", *ID_COLS])


def q_score_relu(spark, sf_dir):
    return _flat_prediction(score_expr(_lineitem_keyed(spark, sf_dir), relu_2_3_1()), ["key", *ID_COLS])


def _q_score_batched(batch: int):
    def q(spark, sf_dir):
        scored = score_batched(_lineitem_keyed(spark, sf_dir), relu_2_3_1(), batch_size=batch)
        return _flat_prediction(scored, ["key", *ID_COLS])

    return q


def q_score_wide_64(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    ex = to_examples(emb, "embedding", None, row_id=None, keep=["vec_id"])
    return _flat_prediction(score_batched(ex, wide_64(), batch_size=2048), ["vec_id"])


def q_model_round_trip(spark, sf_dir):
    path = scratch_path(spark, "model")
    save_model(spark, relu_2_3_1(), path)
    model = load_model(spark, path)
    return _flat_prediction(score_expr(_lineitem_keyed(spark, sf_dir), model), ["key", *ID_COLS])


def q_predictions_text(spark, sf_dir):
    path = scratch_path(spark, "pred-text")
    scored = score_expr(_lineitem_keyed(spark, sf_dir), relu_2_3_1(), keep=["key"])
    write_predictions(scored, path, fmt="text")
    v = F.col("value")
    return read_lines(spark, path).select(
        F.regexp_extract(v, r"^(.*): \[", 1).alias("key"),
        F.regexp_extract(v, r"\[(.*)\]$", 1).cast("double").alias("prediction"),
    )


def q_predictions_csv(spark, sf_dir):
    path = scratch_path(spark, "pred-csv")
    scored = score_expr(_lineitem_keyed(spark, sf_dir), relu_2_3_1(), keep=["key", *ID_COLS])
    write_predictions(scored, path, fmt="csv", width=1)
    back = spark.read.schema("key string, l_orderkey bigint, l_linenumber int, p0 double").csv(path)
    return back.select("key", *ID_COLS, F.col("p0").alias("prediction"))


def q_full_pipeline(spark, sf_dir):
    """Text lines -> CSV records -> (features, label) -> keyed -> scored."""
    path = scratch_path(spark, "net-price-csv")
    net_price_records(read_table(spark, sf_dir, "lineitem")).write.csv(path)
    ex = split_by_position(good_records(read_records(spark, path, 3)), label_index=2, num_labels=1)
    scored = score_expr(key_examples(ex, KEY), relu_2_3_1(), keep=["key", "features"])
    return scored.select("key", F.col("features")[0].alias("x1"), F.col("features")[1].alias("x2"),
                         F.col("prediction")[0].alias("prediction"))


def two_outputs() -> Model:
    """A 2-3-2 network whose weights follow a rule: w = (i - j) / 4, b = (j + 1) / 8."""
    def layer(n_in, n_out, act):
        w = np.array([[(i - j) / 4.0 + 0.125 for j in range(n_out)] for i in range(n_in)])
        return Dense(w, np.array([(j + 1) / 8.0 for j in range(n_out)]), act)

    return Model((layer(2, 3, "relu"), layer(3, 2, "identity")))


def squashed(activation: str) -> Model:
    """A 2-3-1 network with the given hidden activation."""
    return Model((Dense(relu_2_3_1().layers[0].weights, relu_2_3_1().layers[0].bias, activation), relu_2_3_1().layers[1]))


# Rows whose first feature is null, or NaN, or whose second is infinite, by a rule on the line number.
_HOLES = ("CASE WHEN l_linenumber % 7 = 1 THEN NULL WHEN l_linenumber % 7 = 2 THEN CAST('NaN' AS DOUBLE) ELSE {x1} END",
          "CASE WHEN l_linenumber % 7 = 3 THEN NULL WHEN l_linenumber % 7 = 4 THEN CAST('Infinity' AS DOUBLE) ELSE {x2} END")


def _holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = read_table(spark, sf_dir, "lineitem").selectExpr(
        *ID_COLS, _HOLES[0].format(x1="(l_extendedprice / CAST(1e5 AS DOUBLE))") + " AS x1", _HOLES[1].format(x2="l_discount") + " AS x2")
    return key_examples(to_examples(rec, ["x1", "x2"], None, row_id=None, keep=ID_COLS), KEY, keep=ID_COLS)


def _spread(scored: DataFrame, n_out: int, path: str | None = None) -> DataFrame:
    """Outputs as columns p0, p1, ...; NaN, which compares with nothing, as a mark of its own."""
    outs = []
    for i in range(n_out):
        p = F.col("prediction")[i]
        outs += [F.when(~F.isnan(p), p).alias(f"p{i}"), F.coalesce(F.isnan(p), F.lit(False)).cast("int").alias(f"nan{i}")]
    return scored.select(*ID_COLS, F.size("prediction").alias("width"), *outs, *([F.lit(path).alias("path")] if path else []))


def q_score_nulls(spark, sf_dir):
    """Both scoring paths on nulls, NaN and infinities; two outputs."""
    keyed, m = _holed(spark, sf_dir), two_outputs()
    return _spread(score_expr(keyed, m), 2, "expr").unionAll(_spread(score_batched(keyed, m, batch_size=2048), 2, "batched"))


def q_score_two_outputs(spark, sf_dir):
    return _spread(score_batched(_lineitem_keyed(spark, sf_dir), two_outputs()), 2).drop("nan0", "nan1", "width")


def q_score_auto(spark, sf_dir):
    return _flat_prediction(score(_lineitem_keyed(spark, sf_dir), relu_2_3_1()), ["key", *ID_COLS])


def _q_squashed(activation: str):
    def q(spark, sf_dir):
        keyed, m = _lineitem_keyed(spark, sf_dir), squashed(activation)
        a = _flat_prediction(score_expr(keyed, m), ID_COLS).withColumn("path", F.lit("expr"))
        b = _flat_prediction(score_batched(keyed, m), ID_COLS).withColumn("path", F.lit("batched"))
        return a.unionAll(b).withColumn("prediction", F.round("prediction", 4))

    return q


def q_row_identity(spark, sf_dir):
    """Every row has a row_id of its own, from the scan and from the content and place alike."""
    li = read_table(spark, sf_dir, "lineitem")
    content = to_examples(net_price_records(li), ["x1", "x2"], ["y"]).select(F.lit("content").alias("kind"), "row_id")
    scan = with_scan_id(li).select(F.lit("scan").alias("kind"), "row_id")
    return content.unionAll(scan).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("row_id").alias("n_ids"))


def q_show_predictions(spark, sf_dir):
    """The console sink's line of every row, for predictions in thousandths."""
    scored = score_expr(_lineitem_keyed(spark, sf_dir), linear_2_1())
    milli = scored.withColumn("prediction", F.transform("prediction", lambda v: F.floor(v * 1000).cast("double")))
    holes = F.when(F.col("l_linenumber") == 1, F.array(F.lit(None).cast("double"), F.col("prediction")[0])).otherwise(F.col("prediction"))
    return milli.withColumn("prediction", holes).select(*ID_COLS, format_prediction().alias("line"))


def q_partition_dataset(spark, sf_dir):
    """Rows and partitions of each key after hash partitioning."""
    part = partition_dataset(read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), 8, by=["l_returnflag"])
    return (part.select("l_returnflag", F.spark_partition_id().alias("p")).groupBy("l_returnflag")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("p").alias("n_partitions")))


def q_balanced_partitions(spark, sf_dir):
    """Lineitem in 16 ranges of a key of which one value has a third of the rows: none above 1.5 times the median, in order."""
    li = read_table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, F.lit(7)).otherwise(F.col("l_orderkey")).alias("k"))
    parts = balanced_partitions(li, 16, ["k"], part_col="part").groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    in_order = F.coalesce(F.col("lo") >= F.lag("hi").over(Window.orderBy("part")), F.lit(True))
    return parts.withColumn("ok", in_order).agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n").alias("n_rows"), F.min("ok").alias("in_order"),
                                                (F.max("n") <= F.median("n") * 1.5).alias("balanced"))


def q_dense_row_id(spark, sf_dir):
    """Every lineitem row's dense id, and that several files' ids have no gaps."""
    li = read_table(spark, sf_dir, "lineitem").select(*ID_COLS)
    one = with_dense_id(li).select("row_id", *ID_COLS, F.lit("one").alias("files"))
    path = scratch_path(spark, "several-files")
    li.repartition(7).write.parquet(path)
    several = with_dense_id(spark.read.parquet(path)).select("row_id", F.lit(None).cast("long").alias("l_orderkey"),
                                                             F.lit(None).cast(li.schema["l_linenumber"].dataType).alias("l_linenumber"), F.lit("several").alias("files"))
    return one.unionAll(several)


def q_average_blocks(spark, sf_dir):
    """The embeddings' mean weighted by label, in blocks of 16 components."""
    emb = read_table(spark, sf_dir, "embeddings")
    wp = emb.select("vec_id", F.col("embedding").cast("array<double>").alias("params"), F.col("label").alias("n"))
    blocks = average_blocks(wp, order="vec_id", block=16)
    return blocks.select("block", F.posexplode("values").alias("i", "v")).select(
        (F.col("block") * 16 + F.col("i")).alias("pos"), F.round("v", 9).alias("value"))


def q_fit_paths(spark, sf_dir):
    """``fit_minibatches`` from eight minibatch files."""
    ex = _event_examples(spark, sf_dir)
    opts = TrainOptions(workers=4, batch_size=-(-ex.count() // 8), averaging_frequency=2, learning_rate=0.5)
    path = scratch_path(spark, "minibatches")
    write_minibatches(ex, path, opts, worker_col="event_id", order_col="event_id")
    model, _ = fit_paths(spark, path, linear_2_1(), 1, opts)
    return _params(spark, model)


def q_count_predictions(spark, sf_dir):
    return count_predictions(score_expr(_lineitem_keyed(spark, sf_dir), relu_2_3_1()))


def q_bench_summary(spark, sf_dir):
    runs = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("iteration"))
        .agg(F.count(F.lit(1)).alias("n_records"),
             F.sum((F.col("l_quantity") * F.lit(1000.0)).cast("bigint")).alias("ns"))
    )
    return summarise_runs(runs)


def q_bench_score_runs(spark, sf_dir):
    """Three timed scoring passes; the timings themselves are left out."""
    scored = score_expr(_lineitem_keyed(spark, sf_dir), relu_2_3_1())
    return bench_score(spark, scored, iterations=3, name="score").select("name", "iteration", "n_records")


def q_bench_fit_runs(spark, sf_dir):
    """Two timed iterations of two epochs each; rows trained per iteration."""
    ex = to_examples(net_price_records(read_table(spark, sf_dir, "lineitem")), ["x1", "x2"], ["y"])
    opts = TrainOptions(workers=4, batch_size=2048, averaging_frequency=5, learning_rate=0.1)
    runs, _, _ = bench_fit(spark, ex, relu_2_8_1(), epochs=2, iterations=2, options=opts)
    return runs.select("name", "iteration", "n_records")


def q_assign_batches(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id")
    a = assign_workers(ev, workers=4, batch_size=128, averaging_frequency=4, worker_col="event_id",
                       order_col="event_id")
    return a.select("event_id", "worker", "batch_no", "round_no")


def q_average_parameters(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    wp = emb.select(F.col("embedding").cast("array<double>").alias("params"), F.col("label").alias("n"))
    return average_parameters(wp).select("pos", F.round("value", 9).alias("value"))


def q_sgd_round(spark, sf_dir):
    """One averaging round, F = 1, one minibatch per worker (batch larger than
    any worker's share): equal to one full-batch gradient step."""
    rec = net_price_records(read_table(spark, sf_dir, "lineitem"), keep=ID_COLS)
    ex = to_examples(rec, ["x1", "x2"], ["y"], keep=ID_COLS)
    placed = assign_workers(ex, workers=4, batch_size=1 << 40, averaging_frequency=1)
    wp = fit_round(placed, linear_2_1(), 0, learning_rate=0.5)
    return average_parameters(wp).select("pos", F.round("value", 9).alias("value"))


def _params(spark: SparkSession, model: Model) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.params())], "pos int, value double").select(
        "pos", F.round("value", 9).alias("value"))


def q_fit_epochs(spark, sf_dir):
    """The parameters after three epochs of one minibatch per worker (averaged: three full-batch steps)."""
    ex = to_examples(net_price_records(read_table(spark, sf_dir, "lineitem")), ["x1", "x2"], ["y"])
    opts = TrainOptions(workers=4, batch_size=1 << 40, averaging_frequency=1, learning_rate=0.5)
    model, _ = fit(ex, linear_2_1(), epochs=3, options=opts)
    return _params(spark, model)


def q_fit_resumed(spark, sf_dir):
    """``fit_epochs`` stopped after each round and resumed from its journal."""
    ex = to_examples(net_price_records(read_table(spark, sf_dir, "lineitem")), ["x1", "x2"], ["y"])
    opts = TrainOptions(workers=4, batch_size=1 << 40, averaging_frequency=1, learning_rate=0.5)
    journal = scratch_path(spark, "journal")
    for _ in range(3):
        model, _ = fit(ex, linear_2_1(), epochs=3, options=opts, journal=journal, max_rounds=1)
    return _params(spark, model)


def _event_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 10 / CAST(10 AS DOUBLE) AS x1", "event_id % 7 / CAST(7 AS DOUBLE) AS x2")
    return to_examples(ev.withColumn("y", F.col("x1") * F.lit(0.5) - F.col("x2")), ["x1", "x2"], ["y"], row_id=None, keep=["event_id"])


def _q_fit_minibatches(layout: str):
    def q(spark, sf_dir):
        """Two minibatches for each of four workers, in the order of a unique key, then one averaging."""
        ex = _event_examples(spark, sf_dir)
        batch = -(-ex.count() // 8)
        opts = TrainOptions(workers=4, batch_size=batch, averaging_frequency=2, learning_rate=0.5)
        model, _ = fit(ex, linear_2_1(), epochs=1, options=opts, worker_col="event_id", order_col="event_id", layout=layout)
        return _params(spark, model)

    return q


def q_assign_batches_range(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id")
    a = assign_workers(ev, workers=4, batch_size=128, averaging_frequency=4, worker_col="event_id",
                       order_col="event_id", layout="range")
    return a.select("event_id", "worker", "batch_no", "round_no")


def q_assign_batches_hashed(spark, sf_dir):
    """Hashed workers and order, range layout: each worker's positions run from 0 without gaps or repeats, and its
    share is near a quarter."""
    ev = read_table(spark, sf_dir, "events").select("event_id")
    ex = ev.withColumn("row_id", F.xxhash64("event_id"))
    a = assign_workers(ex, workers=4, batch_size=128, averaging_frequency=4, layout="range")
    n = F.count(F.lit(1))
    per = a.groupBy("worker").agg(n.alias("n"), F.countDistinct("_pos").alias("d"), F.min("_pos").alias("lo"), F.max("_pos").alias("hi"),
                                  F.max("batch_no").alias("b"), F.max("round_no").alias("r"))
    total = per.agg(F.sum("n").alias("n_rows"))
    return per.crossJoin(F.broadcast(total)).select(
        "worker", "n_rows", ((F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).cast("int").alias("gapless"),
        (F.abs(F.col("n") * 4 / F.col("n_rows") - 1) < 0.05 + 10 / F.sqrt("n_rows")).cast("int").alias("balanced"),
        ((F.col("b") == F.floor((F.col("n") - 1) / 128)) & (F.col("r") == F.floor((F.col("n") - 1) / 512))).cast("int").alias("numbered"))


def q_partition_write(spark, sf_dir):
    path = scratch_path(spark, "partitioned")
    rec = net_price_records(read_table(spark, sf_dir, "lineitem"), keep=["l_returnflag"])
    write_partitioned(rec, path, ["l_returnflag"])
    return spark.read.parquet(path).select("l_returnflag", "x1", "x2", "y")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "read_lines": q_read_lines,
    "parse_records": q_parse_records,
    "parse_records_header": q_parse_records_header,
    "bad_records": q_bad_records,
    "to_examples": q_to_examples,
    "key_examples": q_key_examples,
    "score_linear": q_score_linear,
    "score_relu": q_score_relu,
    "score_batched_5": _q_score_batched(5),
    "score_batched_2048": _q_score_batched(2048),
    "score_batched_4096": _q_score_batched(4096),
    "score_batched_8192": _q_score_batched(8192),
    "score_wide_64": q_score_wide_64,
    "model_round_trip": q_model_round_trip,
    "predictions_text": q_predictions_text,
    "predictions_csv": q_predictions_csv,
    "full_pipeline": q_full_pipeline,
    "score_nulls": q_score_nulls,
    "score_two_outputs": q_score_two_outputs,
    "score_auto": q_score_auto,
    "score_tanh": _q_squashed("tanh"),
    "score_sigmoid": _q_squashed("sigmoid"),
    "row_identity": q_row_identity,
    "show_predictions": q_show_predictions,
    "partition_dataset": q_partition_dataset,
    "count_predictions": q_count_predictions,
    "bench_summary": q_bench_summary,
    "bench_score_runs": q_bench_score_runs,
    "bench_fit_runs": q_bench_fit_runs,
    "assign_batches": q_assign_batches,
    "assign_batches_range": q_assign_batches_range,
    "assign_batches_hashed": q_assign_batches_hashed,
    "average_parameters": q_average_parameters,
    "sgd_round": q_sgd_round,
    "fit_epochs": q_fit_epochs,
    "fit_resumed": q_fit_resumed,
    "fit_paths": q_fit_paths,
    "balanced_partitions": q_balanced_partitions,
    "dense_row_id": q_dense_row_id,
    "average_blocks": q_average_blocks,
    "fit_minibatches": _q_fit_minibatches("worker"),
    "fit_minibatches_range": _q_fit_minibatches("range"),
    "partition_write": q_partition_write,
}


# --------------------------------------------------------------- oracles ----

_PART_DOUBLES = ("SELECT CAST(p_partkey AS DOUBLE) AS c0, CAST(p_size AS DOUBLE) AS c1, "
                 "p_retailprice AS c2 FROM part")
_BAD_VALUES = (
    "SELECT * FROM (VALUES (1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE, NULL::VARCHAR), "
    "(NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, '4,5'), "
    "(NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 'x,1,2'), "
    "(NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, '7,8,9,10'), "
    "(NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 'c0,c1,c2'), "
    "(NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 'NaN,1,2'), "
    "(NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, '1,Infinity,2'), "
    "(NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, '1,2,-Infinity'), "
    "(NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, '1d,2,3'), "
    "(NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, '1e400,2,3'), "
    "(100.0::DOUBLE, -2.5::DOUBLE, 3.0::DOUBLE, NULL::VARCHAR)) AS t(c0, c1, c2, _bad)"
)
_WIDE = model_sql(wide_64(), [f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(64)])[0]


def _sgd_sql(lr: float = 0.5) -> str:
    e = f"({X1} * {_d(0.5)} + {X2} * {_d(-0.25)} + {_d(0.1)} - {Y})"
    return (
        f"WITH g AS (SELECT avg(2 * {e} * {X1}) AS g0, avg(2 * {e} * {X2}) AS g1, avg(2 * {e}) AS g2 "
        f"FROM lineitem) "
        f"SELECT 0 AS pos, round({_d(0.5)} - {_d(lr)} * g0, 9) AS value FROM g UNION ALL "
        f"SELECT 1 AS pos, round({_d(-0.25)} - {_d(lr)} * g1, 9) AS value FROM g UNION ALL "
        f"SELECT 2 AS pos, round({_d(0.1)} - {_d(lr)} * g2, 9) AS value FROM g"
    )


def _squashed_sql(f: str) -> str:
    h = [f"({X1} * {_d(w[0])} + {X2} * {_d(w[1])} + {_d(b)})"
         for w, b in zip(relu_2_3_1().layers[0].weights.T, relu_2_3_1().layers[0].bias)]
    out = relu_2_3_1().layers[1]
    z = " + ".join(f"{f.format(z=x)} * {_d(w)}" for x, w in zip(h, out.weights[:, 0])) + f" + {_d(out.bias[0])}"
    return (f"SELECT l_orderkey, l_linenumber, path, round({z}, 4) + CAST(0 AS DOUBLE) AS prediction FROM lineitem, "
            "(VALUES ('expr'), ('batched')) AS t(path)")


def _two_outputs_sql(x1: str, x2: str) -> tuple[str, str]:
    m = two_outputs()
    relu = []
    for j in range(3):
        z = f"({x1}) * {_d(m.layers[0].weights[0, j])} + ({x2}) * {_d(m.layers[0].weights[1, j])} + {_d(m.layers[0].bias[j])}"
        relu.append(f"CASE WHEN {z} < 0 THEN CAST(0 AS DOUBLE) ELSE {z} END")
    return tuple(" + ".join(f"({r}) * {_d(m.layers[1].weights[i, j])}" for i, r in enumerate(relu)) + f" + {_d(m.layers[1].bias[j])}"
                 for j in range(2))


_HOLED_SQL = _two_outputs_sql(_HOLES[0].format(x1=X1), _HOLES[1].format(x2=X2))

# K full-batch steps of a linear unit are a recursion over nine sums.
_EPOCHS_SQL = (
    f"WITH RECURSIVE s AS (SELECT avg({X1} * {X1}) AS s11, avg({X1} * {X2}) AS s12, avg({X2} * {X2}) AS s22, avg({X1}) AS m1, "
    f"avg({X2}) AS m2, avg({X1} * {Y}) AS y1, avg({X2} * {Y}) AS y2, avg({Y}) AS my FROM lineitem), "
    f"p AS (SELECT 0 AS k, {_d(0.5)} AS a, {_d(-0.25)} AS b, {_d(0.1)} AS c UNION ALL "
    "SELECT k + 1, a - (a * s11 + b * s12 + c * m1 - y1), b - (a * s12 + b * s22 + c * m2 - y2), c - (a * m1 + b * m2 + c - my) "
    "FROM p, s WHERE k < 3) "
    "SELECT CAST(pos AS INTEGER) AS pos, round(CASE pos WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 9) AS value "
    "FROM p, range(3) AS t(pos) WHERE k = 3"
)

_MINI_X = "(event_id % 10 / CAST(10 AS DOUBLE))", "(event_id % 7 / CAST(7 AS DOUBLE))"


def _mini_step(source: str, batch: int) -> str:
    """One minibatch's step of every worker, from the parameters in ``source``."""
    e = "(x1 * a + x2 * b + c - y)"
    return (f"SELECT e.worker, any_value(a) - avg({e} * x1) AS a, any_value(b) - avg({e} * x2) AS b, any_value(c) - avg({e}) AS c "
            f"FROM e JOIN {source} s ON e.worker = s.worker WHERE batch_no = {batch} GROUP BY e.worker")


_MINIBATCHES_SQL = (
    f"WITH r AS (SELECT event_id % 4 AS worker, {_MINI_X[0]} AS x1, {_MINI_X[1]} AS x2, {_MINI_X[0]} * 0.5 - {_MINI_X[1]} AS y, "
    "(row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1) // (SELECT (count(*) + 7) // 8 FROM events) AS batch_no FROM events), "
    "e AS (SELECT * FROM r), "
    f"w0 AS (SELECT DISTINCT worker, {_d(0.5)} AS a, {_d(-0.25)} AS b, {_d(0.1)} AS c FROM e), "
    f"w1 AS ({_mini_step('w0', 0)}), w2 AS ({_mini_step('w1', 1)}), "
    "n AS (SELECT worker, count(*) AS n FROM e GROUP BY worker), "
    "m AS (SELECT sum(a * n) / sum(n) AS a, sum(b * n) / sum(n) AS b, sum(c * n) / sum(n) AS c FROM w2 JOIN n USING (worker)) "
    "SELECT CAST(pos AS INTEGER) AS pos, round(CASE pos WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 9) AS value FROM m, range(3) AS t(pos)"
)


ORACLES: dict[str, str] = {
    "score_nulls": (
        f"WITH s AS (SELECT l_orderkey, l_linenumber, {_HOLED_SQL[0]} AS q0, {_HOLED_SQL[1]} AS q1 FROM lineitem) "
        "SELECT l_orderkey, l_linenumber, CAST(2 AS INTEGER) AS width, CASE WHEN NOT isnan(q0) THEN q0 END AS p0, CAST(coalesce(isnan(q0), false) AS INTEGER) AS nan0, "
        "CASE WHEN NOT isnan(q1) THEN q1 END AS p1, CAST(coalesce(isnan(q1), false) AS INTEGER) AS nan1, path "
        "FROM s, (VALUES ('expr'), ('batched')) AS t(path)"),
    "score_two_outputs": "SELECT l_orderkey, l_linenumber, {0} AS p0, {1} AS p1 FROM lineitem".format(*_two_outputs_sql(X1, X2)),
    "score_auto": _scored_sql(RELU_SQL),
    "score_tanh": _squashed_sql("tanh({z})"),
    "score_sigmoid": _squashed_sql("(1 / (1 + exp(-{z})))"),
    "row_identity": "SELECT kind, count(*) AS n_rows, count(*) AS n_ids FROM lineitem, (VALUES ('content'), ('scan')) AS t(kind) GROUP BY kind",
    "show_predictions": (
        f"WITH s AS (SELECT l_orderkey, l_linenumber, CAST(CAST(floor(({LINEAR_SQL}) * 1000) AS DOUBLE) AS VARCHAR) AS v FROM lineitem) "
        f"SELECT l_orderkey, l_linenumber, '{KEY}: [' || CASE WHEN l_linenumber = 1 THEN 'null, ' ELSE '' END || v || ']' AS line FROM s"),
    "partition_dataset": "SELECT l_returnflag, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_partitions FROM lineitem GROUP BY l_returnflag",
    "assign_batches_range": (
        "SELECT event_id, CAST(event_id % 4 AS INTEGER) AS worker, "
        "(row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1) // 128 AS batch_no, "
        "(row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1) // 512 AS round_no FROM events"),
    "assign_batches_hashed": (
        "SELECT CAST(w AS INTEGER) AS worker, (SELECT count(*) FROM events) AS n_rows, CAST(1 AS INTEGER) AS gapless, CAST(1 AS INTEGER) AS balanced, CAST(1 AS INTEGER) AS numbered FROM range(4) AS t(w)"),
    "fit_epochs": _EPOCHS_SQL,
    "fit_resumed": _EPOCHS_SQL,
    "balanced_partitions": "SELECT CAST(16 AS BIGINT) AS n_parts, count(*) AS n_rows, true AS in_order, true AS balanced FROM lineitem",
    "dense_row_id": (
        "SELECT row_number() OVER () - 1 AS row_id, l_orderkey, l_linenumber, 'one' AS files FROM lineitem "
        "UNION ALL SELECT row_number() OVER () - 1, NULL, NULL, 'several' FROM lineitem"),
    "fit_minibatches": _MINIBATCHES_SQL,
    "fit_minibatches_range": _MINIBATCHES_SQL,
    "fit_paths": _MINIBATCHES_SQL,
    "read_lines": ("SELECT CAST(p_partkey AS VARCHAR) || ',' || CAST(p_size AS VARCHAR) || ',' || "
                   "CAST(p_retailprice AS VARCHAR) AS value FROM part"),
    "parse_records": _PART_DOUBLES,
    "parse_records_header": _PART_DOUBLES,
    "bad_records": f"SELECT c0, c1, c2, NULL::VARCHAR AS _bad FROM ({_PART_DOUBLES}) UNION ALL {_BAD_VALUES}",
    "to_examples": f"SELECT l_orderkey, l_linenumber, {X1} AS x1, {X2} AS x2, {Y} AS y FROM lineitem",
    "key_examples": f"SELECT '{KEY}' AS key, l_orderkey, l_linenumber, {X1} AS x1, {X2} AS x2 FROM lineitem",
    "score_linear": _scored_sql(LINEAR_SQL),
    "score_relu": _scored_sql(RELU_SQL),
    "score_batched_5": _scored_sql(RELU_SQL),
    "score_batched_2048": _scored_sql(RELU_SQL),
    "score_batched_4096": _scored_sql(RELU_SQL),
    "score_batched_8192": _scored_sql(RELU_SQL),
    "score_wide_64": f"SELECT vec_id, {_WIDE} AS prediction FROM embeddings",
    "model_round_trip": _scored_sql(RELU_SQL),
    "predictions_text": f"SELECT '{KEY}' AS key, {RELU_SQL} AS prediction FROM lineitem",
    "predictions_csv": _scored_sql(RELU_SQL),
    "full_pipeline": f"SELECT '{KEY}' AS key, {X1} AS x1, {X2} AS x2, {RELU_SQL} AS prediction FROM lineitem",
    "count_predictions": f"SELECT count({RELU_SQL}) AS n_records FROM lineitem",
    "bench_summary": (
        "WITH runs AS (SELECT l_returnflag AS name, l_linenumber AS iteration, count(*) AS n_records, "
        "sum(CAST(l_quantity * 1000.0 AS BIGINT)) AS ns FROM lineitem GROUP BY l_returnflag, l_linenumber) "
        "SELECT name, count(*) AS runs, CAST(sum(n_records) AS BIGINT) AS n_records, "
        "CAST(sum(ns) // 1000000 AS BIGINT) AS total_ms, "
        "CAST(sum(ns) // nullif(sum(n_records), 0) AS BIGINT) AS mean_ns_per_record FROM runs GROUP BY name"
    ),
    "bench_score_runs": ("SELECT 'score' AS name, CAST(i AS INTEGER) AS iteration, "
                         "(SELECT count(*) FROM lineitem) AS n_records FROM range(3) AS t(i)"),
    "bench_fit_runs": ("SELECT 'fit' AS name, CAST(i AS INTEGER) AS iteration, "
                       "2 * (SELECT count(*) FROM lineitem) AS n_records FROM range(2) AS t(i)"),
    "assign_batches": (
        "SELECT event_id, CAST(event_id % 4 AS INTEGER) AS worker, "
        "(row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1) // 128 AS batch_no, "
        "(row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1) // 512 AS round_no "
        "FROM events"
    ),
    "average_parameters": (
        "WITH e AS (SELECT unnest(generate_series(0, len(embedding) - 1)) AS pos, "
        "unnest(embedding) AS v, label FROM embeddings) "
        "SELECT CAST(pos AS INTEGER) AS pos, round(sum(CAST(v AS DOUBLE) * label) / sum(label), 9) AS value "
        "FROM e GROUP BY pos"
    ),
    "sgd_round": _sgd_sql(),
    "average_blocks": (
        "WITH e AS (SELECT unnest(generate_series(0, len(embedding) - 1)) AS pos, "
        "unnest(embedding) AS v, label FROM embeddings) "
        "SELECT CAST(pos AS INTEGER) AS pos, round(sum(CAST(v AS DOUBLE) * label) / sum(label), 9) AS value "
        "FROM e GROUP BY pos"),
    "partition_write": f"SELECT l_returnflag, {X1} AS x1, {X2} AS x2, {Y} AS y FROM lineitem",
}
