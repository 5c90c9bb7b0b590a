import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from data_dirs import SF001, SF01
from parallax.fixtures import net_price_records, read_table, relu_2_3_1, relu_2_8_1
from parallax.model import Model, forward
from parallax.operators.examples import features_only, key_examples, split_by_position, to_examples
from parallax.operators.score import score, score_batched, score_expr
from parallax.plans.inspect import has_python_node, physical_plan


def _keyed(spark, sf=SF01):
    rec = net_price_records(read_table(spark, sf, "lineitem"))
    return key_examples(to_examples(rec, ["x1", "x2"], ["y"]))


def _by_id(df):
    return {r.row_id: r.prediction[0] for r in df.select("row_id", "prediction").collect()}


def test_expr_plan_is_one_codegen_stage_without_python(spark):
    s = score_expr(_keyed(spark), relu_2_8_1())
    plan = physical_plan(s)
    assert not has_python_node(s)
    assert "Exchange" not in plan
    assert "xxhash64" in plan


def test_batched_plan_has_python_and_no_shuffle(spark):
    s = score_batched(_keyed(spark), relu_2_8_1(), 2048)
    assert has_python_node(s)
    assert "Exchange" not in physical_plan(s)


def test_expr_and_batched_agree_for_all_batch_sizes(spark):
    keyed = _keyed(spark)
    m = relu_2_8_1()
    ref = _by_id(score_expr(keyed, m))
    for b in (5, 2048, 4096, 8192):
        got = _by_id(score_batched(keyed, m, b))
        assert got.keys() == ref.keys()
        assert max(abs(got[k] - ref[k]) for k in ref) < 1e-9


@pytest.mark.parametrize("act", ["tanh", "sigmoid", "identity", "relu"])
def test_activations_match_numpy(spark, act):
    m = Model.random([2, 4, 3, 1], [act, act, "identity"], seed=5)
    pdf = features_only(_keyed(spark, SF001)).toPandas()
    x = np.stack(pdf.features.to_numpy())
    ref = forward(m, x)[:, 0]
    got = score_expr(_keyed(spark, SF001), m).select("row_id", "prediction").toPandas()
    got = got.set_index("row_id").loc[pdf.row_id].prediction.map(lambda v: v[0]).to_numpy()
    assert np.abs(got - ref).max() < 1e-12


def test_auto_picks_expr_for_small_and_batched_for_wide(spark):
    keyed = _keyed(spark, SF001)
    assert not has_python_node(score(keyed, relu_2_3_1()))
    wide = Model.random([2, 64, 64, 1], ["relu", "relu", "identity"], seed=1)
    assert has_python_node(score(keyed, wide))


def test_multi_output_network(spark):
    m = Model.random([2, 5, 3], ["tanh", "identity"], seed=2)
    row = score(_keyed(spark, SF001), m).first()
    assert len(row.prediction) == 3


def test_split_by_position_matches_reference_layout(spark):
    recs = spark.createDataFrame([(1.0, 2.0, 3.0, None)], "c0 double, c1 double, c2 double, _bad string")
    ex = split_by_position(recs, label_index=2, num_labels=1).first()
    assert ex.features == [1.0, 2.0] and ex.label == [3.0]
    with pytest.raises(ValueError):
        split_by_position(recs, label_index=3)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=1, max_size=40))
def test_properties_row_count_ids_and_label_independence(spark, rows):
    df = spark.createDataFrame(rows, "a double, b double, c double")
    ex = to_examples(df, ["a", "b"], ["c"])
    m = relu_2_3_1()
    s1 = score_expr(key_examples(ex), m)
    s2 = score_expr(key_examples(ex.withColumn("label", F.array(F.lit(99.0)))), m)
    got1 = sorted((r.row_id, r.prediction[0]) for r in s1.collect())
    got2 = sorted((r.row_id, r.prediction[0]) for r in s2.collect())
    assert len(got1) == len(rows)
    assert sorted(r.row_id for r in ex.collect()) == [g[0] for g in got1]
    assert got1 == got2


def test_scan_reads_only_the_columns_used(spark):
    li = read_table(spark, SF01, "lineitem")
    ex = to_examples(li, ["l_extendedprice", "l_discount"], ["l_tax"], id_cols=["l_orderkey", "l_linenumber"])
    plan = physical_plan(score_expr(key_examples(ex), relu_2_3_1()))
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "l_shipdate" not in schema and "l_returnflag" not in schema
    assert all(c in schema for c in ["l_extendedprice", "l_discount", "l_orderkey", "l_linenumber"])


def test_small_networks_score_bit_identically_on_both_paths(spark):
    # identity/ReLU only: tanh and exp may differ in the last bit between the
    # JVM and numpy (covered to 1e-12 by test_activations_match_numpy)
    keyed = _keyed(spark)
    for m in (relu_2_3_1(), relu_2_8_1(), Model.random([2, 16, 8, 1], ["relu", "relu", "identity"], seed=4)):
        a = _by_id(score_expr(keyed, m))
        b = _by_id(score_batched(keyed, m, 4096))
        assert a == b


def test_count_would_time_nothing_so_timed_passes_use_noop(spark):
    scored = score_batched(_keyed(spark, SF001), relu_2_8_1(), 2048)
    # a count's plan prunes the prediction (and its Python UDF) away...
    assert not has_python_node(scored.groupBy().count())
    # ...while writing the scored rows (the noop sink) keeps it
    assert has_python_node(scored)


def test_auto_choice_thresholds():
    from parallax.operators.score import prefers_expressions

    assert prefers_expressions(relu_2_8_1())
    assert prefers_expressions(Model.random([2, 24, 1], ["relu", "identity"]))  # 97 weights, 24 units
    assert not prefers_expressions(Model.random([2, 28, 1], ["relu", "identity"]))
    assert not prefers_expressions(Model.random([2, 12, 12, 1], ["relu", "relu", "identity"]))


def test_multi_output_batched_equals_expressions(spark):
    m = Model.random([2, 5, 3], ["relu", "identity"], seed=2)
    keyed = _keyed(spark, SF001)
    a = {r.row_id: list(r.prediction) for r in score_expr(keyed, m).collect()}
    b = {r.row_id: list(r.prediction) for r in score_batched(keyed, m, 100).collect()}
    assert a.keys() == b.keys() and all(len(v) == 3 for v in b.values())
    assert a == b  # small layers: the same summation order, so the same bits


def test_shuffle_counts(spark):
    from parallax.operators.train import assign_workers
    from parallax.plans.inspect import shuffle_count

    keyed = _keyed(spark, SF001)
    assert shuffle_count(score_expr(keyed, relu_2_8_1())) == 0
    assert shuffle_count(assign_workers(to_examples(net_price_records(read_table(spark, SF001, "lineitem")),
                                                    ["x1", "x2"], ["y"]), 4, 64, 2, layout="worker")) == 1


def test_null_features_give_null_predictions_on_both_paths(spark):
    from pyspark.sql import functions as F

    keyed = _keyed(spark, SF001).withColumn(
        "features", F.when(F.col("row_id") % 7 == 0, F.array(F.lit(None).cast("double"), F.lit(0.5))).otherwise(F.col("features")))
    for m in (relu_2_3_1(), Model.random([2, 4, 3], ["relu", "identity"], seed=3)):
        a = {r.row_id: r.prediction for r in score_expr(keyed, m).collect()}
        b = {r.row_id: r.prediction for r in score_batched(keyed, m, 256).collect()}
        nulls_a = {k for k, v in a.items() if v is None or any(p is None for p in v)}
        nulls_b = {k for k, v in b.items() if v is None or any(p is None for p in v)}
        assert nulls_a and nulls_a == nulls_b
        assert all(a[k] == b[k] for k in a if k not in nulls_a)


def test_both_paths_agree_on_null_nan_and_infinity(spark):
    rows = [(1, [1.0, 2.0]), (2, [None, 2.0]), (3, [float("nan"), 2.0]), (4, [float("inf"), float("-inf")]), (5, None), (6, [float("nan"), None])]
    df = spark.createDataFrame(rows, "row_id long, features array<double>")
    for outs in (1, 2):
        m = Model.random([2, 4, outs], ["relu", "identity"], seed=3)
        a = {r.row_id: r.prediction for r in score_expr(df, m).collect()}
        b = {r.row_id: r.prediction for r in score_batched(df, m, 2).collect()}
        for k in a:
            assert len(a[k]) == len(b[k]) == outs
            assert all(x == y or (x is not None and y is not None and np.isnan(x) and np.isnan(y)) for x, y in zip(a[k], b[k]))
        assert a[2] == a[5] == a[6] == [None] * outs and all(np.isnan(a[3]))


@pytest.mark.parametrize("method", ["expr", "batched"])
def test_wrong_feature_widths_are_refused(spark, method):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0])], "row_id long, features array<double>")
    with pytest.raises(Exception, match="the model takes 2 features, a row has 3"):
        score(df, relu_2_3_1(), method=method).collect()


def test_batch_size_changes_wide_results_by_rounding_only(spark):
    m = Model.random([64, 32, 1], ["relu", "identity"], seed=8)
    x = np.random.default_rng(0).normal(size=(500, 64))
    whole = forward(m, x)
    for b in (1, 7, 100):
        assert np.allclose(np.concatenate([forward(m, x[i:i + b]) for i in range(0, 500, b)]), whole, rtol=1e-12, atol=1e-14)


def test_text_form_keeps_nulls(spark):
    from parallax.sources.sinks import format_prediction

    df = spark.createDataFrame([("k", [None, 2.0]), (None, [1.0]), ("k", None), ("k", [])], "key string, prediction array<double>")
    assert [r[0] for r in df.select(format_prediction()).collect()] == ["k: [null, 2.0]", "null: [1.0]", "k: null", "k: []"]


def test_count_scores_and_counts_non_null_predictions(spark):
    from parallax.plans.bench import count_predictions

    df = _keyed(spark, SF001).withColumn("features", F.when(F.col("row_id") % 2 == 0, F.col("features")))
    scored = count_predictions(score_batched(df, relu_2_3_1()))
    assert has_python_node(scored)
    assert 2500 < scored.first().n_records < 3500
