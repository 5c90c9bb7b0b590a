import pytest

from data_dirs import SF001
from oracle_compare import compare, duck
from parallax.fixtures import net_price_records, read_table, relu_2_3_1
from parallax.operators.examples import key_examples, to_examples
from parallax.operators.score import score_batched
from parallax.plans.bench import bench_score, count_predictions, summarise_runs


def test_entry_smoke(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["key", "row_id", "prediction"]
    assert df.count() == 6000 or df.count() > 0


def test_every_library_query_has_an_oracle_and_is_registered():
    from __spark_entry__ import oracle_sql, queries
    from parallax.plans.catalog import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(__import__("parallax.plans.catalog", fromlist=["QUERIES"]).QUERIES))
def test_query_matches_oracle_small(spark, name):
    from __spark_entry__ import oracle_sql, queries

    r = compare(spark, duck(SF001), name, queries()[name], oracle_sql().get(name), SF001)
    assert r["ok"] in (True, None), r
    assert r.get("types", True), r
    assert r["rows"] > 0


def test_bench_runs_and_summary(spark):
    rec = net_price_records(read_table(spark, SF001, "lineitem"))
    scored = score_batched(key_examples(to_examples(rec, ["x1", "x2"], ["y"])), relu_2_3_1(), 2048)
    runs = bench_score(spark, scored, iterations=2, name="b")
    s = summarise_runs(runs).first()
    assert s.runs == 2 and s.n_records == 12000 and s.mean_ns_per_record > 0
    assert count_predictions(scored).first().n_records == 6000
    empty = spark.createDataFrame([("z", 0, 0, 5)], "name string, iteration int, n_records bigint, ns bigint")
    assert summarise_runs(empty).first().mean_ns_per_record is None
