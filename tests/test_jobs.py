import os

from data_dirs import SF001
from parallax.fixtures import net_price_records, read_table, relu_2_8_1
from parallax.plans.jobs import main
from parallax.sources.model_store import load_model, save_model


def test_score_and_train_jobs_end_to_end(spark, tmp_dir, capsys):
    data = os.path.join(tmp_dir, "data")
    net_price_records(read_table(spark, SF001, "lineitem")).write.csv(data)
    with open(os.path.join(data, "zz-bad.csv"), "w") as f:
        f.write("1,2\n")
    model = os.path.join(tmp_dir, "model")
    save_model(spark, relu_2_8_1(), model)

    runs = main(["score", "--data", data, "--model", model, "--batch", "2048", "--iterations", "2", "--count-bad",
                 "--out", os.path.join(tmp_dir, "pred"), "--out-format", "text"], spark=spark)
    assert [r.n_records for r in runs.collect()] == [6000, 6000]
    assert spark.read.text(os.path.join(tmp_dir, "pred")).count() == 6000
    out = capsys.readouterr().out
    assert "malformed records left out: 1" in out and "score: records 12000" in out

    saved = os.path.join(tmp_dir, "trained")
    runs = main(["train", "--data", data, "--model", model, "--workers", "2", "--batch", "512",
                 "--averaging", "2", "--epochs", "2", "--warmup", "0", "--save", saved], spark=spark)
    assert [r.n_records for r in runs.collect()] == [12000]
    assert load_model(spark, saved).n_params == relu_2_8_1().n_params
    again = ["train", "--data", data, "--model", model, "--workers", "2", "--batch", "512", "--averaging", "2", "--epochs", "2",
             "--journal", os.path.join(tmp_dir, "journal")]
    for name in ("one", "two"):  # the second call finds the run finished
        assert [r.n_records for r in main([*again, "--save", os.path.join(tmp_dir, name)], spark=spark).collect()] == [12000]
    one, two = (load_model(spark, os.path.join(tmp_dir, n)).params() for n in ("one", "two"))
    assert (one == two).all()

    runs = main(["score", "--data", SF001 + "/lineitem.parquet", "--format", "parquet", "--model", model,
                 "--features", "l_extendedprice,l_discount", "--method", "expr", "--iterations", "1"], spark=spark)
    assert runs.first().n_records == 6000


def test_train_job_takes_placement_settings(spark, tmp_dir):
    model = os.path.join(tmp_dir, "model")
    save_model(spark, relu_2_8_1(), model)
    data = os.path.join(tmp_dir, "li")
    net_price_records(read_table(spark, SF001, "lineitem"), keep=["l_orderkey"]).write.parquet(data)
    runs = main(["train", "--data", data, "--format", "parquet", "--features", "x1,x2", "--labels", "y", "--model", model, "--workers", "2",
                 "--batch", "512", "--averaging", "2", "--epochs", "1", "--warmup", "0", "--storage", "checkpoint", "--layout", "range",
                 "--worker-col", "l_orderkey", "--order-col", "l_orderkey"], spark=spark)
    assert runs.first().n_records == 6000
