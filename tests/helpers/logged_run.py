"""Timed scoring and training in a session with an event log in the folder argv[1]."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession

from parallax.fixtures import net_price_records, read_table, relu_2_8_1
from parallax.operators.examples import key_examples, to_examples
from parallax.operators.score import score_expr
from parallax.operators.train import TrainOptions
from parallax.plans.bench import bench_fit, bench_score

spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
         .config("spark.eventLog.dir", f"file://{sys.argv[1]}").config("spark.sql.shuffle.partitions", "4").getOrCreate())
ex = to_examples(net_price_records(read_table(spark, sys.argv[2], "lineitem")), ["x1", "x2"], ["y"])
bench_score(spark, score_expr(key_examples(ex), relu_2_8_1()), iterations=2, name="score: all")
bench_fit(spark, ex, relu_2_8_1(), epochs=1, iterations=1, options=TrainOptions(workers=2, batch_size=512, averaging_frequency=2), name="fit")
spark.range(10).count()  # belongs to no run
spark.stop()
