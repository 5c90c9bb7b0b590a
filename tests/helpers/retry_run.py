"""Train twice in a session that allows task retries (local[4,2]); the second
run's input fails once in one task and is retried.  Prints both parameter
vectors' max difference and whether a failure was injected."""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import SparkSession  # noqa: E402

from parallax.fixtures import net_price_records, read_table, relu_2_8_1  # noqa: E402
from parallax.operators.examples import to_examples  # noqa: E402
from parallax.operators.train import TrainOptions, fit  # noqa: E402

spark = (SparkSession.builder.master("local[4,2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
         .getOrCreate())
spark.sparkContext.setLogLevel("OFF")
layout = sys.argv[1]
marker = os.path.join(tempfile.mkdtemp(prefix="parallax-retry-"), "failed-once")
li = read_table(spark, "/root/testdata/sf0.001", "lineitem").repartition(3)
ex = to_examples(net_price_records(li), ["x1", "x2"], ["y"])


def fail_once(batches):
    from pyspark import TaskContext

    for pdf in batches:
        ctx = TaskContext.get()
        if ctx.partitionId() == 1 and not os.path.exists(marker):
            open(marker, "w").close()
            raise RuntimeError("injected task failure")
        yield pdf


flaky = ex.mapInPandas(fail_once, ex.schema)
opts = TrainOptions(workers=2, batch_size=128, averaging_frequency=3, learning_rate=0.2)
m_ok, _ = fit(ex, relu_2_8_1(), 2, opts, layout=layout)
m_retry, _ = fit(flaky, relu_2_8_1(), 2, opts, layout=layout)
print("RESULT", float(abs(m_ok.params() - m_retry.params()).max()), os.path.exists(marker))
