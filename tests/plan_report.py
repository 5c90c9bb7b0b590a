"""Print the physical plans of the main operators (markdown), e.g.

    python tests/plan_report.py /root/testdata/sf0.01 > PLANS.md
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(sf_dir: str) -> None:
    from parallax.fixtures import net_price_records, read_table, relu_2_3_1, relu_2_8_1
    from parallax.operators.examples import key_examples, split_by_position, to_examples
    from parallax.operators.score import score_batched, score_expr
    from parallax.operators.train import TrainOptions, assign_workers, fit_round, place
    from parallax.plans.catalog import QUERIES
    from parallax.session import local_session, scratch_path
    from parallax.sources.csv import good_records, read_records

    spark = local_session(8)
    li = read_table(spark, sf_dir, "lineitem")
    ex = to_examples(net_price_records(li), ["x1", "x2"], ["y"])
    keyed = key_examples(ex)
    csv_path = scratch_path(spark, "plans-csv")
    net_price_records(li).write.csv(csv_path)
    opts = TrainOptions(workers=4, batch_size=2048, averaging_frequency=5)
    placed = place(ex, opts, n_inputs=2, n_outputs=1)
    ranged = place(ex, opts, n_inputs=2, n_outputs=1, layout="range")
    cases = [
        ("Scoring as expressions (O10-O14a)", score_expr(keyed, relu_2_3_1())),
        ("Scoring through Arrow batches (O14b)", score_batched(keyed, relu_2_8_1(), 8192)),
        ("CSV text -> good records -> examples -> scored (O1, O2, O10-O14)",
         score_expr(key_examples(split_by_position(good_records(read_records(spark, csv_path, 3)), 2)),
                    relu_2_3_1())),
        ("Worker placement, worker layout (O16, O17, O25)", assign_workers(ex, 4, 2048, 5, layout="worker")),
        ("Worker placement, range layout, hashed order (O16, O17, O25)",
         assign_workers(ex, 4, 2048, 5, layout="range", num_partitions=8)),
        ("One training round, worker layout (O15)", fit_round(placed[0], relu_2_8_1(), 3, 0.1)),
        ("One training round, range layout (O15)", fit_round(ranged[0], relu_2_8_1(), 3, 0.1, workers=4)),
        ("Parameter averaging (O18)", QUERIES["average_parameters"](spark, sf_dir)),
        ("Partitioned write read back (O25)", QUERIES["partition_write"](spark, sf_dir)),
    ]
    print("# Physical plans\n")
    print(f"Generated by `tests/plan_report.py` on `{sf_dir}` (local[8], AQE on unless noted).\n")
    for title, df in cases:
        print(f"## {title}\n\n```")
        print(df._jdf.queryExecution().executedPlan().toString().rstrip())
        print("```\n")
    placed.release()
    ranged.release()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
