"""Runnable timed jobs: what ``spark-submit`` launches.

    spark-submit --py-files parallax.zip parallax/plans/jobs.py score \\
        --data hdfs:///data/set.csv --model hdfs:///models/net --batch 8192 --iterations 50
    spark-submit --py-files parallax.zip parallax/plans/jobs.py train \\
        --data hdfs:///data/set.csv --model hdfs:///models/net --workers 4 --batch 2048 \\
        --averaging 5 --epochs 50 --iterations 10 --warmup 5 --save hdfs:///models/net-trained

Data is delimited text (``--format csv``: all-numeric columns, features first,
then ``--labels`` label columns; ``--header`` drops each file's first line;
malformed lines are left out, and counted with ``--count-bad``) or Parquet (``--format parquet``
with ``--features`` / ``--labels`` column names).  The session comes from
``SparkSession.builder.getOrCreate()``: master, executors and
``spark.checkpoint.dir`` are ``spark-submit`` settings.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from parallax.operators.examples import DEFAULT_KEY, key_examples, split_by_position, to_examples
from parallax.operators.score import score
from parallax.operators.train import TrainOptions, fit
from parallax.plans.bench import BENCH_RUNS_SCHEMA, bench_fit, bench_score, summarise_runs
from parallax.sources.csv import bad_records, good_records, read_records
from parallax.sources.model_store import load_model, save_model
from parallax.sources.sinks import write_predictions


# The timed jobs' default settings.
SCORE_BATCH = 8192
SCORE_ITERATIONS = 50
TRAIN_BATCH_PER_WORKER = 2048
TRAIN_AVERAGING_FREQUENCY = 5
TRAIN_EPOCHS = 50
TRAIN_WARMUP = 5
TRAIN_WORKERS = 4


def load_examples(spark: SparkSession, args) -> DataFrame:
    if args.format == "parquet":
        if not args.features:
            raise SystemExit("--features is required for parquet input")
        if args.job == "train" and not args.labels:
            raise SystemExit("--labels (label column names) is required to train on parquet input")
        labels = args.labels.split(",") if args.labels else None
        keep = list(dict.fromkeys(c for c in (getattr(args, "worker_col", None), getattr(args, "order_col", None)) if c))
        return to_examples(spark.read.parquet(args.data), args.features.split(","), labels, keep=keep)
    if getattr(args, "worker_col", None) or getattr(args, "order_col", None):
        raise SystemExit("--worker-col and --order-col name columns of parquet input")
    checked = read_records(spark, args.data, args.columns, sep=args.sep, header=args.header)
    if args.count_bad:  # one extra pass over the input, so only on request
        print(f"malformed records left out: {bad_records(checked).count()}")
    n_labels = int(args.labels or 1)
    return split_by_position(good_records(checked), label_index=args.columns - n_labels, num_labels=n_labels)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parallax.plans.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("score", "train"):
        s = sub.add_parser(name)
        s.add_argument("--data", required=True)
        s.add_argument("--model", required=True, help="weights table written by save_model")
        s.add_argument("--format", choices=["csv", "parquet"], default="csv")
        s.add_argument("--columns", type=int, default=3, help="csv: fields per line")
        s.add_argument("--sep", default=",")
        s.add_argument("--header", action="store_true", help="csv: drop each file's first line")
        s.add_argument("--count-bad", action="store_true", help="csv: report malformed lines (an extra pass)")
        s.add_argument("--features", help="parquet: comma-separated feature columns")
        s.add_argument("--labels", help="csv: number of trailing label columns (default 1); parquet: names")
        s.add_argument("--iterations", type=int, default=None,
                       help=f"timed repetitions (default: {SCORE_ITERATIONS} for score, 1 for train)")
    s = sub.choices["score"]
    s.add_argument("--batch", type=int, default=SCORE_BATCH)
    s.add_argument("--key", default=DEFAULT_KEY)
    s.add_argument("--method", choices=["auto", "expr", "batched"], default="auto")
    s.add_argument("--out", help="write predictions here (fails if it exists)")
    s.add_argument("--out-format", choices=["parquet", "csv", "text"], default="parquet")
    t = sub.choices["train"]
    t.add_argument("--workers", type=int, default=TRAIN_WORKERS)
    t.add_argument("--batch", type=int, default=TRAIN_BATCH_PER_WORKER)
    t.add_argument("--averaging", type=int, default=TRAIN_AVERAGING_FREQUENCY,
                   help="minibatches between averagings; 0 = once per epoch")
    t.add_argument("--lr", type=float, default=0.1)
    t.add_argument("--epochs", type=int, default=TRAIN_EPOCHS)
    t.add_argument("--warmup", type=int, default=TRAIN_WARMUP, help="untimed warm-up iterations of --epochs each")
    t.add_argument("--seed", type=int, default=12345)
    t.add_argument("--storage", choices=["persist", "checkpoint"], default="persist", help="where the placed rows live")
    t.add_argument("--layout", choices=["auto", "worker", "range"], default="auto")
    t.add_argument("--worker-col", help="parquet: integer column that names each row's worker (default: a hash of the row)")
    t.add_argument("--order-col", help="parquet: column that orders a worker's rows (default: shuffled by a hash)")
    t.add_argument("--journal", help="folder on shared storage that keeps the run's progress: one untimed fit that goes on after the "
                                     "last round noted there (no warm-up, one iteration)")
    t.add_argument("--save", help="write the trained weights table here")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Run one job; prints its summary and returns the ``bench_runs`` rows."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    model = load_model(spark, args.model)
    examples = load_examples(spark, args)
    if args.job == "score":
        scored = score(key_examples(examples, args.key), model, batch_size=args.batch, method=args.method)
        runs = bench_score(spark, scored, iterations=args.iterations or SCORE_ITERATIONS, name="score")
        if args.out:
            write_predictions(scored, args.out, fmt=args.out_format, width=model.n_outputs)
    else:
        opts = TrainOptions(workers=args.workers, batch_size=args.batch,
                            averaging_frequency=args.averaging or None, learning_rate=args.lr, seed=args.seed,
                            storage=args.storage)
        if args.journal:
            t0 = time.perf_counter_ns()
            model, history = fit(examples, model, args.epochs, opts, args.worker_col, args.order_col, layout=args.layout, journal=args.journal)
            runs = spark.createDataFrame([("train", 0, sum(e["rows"] for e in history), time.perf_counter_ns() - t0)], BENCH_RUNS_SCHEMA)
        else:
            runs, model, history = bench_fit(spark, examples, model, epochs=args.epochs, iterations=args.iterations or 1,
                                             warmup=args.warmup, options=opts, name="train",
                                             worker_col=args.worker_col, order_col=args.order_col, layout=args.layout)
        if history:
            print(f"last epoch loss: {history[-1]['loss']}")
        if args.save:
            save_model(spark, model, args.save)
    for r in summarise_runs(runs).collect():
        print(f"{r['name']}: records {r['n_records']}, total ms {r['total_ms']}, "
              f"mean ns per record {r['mean_ns_per_record']}")
    return runs


if __name__ == "__main__":
    main(sys.argv[1:])
