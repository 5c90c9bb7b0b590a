"""Examples and keying, scoring, worker placement, training, partitioning."""

from parallax.operators.examples import features_only, key_examples, split_by_position, to_examples
from parallax.operators.partition import balanced_partitions, partition_dataset, write_partitioned
from parallax.operators.row_ids import with_dense_id
from parallax.operators.score import score, score_batched, score_expr
from parallax.operators.train import (
    TrainOptions,
    assign_workers,
    average_blocks,
    average_parameters,
    fit,
    fit_paths,
    fit_round,
    place,
    place_files,
    write_minibatches,
)

__all__ = [
    "TrainOptions", "assign_workers", "average_blocks", "average_parameters", "balanced_partitions", "features_only", "fit",
    "fit_paths", "fit_round", "key_examples", "partition_dataset", "place", "place_files", "score", "score_batched", "score_expr",
    "split_by_position", "to_examples", "with_dense_id", "write_minibatches", "write_partitioned",
]
