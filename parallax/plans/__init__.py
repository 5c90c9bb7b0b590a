"""Timed jobs and summaries, plan inspection, the registered query catalog."""

from parallax.plans.bench import bench_fit, bench_score, count_predictions, run_pass, summarise_runs

__all__ = ["bench_fit", "bench_score", "count_predictions", "run_pass", "summarise_runs"]
