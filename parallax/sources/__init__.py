"""Text lines, delimited records with a bad-record split, the model table, sinks."""

from parallax.sources.csv import bad_records, good_records, parse_lines, read_records, split_records
from parallax.sources.model_store import load_model, model_from_df, model_to_df, save_model
from parallax.sources.sinks import show_predictions, write_predictions
from parallax.sources.text import read_lines

__all__ = [
    "bad_records", "good_records", "load_model", "model_from_df", "model_to_df", "parse_lines",
    "read_lines", "read_records", "save_model", "show_predictions", "split_records", "write_predictions",
]
