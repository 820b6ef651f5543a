"""Delimited text to typed DataFrames and back, on Spark."""

from textframe.frame import (
    TextFrame,
    get_num_cores,
    load_csv_as_iterator,
    load_csv_to_dict,
    load_csv_to_expanded_columns,
    load_csv_to_pandas,
    load_raw_csv,
    read_csv,
)
from textframe.operators.diagnostics import baseline_average_columns, baseline_disk_to_mem, baseline_newline_count
from textframe.options import ReadOptions, WriteOptions
from textframe.sources.writer import save_frame, write_frame, write_parts

__all__ = [
    "ReadOptions",
    "TextFrame",
    "WriteOptions",
    "baseline_average_columns",
    "baseline_disk_to_mem",
    "baseline_newline_count",
    "get_num_cores",
    "load_csv_as_iterator",
    "load_csv_to_dict",
    "load_csv_to_expanded_columns",
    "load_csv_to_pandas",
    "load_raw_csv",
    "read_csv",
    "save_frame",
    "write_frame",
    "write_parts",
]
