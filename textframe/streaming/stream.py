"""Delimited text as a stream of files.

A stream has no last record to look at, so meanings and types can't be inferred: they come
from a frame loaded before, or from the caller. Lines are records (a stream's lines have
no order across files, so quoted newlines can't be joined).
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textframe.frame import values
from textframe.functions import lexing
from textframe.options import ReadOptions, input_path
from textframe.plans.infer import ColumnInfo


def read_stream(spark: SparkSession, path: str, columns: list[ColumnInfo], header: str | None = None, max_files: int = 100, **options: Any) -> DataFrame:
    """A streaming frame of the files that come into a folder. header: a line that is left out wherever it stands."""
    chosen = ReadOptions(**options)
    if chosen.allow_quoted_newlines:
        raise ValueError("a stream's records are its lines; quoted newlines can't be joined")
    raw = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(input_path(path))
    rows = raw.filter(~F.col("value").isin("", "\r"))
    if header is not None:
        rows = rows.filter(F.rtrim("value", F.lit("\r")) != header)
    n = len(columns)
    cut = lexing.number_tokens(F.col("value")) if chosen.number_only else lexing.tokens(F.col("value"))
    cells = values(rows.select(lexing.once(lexing.checked(cut, n)).alias("_t")), columns, chosen, keep=())
    return cells.select(*(F.col(f"c{i}").alias(c.name, metadata=c.metadata) for i, c in enumerate(columns)))
