"""Whole-file baselines: line ends, raw scans, averages and sums of columns; comparing frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textframe.functions import classify
from textframe.options import ReadOptions, input_path
from textframe.plans.order import POSITION, numbered, quoted
from textframe.plans.storage import stored
from textframe.sources.header import find_header, without_header
from textframe.sources.records import lines, text_files


def _sizes(spark: SparkSession, path: str) -> DataFrame:
    """(n, size, length) for each file: its lines, their bytes with a line end each, and the file's bytes."""
    raw = spark.read.option("lineSep", "\n").text(input_path(path)).select(F.octet_length("value").alias("size"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("length"))
    return raw.groupBy("file", "length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size").cast("long") + 1).alias("size"))


def newline_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row (newlines): LF bytes. A file's last line has none if its lines add up to a byte more than the file."""
    return _sizes(spark, path).agg(F.coalesce(F.sum(F.col("n") - (F.col("size") > F.col("length")).cast("long")), F.lit(0)).cast("long").alias("newlines"))


def byte_counts(spark: SparkSession, path: str) -> DataFrame:
    """One row (bytes): all bytes, each of them read."""
    return _sizes(spark, path).agg(F.coalesce(F.sum(F.least("size", "length")), F.lit(0)).cast("long").alias("bytes"))


def column_averages(spark: SparkSession, path: str, type_check: bool = False, **options: Any) -> DataFrame:
    """One row: the sum of each column over the number of lines, blank ones too. Quotes and escapes are not known here.

    type_check: `?` and `nan` are NaN, whole numbers and floats are read as such, and an empty or
    blank cell counts its length. Without it, a cell is the number it begins with, and NaN if empty.
    """
    chosen = ReadOptions(**options)
    found = lines(spark, input_path(path))
    files = text_files(spark, input_path(path))
    header = find_header(lambda file: lines(spark, file), files, chosen)
    if not header.names:
        return spark.range(1).select()
    rows = without_header(found, header, files)
    cells = F.split(F.replace("value", F.lit("\r"), F.lit("")), ",", -1)
    blank = F.col("value").isin("", "\r")
    # cells below each other: one expression however many columns, and a row for each column from each task
    each = rows.select(F.posexplode_outer(F.when(~blank, cells)).alias("i", "t"))
    text, kind = F.col("t"), F.col("kind")
    if type_check:
        each = each.select("i", "t", classify.cell_class(text).alias("kind"))
        value = F.when(kind == "missing", F.lit(float("nan"))).when(kind == "empty", F.length(text).cast("double")).when(kind == "integer", classify.double_value(text)).otherwise(classify.lenient_double(text))
    else:
        value = classify.lenient_double(text)
    sums = each.groupBy("i").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    at, lines_read = F.col("i"), F.sum(F.when(F.coalesce(F.col("i"), F.lit(0)) == 0, F.col("n")))
    return sums.agg(*((F.max(F.when(at == i, F.col("s"))) / lines_read).alias(name) for i, name in enumerate(header.names)))


def baseline_newline_count(filename: str, **options: Any) -> int:
    """LF bytes of a file."""
    ReadOptions(**options)
    return newline_counts(_session(), filename).first()[0]


def baseline_average_columns(filename: str, type_check: bool = False, **options: Any) -> dict[str, float]:
    """The mean of each column by name."""
    row = column_averages(_session(), filename, type_check, **options).first()
    return row.asDict()


def baseline_disk_to_mem(filename: str, **options: Any) -> None:
    """Reads every byte and returns nothing."""
    ReadOptions(**options)
    _session().read.option("lineSep", "\n").text(input_path(filename)).write.format("noop").mode("overwrite").save()


def column_sums(frame: DataFrame) -> DataFrame:
    """One row: sums of numbers (as double, whole numbers as bigint) and of the byte lengths of texts."""
    kinds = dict(frame.dtypes)
    each = []
    for name in frame.columns:
        column = F.col(quoted(name))
        if kinds[name] in ("string", "binary"):
            each.append(F.sum(F.octet_length(column)).alias(name))
        else:
            each.append(F.sum(column.cast("double" if kinds[name] in ("float", "double") else "long")).alias(name))
    return frame.agg(*each)


def compare_frames(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: for numeric columns the largest absolute difference, for others the share of rows that differ.

    a and b have the same columns and the position columns of loaded frames; rows are matched by
    their number in file order. Both are kept below spark.checkpoint.dir, so that counting rows doesn't load them again.
    """
    names = [c for c in a.columns if c not in POSITION]
    kinds = dict(a.dtypes)
    each = lambda of, x: (F.col(quoted(c)).alias(f"{x}{i}") for i, c in enumerate(names))
    left = numbered(stored(a.select(*POSITION, *each(a, "l")), "compared"))
    right = numbered(stored(b.select(*POSITION, *each(b, "r")), "compared"), "_m").drop(*POSITION)
    both = left.join(right, left["_n"] == right["_m"], "full")
    each = []
    for i, name in enumerate(names):
        x, y = F.col(f"l{i}"), F.col(f"r{i}")
        if kinds[name] in ("string", "binary"):
            each.append(F.avg((~x.eqNullSafe(y)).cast("double")).alias(name))
        else:
            x, y = x.cast("double"), y.cast("double")
            each.append(F.max(F.when(x.eqNullSafe(y) | (F.isnan(x) & F.isnan(y)), 0.0).otherwise(F.coalesce(F.abs(x - y), F.lit(float("inf"))))).alias(name))
    return both.agg(*each)


def compare_with_pandas(filename: str, **options: Any) -> DataFrame:
    """`compare_frames` of a file as this library loads it and as pandas reads it; for files that pandas can hold.

    Numeric columns are compared as numbers, with 0 for pandas' empty cells and NaN for `?`; others by their text.
    """
    import pandas as pd

    from textframe.frame import read_csv

    spark = _session()
    mine = read_csv(spark, filename, **options)
    theirs = pd.read_csv(filename, dtype=str, keep_default_na=False, escapechar="\\")
    number = lambda c: pd.to_numeric(c.str.strip().replace({"": "0", "?": "nan"}), errors="coerce")
    columns = [theirs.iloc[:, i] if c.dtype == "string" else number(theirs.iloc[:, i]).astype("float32" if c.dtype == "float" else float) for i, c in enumerate(mine.columns)]
    rows = [(filename, 0, i, *row) for i, row in enumerate(zip(*(c.tolist() for c in columns), strict=True))]
    kinds = ", ".join(f"c{i} {'string' if c.dtype == 'string' else 'double'}" for i, c in enumerate(mine.columns))
    other = spark.createDataFrame(rows, f"_file string, _block bigint, _row bigint, {kinds}")
    return compare_frames(mine.placed(), other).toDF(*mine.names)


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
