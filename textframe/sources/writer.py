"""Writing frames as delimited text."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textframe.functions.escapes import escape, escape_text
from textframe.options import WriteOptions, input_path


def _cell(name: str, place: str, kind: T.DataType, options: WriteOptions) -> Column:
    """A value as it stands in the file: texts in quotes, numbers without. place: the column's own name in a frame of places."""
    value = F.col(place)
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.initcap(value.cast("string")), F.lit("nan"))
    if isinstance(kind, T.FloatType | T.DoubleType):
        text = F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).otherwise(value.cast("string"))
        return F.coalesce(text, F.lit("nan"))
    if isinstance(kind, T.NumericType):
        return F.coalesce(value.cast("string"), F.lit("nan"))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        raise ValueError(f"column {name} is nested and can't be written as delimited text")
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.concat(F.lit('"'), escape(text, options.out_encoding, not options.allow_quoted_newlines), F.lit('"'))


def header_line(names: list[str], options: WriteOptions) -> bytes:
    return b",".join(b'"' + escape_text(n, options) + b'"' for n in names) + (b"\r" if options.dos else b"")


def placed(frame: DataFrame) -> DataFrame:
    """frame with its columns named by their places, so that names may repeat and hold any character."""
    return frame.toDF(*(f"c{i}" for i in range(len(frame.columns))))


def line(frame: DataFrame, options: WriteOptions) -> Column:
    """The line of a row of `placed(frame)`."""
    cells = [_cell(f.name, f"c{i}", f.dataType, options) for i, f in enumerate(frame.schema.fields)]
    return F.concat(F.concat_ws(",", *cells), F.lit("\r")) if options.dos else F.concat_ws(",", *cells)


def _frame(spark: SparkSession, frame: Any) -> DataFrame:
    """Spark frames as they are; pandas frames and mappings from names to sequences through pandas."""
    if isinstance(frame, DataFrame):
        return frame
    import pandas as pd

    if not isinstance(frame, pd.DataFrame):
        if not hasattr(frame, "keys"):
            raise TypeError("a frame has keys() and gives a sequence for each of them")
        frame = pd.DataFrame({k: pd.Series(list(frame[k]), dtype=getattr(frame[k], "dtype", None)) for k in frame.keys()})
    if not len(frame.columns):
        return spark.createDataFrame([], T.StructType([]))
    fields, columns = [], {}
    for name in frame.columns:
        values = frame[name]
        if values.dtype == object:
            kind = T.BinaryType() if any(isinstance(x, bytes | bytearray) for x in values) else T.StringType()
            if isinstance(kind, T.BinaryType):
                values = values.map(lambda x: x.encode() if isinstance(x, str) else x)
        elif values.dtype.kind == "u":
            kind = T.LongType() if values.dtype.itemsize < 8 else T.DecimalType(20, 0)
        elif values.dtype.kind == "i":
            kind = T.LongType()
        elif values.dtype.kind == "f":
            kind = T.FloatType() if values.dtype.itemsize <= 4 else T.DoubleType()
        elif values.dtype.kind == "b":
            kind = T.BooleanType()
        else:
            kind = T.StringType()
        columns[name] = values.astype(object).tolist()
        fields.append(T.StructField(str(name), kind))
    import decimal

    convert = [decimal.Decimal if isinstance(f.dataType, T.DecimalType) else (lambda x: x) for f in fields]
    rows = [tuple(c(x) for c, x in zip(convert, row, strict=True)) for row in zip(*columns.values(), strict=True)]
    return spark.createDataFrame(rows, T.StructType(fields))


def write_parts(frame: DataFrame, path: str, **options: Any) -> None:
    """Writes a folder of files, each with the header: the way for large frames. No shuffle. A frame without rows is a header."""
    chosen = WriteOptions(**options)
    head = F.lit(header_line(frame.columns, chosen)).cast("string")
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # a partition's first row
    text = line(frame, chosen)
    rows = placed(frame).select(F.when(first, F.concat(head, F.lit("\n"), text)).otherwise(text).alias("value"))
    rows.write.option("lineSep", "\n").text(input_path(path))
    spark = frame.sparkSession
    if frame.columns and spark.read.text(input_path(path)).isEmpty():  # no row to put a header before
        spark.range(1).coalesce(1).select(head.alias("value")).write.mode("append").option("lineSep", "\n").text(input_path(path))


def save_frame(path: str, frame: Any, allow_quoted_newlines: bool = True, out_encoding: str = "arbitrary", dos: bool = False, spark: SparkSession | None = None) -> None:
    """Writes a folder with one file, rows in the frame's order. All rows pass through one task; see `write_parts`."""
    chosen = WriteOptions(allow_quoted_newlines, out_encoding, dos)
    spark = spark or (frame.sparkSession if isinstance(frame, DataFrame) else SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
    frame = _frame(spark, frame)
    if not frame.columns:
        spark.createDataFrame([], "value string").write.text(input_path(path))
        return
    rows = placed(frame).select(F.monotonically_increasing_id().alias("_n"), line(frame, chosen).alias("value"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("_n"), F.lit(header_line(frame.columns, chosen)).cast("string").alias("value"))
    rows.union(head).repartition(1).sortWithinPartitions("_n").select("value").write.option("lineSep", "\n").text(input_path(path))


write_frame = save_frame
