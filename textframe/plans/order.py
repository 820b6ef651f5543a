"""Places of rows in the order of the files, without sorting everything in one task.

A row's position is (_file, _block, _row): its file, where its split begins, and a number
that grows within the split. Numbers over all rows come in two steps: sums for each split,
added up over the splits (few rows), then a window within each split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITION = ("_file", "_block", "_row")
#: Splits up to which their table is broadcast (some 100 bytes each).
BROADCAST_SPLITS = 200_000


def quoted(name: str) -> str:
    """A column's name as Spark's expressions take it."""
    return "`" + name.replace("`", "``") + "`"


def near(df: DataFrame, rows: int, most: int = BROADCAST_SPLITS) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def in_order(df: DataFrame) -> DataFrame:
    """Sorted as in the files."""
    return df.orderBy(*POSITION)


def numbered(df: DataFrame, name: str = "_n") -> DataFrame:
    """df with each row's number, from 0, in file order."""
    each = df.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_size"))
    over = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    before = each.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), F.coalesce(F.sum("_size").over(over), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_file", "_block").orderBy("_row")) - 1
    joined = df.join(before, (df["_file"] == before["_f"]) & (df["_block"] == before["_b"]))
    return joined.withColumn(name, (F.col("_before") + within).cast("long")).drop("_f", "_b", "_before")
