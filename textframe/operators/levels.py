"""Levels of categorical columns, numbered by first appearance, and their codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframe.plans.infer import SPARK_TYPES, code_storage
from textframe.plans.order import numbered
from textframe.plans.storage import stored

#: Bytes of levels up to which their table is broadcast.
BROADCAST_BYTES = 32 << 20


def _small(table: DataFrame) -> bool:
    """Whether a table of levels is small, by the sum of its bytes."""
    size = F.sum(F.coalesce(F.octet_length("level"), F.lit(0)).cast("long") + 16)
    return (table.agg(size).first()[0] or 0) <= BROADCAST_BYTES


def level_table(frame: DataFrame, name: str) -> DataFrame:
    """(code, level) of a column; codes follow the first appearance in the file.

    A level's first place is a partial aggregate in each task. Numbers are given split by
    split, from counts of the splits before, so no task sees all levels.
    """
    first = frame.groupBy(F.col(f"`{name}`").alias("level")).agg(F.min(F.struct("_file", "_block", "_row")).alias("p"))
    placed = stored(first.select("level", "p._file", "p._block", "p._row"), "levels")
    return numbered(placed, "code").select("code", "level")


def encoded(frame: DataFrame, name: str, table: DataFrame, levels: int) -> DataFrame:
    """frame with the column's codes in place of its texts."""
    kind = SPARK_TYPES[code_storage(levels)]
    pairs = table.select(F.col("level").alias("_level"), F.col("code").cast(kind).alias("_code"))
    same = frame[name].eqNullSafe(pairs["_level"])
    if _small(table):
        joined = frame.join(F.broadcast(pairs), same, "left")
    else:  # dealt by a hash of the level, confirmed by its text
        joined = frame.join(pairs, (F.xxhash64(frame[name]) == F.xxhash64(pairs["_level"])) & same, "left")
    meaning = {"semantics": "cat", "dtype": code_storage(levels)}
    columns = [F.col("_code").alias(c, metadata=meaning) if c == name else F.col(f"`{c}`") for c in frame.columns]
    return joined.select(*columns)


def decoded(frame: DataFrame, name: str, table: DataFrame, levels: int) -> DataFrame:
    """The opposite of `encoded`."""
    pairs = table.select(F.col("code").alias("_code"), F.col("level").alias("_level"))
    joined = frame.join(F.broadcast(pairs) if _small(table) else pairs, frame[f"`{name}`"] == pairs["_code"], "left")
    return joined.select(*[F.col("_level").alias(c) if c == name else F.col(f"`{c}`") for c in frame.columns])
