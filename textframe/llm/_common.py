"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The evaluation fold: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)) == 0


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    The setting is read from the session; only where it is unset, as in tests, a
    folder below the warehouse takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df below spark.checkpoint.dir and reads it again: lineage ends here and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def fits(table: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table's rows have at most `most` bytes, by a sum over all of them."""
    kinds = dict(table.dtypes)
    size = F.lit(16 * len(kinds))
    for name, kind in kinds.items():
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    return (table.agg(F.sum(size.cast("long"))).first()[0] or 0) <= most


def near(table: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, marked for broadcast if it fits."""
    return F.broadcast(table) if fits(table, most) else table


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key): those that have more than a quarter of an average partition's rows; so there are four for each partition at most.

    counts: a stored row for each key, with its number of rows.
    """
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(n) > max(64, total // (4 * partitions))).select(F.col(key))


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """rows with the columns of keyed (one row for each key). Rows of hot keys stay where they are and get theirs by broadcast.

    rows and keyed are stored tables. hot: of `hot_keys`, which bounds what is broadcast. Null keys match none.
    """
    few = F.broadcast(keyed.join(F.broadcast(hot), key, "left_semi"))
    marked = rows.join(F.broadcast(hot.withColumn("_hot_", F.lit(True))), key, "left")
    some = marked.filter("_hot_").drop("_hot_").join(few, key, how)
    return some.unionByName(marked.filter("_hot_ is null").drop("_hot_").join(keyed, key, how))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts and ends in them; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each has about `most` bytes of text, or a single row; whole rows, none dropped."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        block = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
