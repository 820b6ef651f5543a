"""Document fingerprints: quartile bucket digests.

Every three bytes in a row are hashed into one of 128 buckets. A bucket's code says in
which quarter its count falls among the text's 128 counts, two bits each. In front stand
a check byte (of equal texts only), a logarithmic length and the ratios of the quartiles.
The difference of two digests adds up differences of codes, of length and of ratios, and
is bounded by LARGEST; likeness is one less the share of the bound that it reaches.

Null texts count as empty. Empty texts, and those under three bytes, have equal buckets.
Equal texts have equal fingerprints and likeness 1. Ids must be whole numbers, of any size.
Documents are put in order by id, then text; a null id comes first; a repeated row is
followed by its copy. Ranges of rows are laid by id and the first BEGIN bytes of the text,
so an id that many rows share is split too. An empty table gives no rows. Columns other
than the two named are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 128
LARGEST = 256
#: Bytes of a text that tell rows of one id apart when ranges are laid.
BEGIN = 64
_HEAD = 3
_WEIGHT = np.array([0, 1, 2, 4])


def digest(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of 35 bytes for each text. raw, offsets: bytes of the texts, and where they start and end."""
    n, size = len(offsets) - 1, np.diff(offsets)
    counts = np.zeros((n, BUCKETS), np.int64)
    if len(raw) >= 3:
        wide = raw.astype(np.uint32)
        hashed = wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA77) + wide[2:] * np.uint32(0xC2B2AE3D)
        hashed ^= hashed >> np.uint32(15)
        hashed = (hashed * np.uint32(0x2C1B3C6D)) >> np.uint32(25)
        row = np.repeat(np.arange(n), size)
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * BUCKETS + hashed[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    q = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1), axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts[:, :, None] > q[:, None, :]).sum(2).astype(np.uint8)
    body = codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6
    check = np.array([int(raw[a:b].sum(dtype=np.int64)) % 251 for a, b in zip(offsets, offsets[1:], strict=False)])
    length = np.minimum(255, np.round(np.log1p(size) * 12))
    ratio = np.minimum(15, 16 * q[:, :2] // np.maximum(1, q[:, 2:]))
    return np.concatenate([np.stack([check, length, ratio[:, 0] * 16 + ratio[:, 1]], 1).astype(np.uint8), body.astype(np.uint8)], 1)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bounded difference of rows of digests."""
    x, y = a[:, _HEAD:], b[:, _HEAD:]
    d = sum(_WEIGHT[np.abs((x >> s & 3).astype(int) - (y >> s & 3))].sum(1) for s in (0, 2, 4, 6))
    head = np.abs(a[:, :_HEAD].astype(int) - b[:, :_HEAD])
    d = d + np.minimum(24, np.maximum(0, head[:, 1] - 1)) + np.abs((a[:, 2] >> 4).astype(int) - (b[:, 2] >> 4)) + np.abs((a[:, 2] & 15).astype(int) - (b[:, 2] & 15)) + (head[:, 0] > 0)
    return np.minimum(LARGEST, d)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - difference(a, b) / LARGEST


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes().hex() for x in rows], pa.string())


def _unhex(column: pa.Array) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column.to_pylist())), np.uint8).reshape(len(column), -1)


def _starts(docs: DataFrame, id_col: str, text_col: str, n: int, rows: int) -> list[tuple[int, int, bytes]]:
    """Keys of rows, evenly spread, where ranges begin: (0 for a null id, id, first BEGIN bytes of the text).

    They are those of about 16 n of the rows, told by a hash, so what reaches the driver is bounded.
    """
    keys = docs.select(F.col(id_col).alias("id"), F.substring(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 1, BEGIN).alias("begin"))
    hashed = F.pmod(F.xxhash64("id", "begin", F.monotonically_increasing_id()), F.lit(1 << 40))
    some = keys.filter(hashed < min(1 << 40, (16 * n << 40) // rows)).collect()
    found = sorted((int(i is not None), i or 0, bytes(x)) for i, x in some)
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def _placed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, again, id, text, fingerprint): ranges of rows by id and text, each followed by the first row of the next (again = 1).

    The ranges begin at keys of rows of the table, so which rows may be the first of one is
    known beforehand; of several with one key each part of a task sends the smallest. The last range is
    followed by the first row of all, which begins a range of its own.
    """
    n = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", F.substring(F.col("text").cast("binary"), 1, BEGIN).alias("begin"))).alias("x"), F.count(F.lit(1)).alias("n")).first()
    first, rows = first
    starts = sorted({*_starts(docs, id_col, text_col, n, rows), (int(first["known"]), first["id"] or 0, bytes(first["begin"]))}) if first else []
    last = max(0, len(starts) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts, utf8

        for batch in parts(batches, "text"):
            raw, offsets = utf8(batch.column("text"))
            keys = [(int(i is not None), i or 0, raw[a : min(a + BEGIN, b)].tobytes()) for i, a, b in zip(batch.column("id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            bucket = np.array([bisect_right(starts, x) - 1 for x in keys], np.int32)
            head: dict[int, int] = {}
            for i in [i for i, (k, x) in enumerate(zip(bucket.tolist(), keys, strict=True)) if starts[k] == x]:
                k = int(bucket[i])
                if k not in head or raw[offsets[i] : offsets[i + 1]].tobytes() < raw[offsets[head[k]] : offsets[head[k] + 1]].tobytes():
                    head[k] = i
            take = pa.array([*range(len(keys)), *head.values()])
            place = np.concatenate([bucket, np.array([k - 1 if k else last for k in head], np.int32)])
            again = np.repeat([0, 1], [len(keys), len(head)]).astype(np.int8)
            prints = _hex(digest(raw, offsets))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(again), batch.column("id").take(take), batch.column("text").take(take), prints.take(take)], ["bucket", "again", "id", "text", "fingerprint"])

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("again", T.ByteType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("text", T.StringType()), T.StructField("fingerprint", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) for each row of docs, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts, utf8

        for batch in parts(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _hex(digest(*utf8(batch.column("text"))))], ["id", "fingerprint"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint, next_fingerprint, edited): each text with its last quarter replaced from the next text.

    One shuffle of the texts, by range of ids.
    """
    order = Window.partitionBy("bucket").orderBy("again", "id", "text")
    rows = _placed(docs, id_col, text_col).withColumns({"after": F.lead("text").over(order), "next_fingerprint": F.lead("fingerprint").over(order)})
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    text = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("after", F.lit(1), cut))
    return rows.filter("again = 0").select("id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", text.alias("edited"))


def report(docs: DataFrame) -> DataFrame:
    """What op1 returns."""
    rows = edited(docs).withColumn("edited_sha256", F.sha2("edited", 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts, utf8

        for batch in parts(batches, "edited"):
            own, after = _unhex(batch.column("fingerprint")), _unhex(batch.column("next_fingerprint"))
            new = digest(*utf8(batch.column("edited")))
            kept = [batch.column(x) for x in ("id", "n_chars", "edited_sha256", "fingerprint")]
            yield pa.RecordBatch.from_arrays([*kept, _hex(new), pa.array(likeness(own, new)), pa.array(likeness(own, after))], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", "doc_id")


def texts(docs: DataFrame) -> DataFrame:
    """The columns of op1 that SQL can say: (doc_id, n_chars, edited_sha256)."""
    return edited(docs).select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"))


TEXTS_SQL = """
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(left(t, n - n // 4) || left(after, n // 4)) AS edited_sha256
FROM (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER w, first_value(t) OVER w) AS after
      FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (ORDER BY doc_id NULLS FIRST, t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
"""
