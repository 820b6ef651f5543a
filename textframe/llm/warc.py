"""Web archives (WARC 1.1) compressed record by record with a dictionary of their own.

Each task writes archives of a bounded size. For each it builds a Zstandard dictionary from
the first records (at most SAMPLE_BYTES of them, a bound that does not grow with the
archive), puts it into a leading skippable frame, and compresses every record alone against
it, so a reader can begin at any record. Archives go through Spark's own text sink, so they
are committed like any other output and need no local disk: a row is the frames of records
of about ROW_BYTES, and the head of a one-byte skippable frame, whose byte is the line end
that the sink adds. The sink begins a new file after ROWS rows, and so does the writer with
a new dictionary, so an archive has at most ROWS x (ROW_BYTES + one record) bytes, and a
reader's task holds one at a time. Files keep the sink's part names.

Of records with equal payloads of at least LEAST bytes the one with the smallest page_id
is a response and the others are revisits that refer to it, without a payload of their
own; shorter payloads are always responses. Only payload digests are compared between
records, never payloads. The table of repeated digests is broadcast while its measured bytes
are few; beyond that, the digests that many pages share still are (there are few of them
by their bound), so no payload of a hot digest is shuffled.

Null payloads count as empty, null urls are left out, null ids are never referred to (if all
of a group are null, all are responses) and have a record id of their own form, apart from an
empty id. Rows that share the smallest id of their group are all responses. A record of any
length up to 2 GB is one frame. An empty table writes no record and reads back empty.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textframe.llm._common import BROADCAST_BYTES, fits, hot_keys, shared_dir, spread_join, stored

LEAST = 100
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
ROW_BYTES = 256 << 10
ROWS = 256
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the formats.
_DICTIONARY, _PADDING = 0x184D2A5D, 0x184D2A50
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID, _NO_ID = "urn:page:", "urn:page-without-id"
_CHUNK = 1 << 16


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to) for each row; refers_to is null for responses."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    repeated = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = stored(repeated.filter("n > 1 and first is not null"), "payloads")
    firsts = repeated.select("payload_digest", "first")
    if fits(firsts, broadcast):
        rows = rows.join(F.broadcast(firsts), "payload_digest", "left")
    else:
        rows = spread_join(rows, firsts, "payload_digest", hot_keys(repeated, "payload_digest"))
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", other.alias("refers_to"))


def record(page_id: str | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None) -> bytes:
    """One WARC record."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_NO_ID if page_id is None else _ID + page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]):
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
    except zstandard.ZstdError:  # too few records to train on; their content serves as it is
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _dictionary_for(records: list[bytes]):
    sample, used = [], 0
    for x in records:  # what one record adds is bounded too
        sample.append(x[: 64 << 10])
        used += len(sample[-1])
        if used >= SAMPLE_BYTES:
            break
    return _dictionary(sample)


class _Archives:
    """Records in, rows of frames out; a new dictionary after each `rows` rows."""

    def __init__(self, rows: int):
        self.most, self.n, self.press = rows, 0, None
        self.waiting: list[bytes] = []
        self.row: list[bytes] = []
        self.size = 0
        self.out: list[bytes] = []

    def add(self, record: bytes) -> None:
        if self.press:
            return self._write(record)
        self.waiting.append(record)
        self.size += len(record)
        if self.size >= SAMPLE_BYTES:
            self.begin()

    def begin(self) -> None:
        """A new archive, with the records that have waited for its dictionary."""
        import zstandard

        words = _dictionary_for(self.waiting)
        self.press = zstandard.ZstdCompressor(dict_data=words, level=3, write_checksum=True)
        content = words.as_bytes()
        self.row = [struct.pack("<II", _DICTIONARY, len(content)) + content]
        self.end_row()
        waiting, self.waiting = self.waiting, []
        for x in waiting:
            self.add(x)

    def _write(self, record: bytes) -> None:
        self.row.append(self.press.compress(record))
        self.size += len(self.row[-1])
        if self.size >= ROW_BYTES:
            self.end_row()

    def end_row(self) -> None:
        self.out.append(b"".join(self.row) + struct.pack("<II", _PADDING, 1))
        self.row, self.size, self.n = [], 0, self.n + 1
        if self.n == self.most:
            self.n, self.press = 0, None

    def finish(self) -> None:
        if self.waiting:
            self.begin()
        if self.waiting:  # those that were left when an archive was full
            self.finish()
        if self.row:
            self.end_row()

    def given(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def _frames(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts

        archives = _Archives(rows)
        for batch in parts(batches, "payload", 1_000_000):
            for row in batch.to_pylist():
                archives.add(record(*row.values()))
            if archives.out:
                yield archives.given()
        archives.finish()
        if archives.out:
            yield archives.given()

    return run


def write(records: DataFrame, path: str, rows: int = ROWS) -> None:
    """Writes what `classify` gives as archives below path, of `rows` rows each, two at least: the dictionary and frames of records."""
    text = [F.col(c).cast("string").alias(c) for c in ("page_id", "url")]
    made = records.select(*text, "payload", "payload_bytes", "payload_digest", F.col("refers_to").cast("string").alias("refers_to"))
    made.mapInArrow(_frames(rows), "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", rows).text(path)


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a dictionary-compressed archive."""
    import zstandard

    view, at = memoryview(archive), 0
    press = zstandard.ZstdDecompressor()
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at)
        if magic in _SKIPPABLE:
            if magic == _DICTIONARY and at == 0:
                press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size])))
            at += 8 + size
            continue
        one, out = press.decompressobj(), []
        while not one.eof:
            piece = view[at : at + _CHUNK]
            if not len(piece):
                raise ValueError("an archive ends within a record")
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        data = b"".join(out)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name = lambda x: x[len(_ID) + 1 : -1] if x and x.startswith(f"<{_ID}") else None
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for fields, block in records_of(content.as_buffer().to_pybytes()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size, digest = len(payload), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "revisit":
                    size, payload = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), None
                elif hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} has another digest than its header")
                rows.append((name(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], name(fields.get("WARC-Refers-To")), payload))
                held += len(payload or b"")
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of the archives below path.

    payload is null for revisits; sizes and digests are always those of the full payload.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read, "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")


def report(pages: DataFrame) -> DataFrame:
    """What op9 returns."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(classify(pages), path)
    kind = pages.schema["page_id"].dataType
    ids = [F.col(c).cast(kind).alias(c) for c in ("page_id", "refers_to")]
    return read(spark, path).select(ids[0], "payload_bytes", "payload_digest", "record_type", ids[1])


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
