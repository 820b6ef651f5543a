r"""Secret scans with structural confirmation.

Three base patterns (assign, access, hex) report what looks like a credential. The
structural kinds report only what decodes: a run of base64 or hex characters is
decoded, and reported if the bytes are a whole key encoding whose nested lengths
add up (DER, or the length-prefixed fields of an SSH key); a dotted token is reported
if its first two parts decode to JSON objects and the first names an algorithm.

Any dotted pair of base64url runs is tried as a token, and its header decides. Base64 may
be wrapped in lines, whose ends may be written as escapes (`\n` in a JSON string); headers
before a PEM body are read over, and if they say that the key is encrypted, its length
must be one of whole cipher blocks, as there is nothing else to parse.

A cheap look at the bytes of a whole batch finds the few rows that can hold a match;
only those are read with the patterns, each as a whole text. Rows are kept apart from each
other there, so no row changes what is found in the next. Positions are code points,
ends exclusive.

Nulls count as empty texts, which have no span. Texts of any length are read whole. Rows are neither merged nor dropped.
Only the two named columns are read; any others are ignored.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textframe.llm._common import fresh

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "token", "pem", "key64", "keyhex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A JSON object in base64 begins with one of these: its brace, or white space before it.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([eICD][A-Za-z0-9_-]{3,})\.([A-Za-z0-9_-]{2,})(?:\.([A-Za-z0-9_-]*))?")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)[\x20-\x7e\s])*)-----END \1-----")
_PEM_HEAD = re.compile(r"[A-Za-z0-9-]+: [^\r\n]*\Z")
_END = r"(?:\\r)?\\n|\r?\n"
_ENDS = re.compile(_END)
_B64 = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}(?:(?:{_END})[ \t]*[A-Za-z0-9+/_-]+)*={{0,2}}")
_LINE = re.compile(r"(?<!\\)[A-Za-z0-9+/_-]+={0,2}")
_HEXES = re.compile(r"[0-9A-Fa-f]{40,}")
_RUN = 32
_CLASS = np.zeros(256, bool)
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_MARKS = re.compile(rb"AKIA|-----BEGIN |[eICD][A-Za-z0-9_-]{3,}\.[A-Za-z0-9_-]{2}")
_WORDS = re.compile(rb"passw|secret|token|api_?key")


def _unbase64(run: str) -> bytes:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return b""
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _nested(data: bytes, depth: int = 0) -> bool:
    """Whether DER elements fill data exactly, and those inside constructed ones fill them."""
    at = 0
    if depth > 16:
        return False
    while at < len(data):
        if at + 2 > len(data):
            return False
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return False
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return False
        if at + size > len(data) or tag & 0x1F == 0x1F:
            return False
        if tag & 0x20 and not _nested(data[at : at + size], depth + 1):
            return False
        at += size
    return True


def is_key(data: bytes) -> bool:
    """A DER sequence that begins with an integer or a sequence, or an SSH key; all lengths must add up."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
        fields = 0
        while len(data) >= 4 and fields < 3:
            size = int.from_bytes(data[:4], "big")
            if size > len(data) - 4:
                return False
            data, fields = data[4 + size :], fields + 1
        return fields == 3 and len(data) >= 4
    if data[:4] == b"\0\0\0\x07" and data[4:8] in (b"ssh-", b"ecds"):
        while data:
            size = int.from_bytes(data[:4], "big")
            if len(data) < 4 or size > len(data) - 4:
                return False
            data = data[4 + size :]
        return True
    if len(data) < 24 or data[0] != 0x30 or not _nested(data):
        return False
    head = data[1] & 0x7F if data[1] & 0x80 else 0
    if len(data) != 2 + head + (int.from_bytes(data[2 : 2 + head], "big") if head else data[1]):
        return False  # two keys after each other are not one
    inner = data[2 + head : 4 + head]
    return len(inner) == 2 and inner[0] in (0x02, 0x30)


def _is_signed(header: str, payload: str) -> bool:
    try:
        head, body = json.loads(_unbase64(header)), json.loads(_unbase64(payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def _is_pem(body: str) -> bool:
    lines = [x.strip() for x in _ENDS.split(body)]
    heads = [x for x in lines if _PEM_HEAD.match(x)]
    data = _unbase64("".join(x for x in lines if not _PEM_HEAD.match(x)))
    if any(x.startswith("Proc-Type:") and x.endswith("ENCRYPTED") for x in heads):
        return len(data) >= 48 and len(data) % 8 == 0
    return is_key(data)


def _keys64(text: str) -> Iterator[tuple[str, int, int]]:
    """Keys in base64, wrapped or not. Wrapped lines are equally long but for the last; where they are no key together, each may be one."""
    for m in _B64.finditer(text):
        lines, i = list(_LINE.finditer(text, *m.span())), 0
        while i < len(lines):
            wide = len(lines[i][0])
            j = next((k for k in range(i + 1, len(lines)) if len(lines[k][0]) != wide), len(lines))
            ends = [j + 1, j] if j < len(lines) and len(lines[j][0]) < wide else [j]
            end = next((k for k in ends if wide >= 40 and is_key(_unbase64("".join(x[0] for x in lines[i:k])))), 0)
            if end:
                yield "key64", lines[i].start(), lines[end - 1].end()
            elif wide >= 40:
                yield from (("key64", *x.span()) for x in lines[i:j] if is_key(_unbase64(x[0])))
            i = end or j


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans of one whole text, by start, then kind."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += [("token", *m.span()) for m in _TOKEN.finditer(text) if _is_signed(m[1], m[2])]
    found += [("pem", *m.span()) for m in _PEM.finditer(text) if _is_pem(m[2])]
    found += _keys64(text)
    found += [("keyhex", *m.span()) for m in _HEXES.finditer(text) if len(m[0]) % 2 == 0 and is_key(bytes.fromhex(m[0]))]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a batch that can hold a match: a long run of key characters, or a word that begins one."""
    n = len(offsets) - 1
    # a byte that no pattern takes stands after each row
    apart = np.full(len(raw) + n, 0xFF, np.uint8)
    apart[np.arange(len(raw)) + np.repeat(np.arange(n), np.diff(offsets))] = raw
    ends = offsets[1:] + np.arange(n)
    stops = np.append(-1, np.flatnonzero(~_CLASS[apart]))
    runs = stops[:-1][np.diff(stops) > _RUN] + 1
    data = apart.tobytes()
    marks = [m.start() for m in _MARKS.finditer(data)] + [m.start() for m in _WORDS.finditer(data.lower())]
    return np.unique(np.searchsorted(ends, np.concatenate([runs, np.array(marks, np.int64)]), "right"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), out: str = "spans") -> DataFrame:
    """(id_col, keep..., spans array<struct<kind, start, end>>) for each row of docs, in one narrow pass.

    With keep, the named columns pass through, so that a caller need not join them back. out: the spans' name.
    """
    columns = [F.col(c).alias(f"_{i}") for i, c in enumerate((id_col, *keep))]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField(f"_{i}", docs.schema[c].dataType) for i, c in enumerate((id_col, *keep))] + [T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts, utf8

        for batch in parts(batches, "_text"):
            text = batch.column("_text")
            spans = [[] for _ in range(batch.num_rows)]
            for i in _suspects(*utf8(text)).tolist():
                spans[i] = [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(text[i].as_py() or "")]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, arrow)], [*batch.schema.names[:-1], "spans"])

    found = docs.select(*columns, F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return found.toDF(id_col, *keep, out)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """What op7 returns."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return scan(docs).select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each maximal run of overlapping spans replaced by mark; columns and their order stay."""
    keep, spans = tuple(c for c in docs.columns if c != id_col), fresh(docs, "spans")
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at")),
    ).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at")))
    length = F.char_length(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, length)))
    return scan(docs, id_col, text_col, keep, spans).withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(F.col(text_col))).select(*docs.columns)


def base(docs: DataFrame) -> DataFrame:
    """The columns of op7 that SQL can say: counts and digest of the base spans."""
    return report(docs).drop("spans")


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_WORD = "|".join(_either(x) for x in ("password", "passwd", "secret", "token", "api_?key"))
#: Kind, pattern, the group that is measured and its least length.
_BASE = (
    ("assign", rf"""({_WORD})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "(AKIA[A-Z0-9]+)", 1, 16),
    ("hex", "([0-9a-f]+)", 1, 32),
)
#: Positions come from the lengths of matches and of what lies between them.
BASE_SQL = "WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),\nm AS (" + " UNION ALL ".join(
    f"SELECT r, {i} AS k, '{kind}' AS kind, {least} AS least, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', {group}) AS value, regexp_split_to_array(text, '{p}') AS pieces FROM t"
    for i, (kind, p, group, least) in enumerate(_BASE)
) + """),
i AS (SELECT r, k, kind, least, unnest(found) AS found, unnest(value) AS value, unnest(pieces[1:len(found)]) AS piece, generate_subscripts(found, 1) AS i FROM m WHERE len(found) > 0),
s AS (SELECT r, k, kind, least, value, sum(length(piece) + length(found)) OVER (PARTITION BY r, k ORDER BY i) AS stop, length(found) AS n FROM i),
b AS (SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS x,
      string_agg(kind || ':' || CAST(stop - n AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY stop - n, k) AS spans FROM s WHERE length(value) >= least GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM t LEFT JOIN b USING (r)
"""
