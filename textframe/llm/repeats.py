"""Removal of long repeats by prefix-free parsing.

A byte goes if it is covered by a string of LENGTH (50) bytes that also starts in a
document with a smaller id. Overlaps count, strings are judged on the input, and no string
crosses documents.

Parsing. A rolling hash runs over every TRIGGER (24) bytes. Each string of LENGTH bytes is
owned by the trigger with the smallest hash in it (the first, if several), which depends on
the string alone; so equal strings have equal triggers, wherever they stand, and no string
is without one (with triggers taken by a hash modulo p, some would be). The strings of one
trigger start side by side: together they are a phrase, of at most 76 bytes: the trigger,
what leads up to it and what follows. A document is the sequence (parse) of its phrases.

Dictionary. Phrases meet by their trigger's hash, dealt over buckets as arrays. Equal phrases
(by 128 bits of hash, of the trigger and of the whole) become one entry with its smallest
id; a phrase that a smaller id has too is removed whole. Strings of different phrases can be
equal only where these share a trigger (at the ends of a repeat, or by chance): those go on,
as bytes; in all others every suffix is alone in the corpus order, which needs no sorting.

Corpus order. A string is a suffix of a dictionary phrase (cut at its trigger's end: 24 to 50
bytes, and none a proper suffix's continuation, as each ends with its trigger) and what the
parse goes on with after it (the rest of the 50). The suffix array of the dictionary orders
the phrases by their bytes before the trigger, read backwards from it, so that one order
serves suffixes of all lengths; that of the parse orders what follows, the trigger first. A
string's place in the combined order is the pair of its ranks to the depths that its length
asks for; strings with one pair are a run of equal 50-byte prefixes, compared byte by byte, and each
run's smallest id is kept. The order of suffixes with different triggers is asked for by
nothing, so those are not put in order against each other: a sort of all suffixes to depth 50 would
shuffle 50 times the input.

Within a part of a task, a phrase is sent only for its smallest id; the others are known to
go. So a phrase with a third of all documents costs a row for each part, not for each
document. Buckets are many: four for each shuffle partition, and one for each BUCKET bytes
of text at least, which bounds the arrays of a group.

A short passage in changing surroundings gives one trigger a different phrase in each
document. A trigger with about HOT phrases and more, as estimated from one row in SAMPLED,
is not dealt as a whole: each of its strings is a phrase of its own, with the string's own
hash for a key, so they spread over all buckets. Equal strings have equal triggers, so which
triggers are dealt so changes no result. Others have fewer than about HOT phrases.

Ids must be whole numbers; a null id counts as the smallest number, and is returned as null.
Null texts are empty; very long ones are parsed in pieces that overlap, which changes no
result. Rows that share an id do not remove from each other; rows that repeat an id with other
texts are told apart by a check value. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textframe.llm._common import stored

LENGTH = 50
TRIGGER = 24
#: Phrases of one trigger from which its strings are dealt one by one, and the rows of which one is looked at for that.
HOT = 20_000
SAMPLED = 8
BUCKET = 64 << 20
_PART = 2_000_000
_REST = LENGTH - TRIGGER
_NULL = -(2**63)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_TABLE = [np.random.Generator(np.random.PCG64([7, i])).integers(0, 2**64, 256, np.uint64) for i in (0, 1)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class _Rolling:
    """Polynomial hashes of any stretch of a byte array, modulo 2**64."""

    def __init__(self, raw: np.ndarray, which: int):
        base = int(_BASE[which])
        n = len(raw)
        self.sums = np.zeros(n + 1, np.uint64)
        powers = np.full(n, base, np.uint64)
        if n:
            powers[0] = 1
        np.cumsum(_TABLE[which][raw] * np.cumprod(powers), out=self.sums[1:])
        self.back = np.full(n + 1, pow(base, -1, 2**64), np.uint64)
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def phrases(raw: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The parse of texts laid end to end: (text, start, count, lead, key, phrase hash): count strings begin at start, the trigger lead bytes later.

    Phrases whose key is in `hot` are cut into their strings, under keys of their own.
    """
    n, wide = len(raw), LENGTH - TRIGGER + 1
    if n < LENGTH:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int8, np.uint64, np.uint64))
    one = _Rolling(raw, 0)
    hashes = one.of(slice(0, n - TRIGGER + 1), slice(TRIGGER, n + 1))
    least, place, have = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while have < wide:
        step = min(have, wide - have)
        right = least[step:] < least[:-step]
        least, place, have = np.where(right, least[step:], least[:-step]), np.where(right, place[step:], place[:-step]), have + step
    own = place[: n - LENGTH + 1]
    del least, place
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(own)]
    inside = np.flatnonzero(np.arange(len(own)) + LENGTH <= offsets[1:][text])
    own, text = own[inside], text[inside]
    first = np.flatnonzero((np.diff(own, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    count = np.diff(first, append=len(own))
    start, text, own = inside[first], text[first], own[first].astype(np.int64)
    key = hashes[own]
    del hashes
    if hot is not None and len(hot) and (cut := np.isin(key, hot)).any():
        many = np.where(cut, count, 1)
        shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        text, start, own, key, cut, count = (np.repeat(x, many) for x in (text, start, own, key, cut, np.where(cut, 1, count)))
        start = start + shift
        key[cut] = one.of(start[cut], start[cut] + LENGTH)
        own[cut] = start[cut]
    del one
    two = _Rolling(raw, 1)
    whole = _mixed(two.of(start, start + count + LENGTH - 1) + (own - start).astype(np.uint64) * np.uint64(64) + count.astype(np.uint64))
    return text, start - offsets[text], count, (own - start).astype(np.int8), key, whole


def _parsed(raw: np.ndarray, offsets: np.ndarray, hot: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """`phrases` of a part of a task; a single very long text comes in pieces, which share no string."""
    if len(offsets) > 2 or len(raw) <= 2 * _PART:
        yield phrases(raw, offsets, hot)
        return
    for at in range(0, len(raw), _PART):
        piece = raw[at : at + _PART + LENGTH - 1]
        text, start, *rest = phrases(piece, np.array([0, len(piece)]), hot)
        yield text, start + at, *rest


def _lists(order: np.ndarray, bucket: np.ndarray, columns: dict[str, np.ndarray], name: str = "bucket") -> pa.RecordBatch:
    """A row for each bucket, with the columns' values in lists."""
    bucket = bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1) != 0)
    offsets = pa.array(np.append(first, len(bucket)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int32)), *(pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in columns.values())], [name, *columns])


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def _spans(doc: np.ndarray, check: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Joins stretches of one document that touch."""
    order = np.lexsort((start, check, doc))
    doc, check, start, count = doc[order], check[order], start[order], count[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (check[1:] != check[:-1]) | (start[1:] != start[:-1] + count[:-1])
    first = np.flatnonzero(new)
    return doc[first], check[first], start[first], np.add.reduceat(count, first) if len(first) else count


_PARSED = "bucket int, sure array<boolean>, key array<bigint>, phrase array<bigint>, doc array<bigint>, at array<int>, start array<int>, count array<int>, lead array<tinyint>"
_FOUND = "doc bigint, at int, start int, count int, lead tinyint, key bigint, sure boolean"
_EDGES = "bucket int, doc array<bigint>, at array<int>, start array<int>, lead array<tinyint>, bytes array<binary>"


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): triggers with several different phrases within a part."""
    from textframe.llm._common import parts, utf8

    for key, whole in (x[4:] for batch in parts(batches, "text", _PART) for x in _parsed(*utf8(batch.column("text")))):
        order = np.lexsort((whole, key))
        k, w = key[order], whole[order]
        k = k[np.append(True, (k[1:] != k[:-1]) | (w[1:] != w[:-1]))] if len(k) else k
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        n = np.diff(first, append=len(k))
        yield pa.RecordBatch.from_arrays([pa.array(k[first][n > 1].view(np.int64)), pa.array(n[n > 1])], ["key", "n"])


def hot_triggers(rows: DataFrame, hot: int, sampled: int) -> np.ndarray:
    """Triggers with about `hot` different phrases and more: no more than a row for so many phrases."""
    some = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(sampled)) == 0)
    sums = some.mapInArrow(_often, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") * sampled >= hot)
    return np.sort(sums.select("key").toArrow().column("key").to_numpy().view(np.uint64))


def _parse(buckets: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts, utf8

        for batch in parts(batches, "text", _PART):
            raw, offsets = utf8(batch.column("text"))
            check = batch.column("at").to_numpy(zero_copy_only=False)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for found in _parsed(raw, offsets, hot.value):
                if len(found[0]):
                    yield sent(ids, check, *found)

    def sent(ids: np.ndarray, check: np.ndarray, text: np.ndarray, start: np.ndarray, count: np.ndarray, lead: np.ndarray, key: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        doc, at = ids[text], check[text]
        order = np.lexsort((doc, whole, key))
        k, w, d = key[order], whole[order], doc[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        later = np.zeros(len(k), bool)
        later[order] = d > np.repeat(d[first], np.diff(first, append=len(d)))
        first_here = ~later
        some = _spans(doc[later], at[later], start[later], count[later])
        columns = {
            "sure": np.repeat([False, True], [int(first_here.sum()), len(some[0])]),
            "key": np.concatenate([key[first_here].view(np.int64), np.zeros(len(some[0]), np.int64)]),
            "phrase": np.concatenate([whole[first_here].view(np.int64), np.zeros(len(some[0]), np.int64)]),
            "doc": np.concatenate([doc[first_here], some[0]]),
            "at": np.concatenate([at[first_here], some[1]]),
            "start": np.concatenate([start[first_here], some[2]]).astype(np.int32),
            "count": np.concatenate([count[first_here], some[3]]).astype(np.int32),
            "lead": np.concatenate([lead[first_here], np.zeros(len(some[0]), np.int8)]),
        }
        bucket = np.concatenate([key[first_here] % np.uint64(buckets), (some[0] ^ some[1]).view(np.uint64) % np.uint64(buckets)]).astype(np.int64)
        return _lists(np.lexsort((columns["start"], columns["doc"], bucket)), bucket, columns)

    return run


def _compare(table: pa.Table) -> pa.Table:
    """A bucket's phrases: what goes whole, and what must be compared string by string."""
    sure, key, phrase, doc, at, start, count, lead = (_flat(table, x) for x in ("sure", "key", "phrase", "doc", "at", "start", "count", "lead"))
    order = np.lexsort((doc, phrase, key))
    order = order[~sure[order]]
    k, p, d = key[order], phrase[order], doc[order]
    known = np.concatenate([np.flatnonzero(sure), np.zeros(0, np.int64)])
    edge = np.zeros(0, np.int64)
    if len(k):
        new_k = np.append(True, k[1:] != k[:-1])
        new_p = new_k | np.append(True, p[1:] != p[:-1])
        first_k, first_p = np.flatnonzero(new_k), np.flatnonzero(new_p)
        own = np.repeat(d[first_p], np.diff(first_p, append=len(d)))
        low = np.repeat(np.minimum.reduceat(own, first_k), np.diff(first_k, append=len(d)))
        high = np.repeat(np.maximum.reduceat(own, first_k), np.diff(first_k, append=len(d)))
        known = np.concatenate([known, order[d > own]])
        edge = order[(d == own) & (low < high)]
    a, b, c, e = _spans(doc[known], at[known], start[known], count[known])
    out = [
        np.concatenate([a, doc[edge]]),
        np.concatenate([b, at[edge]]).astype(np.int32),
        np.concatenate([c, start[edge]]).astype(np.int32),
        np.concatenate([e, count[edge]]).astype(np.int32),
        np.concatenate([np.zeros(len(a), np.int8), lead[edge]]),
        np.concatenate([np.zeros(len(a), np.int64), key[edge]]),
        np.repeat([True, False], [len(a), len(edge)]),
    ]
    return pa.table(dict(zip(("doc", "at", "start", "count", "lead", "key", "sure"), map(pa.array, out), strict=True)))


def _cut(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of phrases to compare, by bucket."""
        from textframe.llm._common import parts

        for batch in parts(batches, "text", _PART):
            keys, docs, ats, starts, leads, cut = [], [], [], [], [], []
            for doc, at, text, edges in zip(*(batch.column(x).to_pylist() for x in ("id", "at")), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("edges"), strict=True):
                key, start, count, lead = (edges.values.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                keys.append(key)
                docs.append(np.full(len(key), doc, np.int64))
                ats.append(np.full(len(key), at, np.int32))
                starts.append(start)
                leads.append(lead)
                cut += [text[a:b] for a, b in zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)]
            if keys:
                key = np.concatenate(keys)
                columns = {"doc": np.concatenate(docs), "at": np.concatenate(ats), "start": np.concatenate(starts), "lead": np.concatenate(leads), "bytes": np.array(cut, object)}
                bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                yield _lists(np.argsort(bucket, kind="stable"), bucket, columns)

    return run


def _ranks(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, shared): each row's place in the order of rows as bytes, and for each place how many bytes it shares with the one before."""
    order = np.argsort(rows.view(f"S{rows.shape[1]}")[:, 0], kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows = rows[order]
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return place, np.append(-1, shared)


def _suffixes(table: pa.Table) -> pa.Table:
    """The combined order of a bucket's phrases; gives the strings that a smaller id has too."""
    doc, at, start, lead = (_flat(table, x) for x in ("doc", "at", "start", "lead"))
    cut = table.column("bytes").combine_chunks().flatten()
    n, lead = len(cut), lead.astype(np.int64)
    data = np.frombuffer(b"".join(cut.to_pylist()) + bytes(LENGTH), np.uint8)
    size = pc.binary_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(size) - size
    trigger = begin + lead
    # before the trigger, backwards, and from the trigger on; beyond a phrase's ends stands nothing that is looked at below
    back, on = np.arange(_REST), np.arange(LENGTH)
    before = np.where(back < lead[:, None], data[np.maximum(trigger[:, None] - 1 - back, 0)], 0).astype(np.uint8)
    after = np.where(on < (size - lead)[:, None], data[np.minimum(trigger[:, None] + on, len(data) - 1)], 0).astype(np.uint8)
    (place_b, shared_b), (place_a, shared_a) = (_ranks(np.ascontiguousarray(x)) for x in (before, after))
    found, shifts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for o in range(_REST + 1 if n else 0):
        shift = lead - o  # where a string that has o bytes before its trigger starts
        some = np.flatnonzero((shift >= 0) & (shift + LENGTH <= size))
        if len(some) < 2:
            continue
        suffix, parse = np.cumsum(shared_b < o)[place_b[some]], np.cumsum(shared_a < LENGTH - o)[place_a[some]]
        run = suffix * (n + 1) + parse
        order = np.lexsort((doc[some], run))
        run, ids = run[order], doc[some][order]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        later = order[ids > np.repeat(ids[first], np.diff(first, append=len(ids)))]
        found.append(some[later])
        shifts.append(shift[some[later]])
    row, shift = np.concatenate(found), np.concatenate(shifts)
    a, b, c, e = _spans(doc[row], at[row], start[row] + shift, np.ones(len(row), np.int64))
    return pa.table({"doc": pa.array(a), "at": pa.array(b.astype(np.int32)), "start": pa.array(c.astype(np.int32)), "count": pa.array(e.astype(np.int32))})


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, sampled: int = SAMPLED) -> DataFrame:
    """(doc, at, start, count): `count` strings from byte `start` on begin in a document with a smaller id. doc is the id, at a text's check value."""
    rows = _rows(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)
    shared = docs.sparkSession.sparkContext.broadcast(hot_triggers(rows, hot, sampled))
    parsed = rows.mapInArrow(_parse(buckets, shared), _PARSED)
    found = stored(parsed.groupBy("bucket").applyInArrow(_compare, _FOUND), "phrases")
    for _ in range(2):  # else the shuffled phrases stay on disk until the driver happens to collect its garbage
        gc.collect()
        docs.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(1)
    edges = found.filter("not sure").groupBy(F.col("doc").alias("id"), "at").agg(F.collect_list(F.struct("key", "start", "count", "lead")).alias("edges"))
    cut = rows.join(edges, ["id", "at"]).select("id", "at", "text", "edges").mapInArrow(_cut(buckets), _EDGES)
    suffixes = stored(cut.groupBy("bucket").applyInArrow(_suffixes, "doc bigint, at int, start int, count int"), "suffixes")
    return found.filter("sure").select("doc", "at", "start", "count").union(suffixes)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, text, void): at is the text's check value, void says that the id is null."""
    check = F.crc32("text")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.col(id_col).isNull().alias("void"))
    return rows.select("id", F.when(check < 2**31, check).otherwise(check - 2**32).cast("int").alias("at"), "text", "void")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from textframe.llm._common import parts

    for batch in parts(batches, "text"):
        sizes, removed, runs, kept = [], [], [], []
        for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans"), strict=True):
            gone = n = at = 0
            out = []
            if spans.is_valid and len(spans.values):
                values = spans.values
                start, count = (values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                for a, b in sorted(zip(start.tolist(), (start + count + LENGTH - 1).tolist(), strict=True)):
                    if a > at or not n:
                        out.append(text[at:a])
                        n += 1
                        gone, at = gone + b - a, b
                    elif b > at:
                        gone, at = gone + b - at, b
            out.append(text[at:])
            sizes.append(len(text))
            removed.append(gone)
            runs.append(n)
            kept.append(b"".join(out))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("void"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["id", "void", "n_bytes", "n_removed", "n_spans", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept binary) for each row of docs."""
    rows = _rows(docs, id_col, text_col)
    spans = removals(docs, id_col, text_col).groupBy(F.col("doc").alias("id"), "at").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    joined = rows.join(spans, ["id", "at"], "left").select("id", "void", "text", "spans")
    out = joined.mapInArrow(_keep, "id bigint, void boolean, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    kind = docs.schema[id_col].dataType
    return out.select(F.when(~F.col("void"), F.col("id")).cast(kind).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")


def report(docs: DataFrame) -> DataFrame:
    """What op5 returns."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Over all strings, in hex; blocks of 500 bytes, as a position in a long text is dear to reach.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, id, o, substr(h, 2 * o + 1, 1098) AS h FROM (SELECT r, id, h, unnest(range(0, len(h) // 2, 500)) AS o FROM d)),
s AS (SELECT r, id, o + i AS pos, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, id, o, h, unnest(range(0, least(500, len(h) // 2 - 49))) AS i FROM b)),
f AS (SELECT s, min(id) AS first FROM s GROUP BY s HAVING min(id) < max(id)),
g AS (SELECT r, pos FROM s JOIN f USING (s) WHERE id > first),
n AS (SELECT r, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS new FROM g),
u AS (SELECT r, pos, sum(new) OVER (PARTITION BY r ORDER BY pos) AS run FROM n),
v AS (SELECT r, min(pos) AS a, max(pos) + 50 AS e FROM u GROUP BY r, run),
p AS (SELECT r, a, e, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY a) AS p FROM v),
k AS (SELECT r, sum(e - a) AS gone, count(*) AS n, max(e) AS e, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(from_hex(coalesce(kept, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
