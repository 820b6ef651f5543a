"""SimHash near-duplicates, with links found by pigeonring filtering.

Fingerprints. A text is lower-cased (A-Z), cut into words at white space and into
shingles of four words, repeats included. Bit i of the fingerprint is 1 if more than
half of the shingles' hashes (XXH64, seed 42) have it. Texts with fewer words are one
shingle; texts without a word have fingerprint zero and are linked like any other.

Links. Two fingerprints link if at most `budget` (4) bits differ. The 64 bits form a
ring of five segments. If at most 4 bits differ, some segment starts a chain whose
first k segments differ in at most floor(4k/5) bits for every k: none in the first,
one at most in the first two, two at most in the first three. So every fingerprint is
filed under each pair of neighbouring segments, and looked up under each pair and
under each pair with one set bit of the second segment cleared (of two segments that
differ in one bit, one has that bit set). What meets under a key is held against the
budget of three segments, and only what is left against the whole fingerprint.

Groups. Equal fingerprints are one node from the start, so exact copies cost nothing.
A key never yields all pairs: each looked-up fingerprint gives one link to the group
and the group's own fingerprints are joined as they are found to be connected through
it, so links grow with the rows of a group. Keys with more than BLOCK fingerprints are
dealt over several blocks, each of which sees all look-ups; no candidate is dropped.

Null texts count as empty. Null ids keep their row and get the component of their
fingerprint. Repeated rows are repeated in the result. Columns other than the two
named ones are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textframe.llm._common import fits, hot_keys, near, spread_join, stored
from textframe.llm.graph import components

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Widths of the ring's segments, lowest bits first.
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = (0, 13, 26, 39, 52)
#: Fingerprints filed under one key and block.
BLOCK = 4096


def fingerprint_batch(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit integers."""
    from xxhash import xxh64_intdigest

    hashes, counts = [], []
    for text in texts:
        words = text.lower().split()
        if not words:
            counts.append(0)
            continue
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        joined, ends = b" ".join(words), ends.tolist()
        if len(words) <= SHINGLE:
            found = [xxh64_intdigest(joined, SEED)]
        else:
            found = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)]
        hashes.append(np.array(found, np.uint64))
        counts.append(len(found))
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.int64)
    if hashes:
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = counts > 0
        starts = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > counts[full][:, None], axis=1, bitorder="little").view(np.int64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: tuple[Column, ...] = ()) -> DataFrame:
    """(id_col, fp bigint, _0, _1...: bigint digests) for each row of docs, in one narrow pass."""
    names = [f"_{i}" for i in range(len(digests))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframe.llm._common import parts

        for batch in parts(batches, "text", 1_000_000):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fingerprint_batch([x or b"" for x in texts])), *(batch.column(x) for x in names)], ["id", "fp", *names])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("fp", *names))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *(x.alias(n) for x, n in zip(digests, names, strict=True))).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _segment(fp: Column, at: Column) -> Column:
    """The segment of fp at a position of the ring."""
    shift = F.element_at(F.lit(list(SHIFTS)), at + 1)
    mask = F.element_at(F.lit([(1 << w) - 1 for w in WIDTHS]), at + 1)
    return F.call_function("shiftrightunsigned", fp, shift).bitwiseAND(mask)


def filed(prints: DataFrame) -> DataFrame:
    """(key, role, fp): role 0 files fp under key, role 1 looks it up there."""
    ring = prints.select("fp", F.explode(F.lit([0, 1, 2, 3, 4])).alias("at"))
    first, second = _segment(F.col("fp"), F.col("at")), _segment(F.col("fp"), (F.col("at") + 1) % 5)
    pairs = ring.select("fp", (F.col("at").cast("long") * (1 << 26) + first * (1 << 13)).alias("first"), second.alias("second"))
    # -2 files, -1 looks up the pair itself, 0 to 12 with that bit of the second segment cleared
    ways = pairs.select("fp", "first", "second", F.explode(F.lit(list(range(-2, 13)))).alias("way"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest("way", F.lit(0)))
    looked = ways.filter((F.col("way") < 0) | (F.col("second").bitwiseAND(bit) != 0))
    cleared = F.when(F.col("way") < 0, F.col("second")).otherwise(F.col("second") - bit)
    return looked.select((F.col("first") + cleared).alias("key"), F.when(F.col("way") == -2, 0).otherwise(1).cast("byte").alias("role"), "fp")


class _Meeting:
    """Fingerprints under one key: those filed, which of them are connected, and links to look-ups."""

    def __init__(self, key: int):
        at = key >> 26
        mask = sum(((1 << WIDTHS[(at + i) % 5]) - 1) << SHIFTS[(at + i) % 5] for i in range(3))
        self.three = np.uint64(mask)
        self.own = np.zeros(0, np.uint64)
        self.label = np.zeros(0, np.int64)
        self.links: list[np.ndarray] = []

    def file(self, fps: np.ndarray) -> None:
        self.own = np.concatenate([self.own, fps])
        self.label = np.arange(len(self.own))

    def look_up(self, fps: np.ndarray) -> None:
        step = max(1, 1_000_000 // max(1, len(self.own)))
        for at in range(0, len(fps), step) if len(self.own) else ():
            some = fps[at : at + step]
            apart = some[:, None] ^ self.own[None, :]
            row, col = np.nonzero(np.bitwise_count(apart & self.three) <= BUDGET * 3 // 5)
            near = np.bitwise_count(apart[row, col]) <= BUDGET
            row, col = row[near], col[near]
            if not len(row):
                continue
            lead = np.flatnonzero(np.diff(row, prepend=-1))
            one = col[lead]
            other = some[row[lead]]
            differ = other != self.own[one]
            self.links.append(np.stack([other[differ], self.own[one[differ]]]))
            self._join(np.repeat(one, np.diff(lead, append=len(row))), col)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (up := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = up

    def found(self) -> list[np.ndarray]:
        inner = self.label != np.arange(len(self.own))
        return [*self.links, np.stack([self.own[inner], self.own[self.label[inner]]])]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (key, block, role, fp) sorted by the first three; gives links."""

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found, axis=1).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    now, meeting = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, block, role = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.flatnonzero((np.diff(key, prepend=key[0]) != 0) | (np.diff(block, prepend=block[0]) != 0))
        starts = np.concatenate([[0], starts])
        ends = np.append(starts[1:], len(key))
        several = np.minimum.reduceat(fp, starts) != np.maximum.reduceat(fp, starts)
        several[0] = several[-1] = True  # these may go on in another batch
        links = []
        for s, e in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            this = (int(key[s]), int(block[s]))
            if this != now:
                if meeting is not None:
                    links += meeting.found()
                now, meeting = this, _Meeting(this[0])
            filing = role[s:e] == 0
            if filing.any():
                meeting.file(fp[s:e][filing])
            meeting.look_up(fp[s:e][~filing])
        if links and sum(x.shape[1] for x in links):
            yield out(links)
    if meeting is not None:
        yield out(meeting.found())


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links of distinct fingerprints `fp`, enough to connect all within the budget."""
    rows = filed(prints)
    full = rows.filter("role = 0").groupBy("key").count().filter(F.col("count") > block)
    full = stored(full.select(F.col("key").alias("full"), F.ceil(F.col("count") / block).cast("int").alias("blocks")), "full-keys")
    if not full.isEmpty():
        rows = rows.join(near(full), rows["key"] == full["full"], "left")
        blocks = F.coalesce("blocks", F.lit(1))
        own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
        rows = rows.select("key", "role", "fp", F.explode(F.when(F.col("role") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))).alias("block"))
    else:
        rows = rows.withColumn("block", F.lit(0))
    dealt = rows.select("key", "block", "role", "fp").repartition("key", "block").sortWithinPartitions("key", "block", "role")
    return dealt.mapInArrow(_meet, "a bigint, b bigint")


def _grouped(docs: DataFrame, id_col: str, text_col: str, digests: tuple[Column, ...] = ()) -> DataFrame:
    """The rows of fingerprints() with component_id, and root, which tells components apart where ids are null or repeat."""
    prints = stored(fingerprints(docs, id_col, text_col, digests), "simhash")
    nodes = stored(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = stored(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    classes = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "roots")
    ids = classes.select("root", "component_id")
    named = rooted.join(F.broadcast(ids), "root") if fits(ids) else spread_join(rooted, ids, "root", hot_keys(classes, "root", "members"), "inner")
    named = stored(named.select("fp", "root", "component_id"), "named")
    found = prints.join(F.broadcast(named), "fp") if fits(named) else spread_join(prints, named, "fp", hot_keys(nodes, "fp"), "inner")
    return found.select(*prints.columns, "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp bigint, component_id) for each row of docs; component_id is the smallest id reachable over links."""
    return _grouped(docs, id_col, text_col).select(id_col, "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """What op8 returns."""
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return near_duplicates(docs).select("doc_id", shown, "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: the smallest id's, null last; of rows that share it, the one with the smallest digests.

    Only ids, digests and fingerprints are grouped; texts join once, on the id and the digests
    of the text and of the row, so ids that are null or repeat lose no component. Maps have no
    digest: of rows that differ in them alone, any stays.
    """
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    digests = (F.xxhash64(F.col(text_col)), F.xxhash64(*(F.col(f"`{x}`") for x in hashed)))
    grouped = _grouped(docs, id_col, text_col, digests)
    row = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("_id"), "_0", "_1")
    rows = stored(grouped.select("root", row.alias("row")), "classes")
    kept = rows.groupBy("root").agg(F.min("row").alias("row")).select("row._id", "row._0", "row._1")
    repeats = not rows.groupBy("row").count().filter("count > 1").isEmpty()
    # the rows kept grow with the table, so texts are shuffled at any size
    same = docs[id_col].eqNullSafe(kept["_id"]) & (digests[0] == kept["_0"]) & (digests[1] == kept["_1"])
    out = docs.join(kept.hint("merge"), same, "left_semi")
    if not repeats:
        return out
    names = out.columns
    marked = out.select(F.struct(*(F.col(f"`{x}`") for x in names)).alias("row"), F.col(id_col).alias("_id"), digests[0].alias("_0"), digests[1].alias("_1"))
    return marked.dropDuplicates(["_id", "_0", "_1"]).select("row.*")
