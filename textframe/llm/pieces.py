"""SentencePiece encoding and decoding through a table of distinct chunks.

If no piece of a model has the white-space marker after another character, merges
never cross from a character into a following marker, so a text falls apart into
chunks (a run of markers and the word after it) that can be segmented one by one.

A first pass counts the distinct chunks of all texts (summed in each task before the
shuffle). The most frequent ones, at most TABLE_SIZE of at most LONGEST characters, are
segmented once each and broadcast: a bound that does not grow with the corpus. The second
pass finds each part's distinct chunks, takes those of the table from it, segments the
others (rare ones, that a part has seldom more than once) together, and joins ids and
decoded texts back by position. What is in the table changes no result.

Nulls count as empty texts. Empty texts have no ids and decode to an empty text.
Rows are neither merged nor dropped, whatever their ids, so repeated rows give
repeated results. Only the two named columns are read; any others are ignored. An empty
table gives no rows. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textframe.llm._common import stored

MARK = "▁"
#: Chunks in the broadcast table at most, and their characters at most.
TABLE_SIZE = 400_000
LONGEST = 32
DEFAULT_MODEL = "piece_bpe_32k.model"
_PART = 4_000_000
_CHUNKS = re.compile(r" *[^ ]+| +\Z")
_segmenters: dict[bytes, Segmenter] = {}


class Chunks:
    """Segmented chunks: their ids end to end, and their texts when decoded after another chunk."""

    def __init__(self, lengths: np.ndarray, ids: np.ndarray, decoded: pa.Array):
        self.lengths, self.ids, self.decoded = lengths, ids, decoded
        self.starts = np.cumsum(lengths) - lengths

    def join(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks at these places, end to end, and how many each has."""
        n = self.lengths[at]
        shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return self.ids[np.repeat(self.starts[at], n) + shift], n


def together(a: Chunks, b: Chunks) -> Chunks:
    return Chunks(np.concatenate([a.lengths, b.lengths]), np.concatenate([a.ids, b.ids]), pa.concat_arrays([a.decoded, b.decoded]))


class Segmenter:
    """Encodes as the library does when called on the whole text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        #: Whether the premise holds; if not, whole texts go to the library.
        self.by_chunk = not any(MARK in x.lstrip(MARK) for x in pieces) and p.encode(" a  b ", out_type=str)[0].startswith(MARK) and p.decode(p.encode("a  b ")) == "a  b " and p.piece_to_id("x") != p.unk_id() and p.piece_to_id(MARK) != p.unk_id()
        self.mark, self.lead = p.piece_to_id(MARK), p.piece_to_id("x")
        self.shown = pa.array([x.replace(MARK, " ") for x in pieces], pa.large_string())
        #: Pieces that don't stand for their own characters.
        self.special = np.array([p.is_byte(i) or p.is_unknown(i) or p.is_control(i) for i in range(len(pieces))])

    def segment(self, chunks: list[str]) -> Chunks:
        """chunks: without their first marker."""
        ids = self.processor.encode(chunks, num_threads=1) if chunks else []
        if "" in chunks:
            ids = [x or [self.mark] for x in ids]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        ends = np.append(0, np.cumsum(lengths))
        decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), self.shown.take(pa.array(flat))), pa.scalar("", pa.large_string()))
        odd = np.unique(np.searchsorted(ends, np.flatnonzero(self.special[flat]), "right") - 1)
        if len(odd):
            mask = np.zeros(len(ids), bool)
            mask[odd] = True
            slow = self.processor.decode([[self.lead, *ids[i]] for i in odd.tolist()], num_threads=1)
            decoded = pc.replace_with_mask(decoded, pa.array(mask), pa.array([x[1:] for x in slow], pa.large_string()))
        return Chunks(lengths, flat, decoded)

    def both(self, text: str) -> tuple[list[int], str]:
        """The ids of a text, and the text that they decode to."""
        ids, n, decoded = self.batch(pa.array([text], pa.large_string()), None)
        return ids.tolist(), decoded[0].as_py()

    def batch(self, texts: pa.Array, table: Table | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The ids of all texts end to end, how many each has, and what they decode to."""
        if not self.by_chunk:
            ids = self.processor.encode(texts.to_pylist(), num_threads=1)
            return np.fromiter((i for x in ids for i in x), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)), pa.array(self.processor.decode(ids, num_threads=1) if ids else [], pa.large_string())
        cut = chunks(texts)
        offsets = cut.offsets.to_numpy().astype(np.int64)
        found = cut.flatten().dictionary_encode()
        at, distinct = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
        if table is None:
            known = self.segment(distinct.to_pylist())
        else:
            place = pc.index_in(distinct, table.names)
            rare = place.is_null()
            known = together(table.chunks, self.segment(distinct.filter(rare).to_pylist()))
            place, rare = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), rare.to_numpy(zero_copy_only=False)
            place[rare] = len(table.names) + np.arange(int(rare.sum()))
            at = place[at]
        ids, n = known.join(at)
        ends = np.append(0, np.cumsum(n))[offsets]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), known.decoded.take(pa.array(at)))
        decoded = pc.utf8_slice_codeunits(pc.binary_join(lists, pa.scalar("", pa.large_string())), 1)  # the first chunk's marker is not shown
        return ids, np.diff(ends), decoded


class Table:
    """The broadcast table."""

    def __init__(self, names: pa.Array, chunks: Chunks):
        self.names, self.chunks = names, chunks


def chunks(texts: pa.Array) -> pa.LargeListArray:
    """The chunks of each text, without the first marker of each."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), MARK, " ")
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " ")), pc.equal(texts, ""))
    plain = pc.split_pattern(texts, " ").cast(pa.large_list(pa.large_string()))
    if not pc.any(odd).as_py():
        return plain
    odd = odd.to_numpy(zero_copy_only=False)
    slow = pa.array([[x[1:] for x in _CHUNKS.findall(" " + t)] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()], pa.large_list(pa.large_string()))
    order = np.where(odd, len(plain) + np.cumsum(odd) - 1, np.arange(len(plain)))
    return pa.concat_arrays([plain, slow]).take(pa.array(order))


def segmenter(model: bytes) -> Segmenter:
    """One for each Python worker and model."""
    if model not in _segmenters:
        _segmenters.clear()
        _segmenters[model] = Segmenter(model)
    return _segmenters[model]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_MODEL)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from textframe.llm._common import parts

    for batch in parts(batches, "text", _PART):
        found = pc.value_counts(chunks(batch.column("text")).flatten())
        names, n = found.field(0), found.field(1)
        short = pc.less_equal(pc.utf8_length(names), LONGEST)
        yield pa.RecordBatch.from_arrays([names.filter(short).cast(pa.string()), n.filter(short)], ["chunk", "n"])


def table(docs: DataFrame, model: bytes, text_col: str = "text", size: int = TABLE_SIZE) -> Table:
    """The most frequent chunks of all texts, each segmented once."""
    seg = segmenter(model)
    if not seg.by_chunk:
        return Table(pa.array([], pa.large_string()), seg.segment([]))
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_counts, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))
    counts = stored(counts.filter("n > 1").withColumn("class", F.floor(F.log2("n") * 8).cast("int")), "chunks")
    # the classes of frequency, most frequent first, that hold no more than `size` chunks together; no sort, no single task
    least, held = 1 << 30, 0
    for of, n in sorted(counts.groupBy("class").count().collect(), reverse=True):
        held += n
        if held > size:
            break
        least = of
    often = counts.filter(F.col("class") >= least).select("chunk")

    def segmented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(model)
        for batch in batches:
            got = seg.segment(batch.column(0).to_pylist())
            ids = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(got.lengths))), pa.array(got.ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(pa.list_(pa.int32())), got.decoded.cast(pa.string())], ["chunk", "ids", "decoded"])

    got = often.mapInArrow(segmented, "chunk string, ids array<int>, decoded string").toArrow().combine_chunks()
    flat = lambda name, kind: pa.concat_arrays([x.cast(kind) for x in got.column(name).chunks]) if got.num_rows else pa.array([], kind)
    ids = flat("ids", pa.large_list(pa.int32()))
    return Table(flat("chunk", pa.large_string()), Chunks(np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy(zero_copy_only=False), flat("decoded", pa.large_string())))


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """(id_col, ids array<int>, decoded string) for each row of docs. model: a file's path on the driver.

    Two narrow passes; only counts of chunks are shuffled. The model file (about 0.5 MB) travels with the task.
    """
    content = Path(model or default_model()).read_bytes()
    shared = docs.sparkSession.sparkContext.broadcast(table(docs, content, text_col, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = segmenter(content)
        from textframe.llm._common import parts

        for batch in parts(batches, "text", _PART):
            ids, n, decoded = seg.batch(batch.column("text"), shared.value)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, decoded.cast(pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """What op6 returns: counts and digests of ids and decoded texts."""
    return encode(docs, model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
