"""Records of delimited text.

Spark's text source cuts files into lines over their splits. Without quoted newlines a
line is a record. With them, a record goes on while a quote is open or the line's end is
escaped. Escapes never cross a line end, so each line has a number of quotes and says by
itself whether its end is escaped; the quotes of each split are summed in one pass, and
the sums before a split tell whether it begins inside a quote. With that known, the lines
of a split are joined where they are read, without a shuffle; only the pieces at both ends
of a split, which belong to records that cross splits, are grouped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textframe.functions.bytewise import BRIEF, CELLS, CLASS, RAW, SHORT, TEXT, BriefCutter, Cutter
from textframe.options import ReadOptions
from textframe.plans.order import BROADCAST_SPLITS, POSITION, near
from textframe.plans.storage import stored
from textframe.sources.header import Header, without_header

_RECORDS = "_file string, _block bigint, _row bigint, value binary"
_SCHEMA = f"{_RECORDS}, piece string"
_CUT = f"_file string, _block bigint, _row bigint, {CELLS}"
_BRIEF = f"_file string, _block bigint, _row bigint, {BRIEF}"
_BRIEF_OR_PIECE = f"{_BRIEF}, value binary, piece string"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _row, value, _length) for each line; CR stays in the line, and bytes stay as they are. _length: the file's."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"), "value", F.col("_metadata.file_size").alias("_length"))


def text_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a path that aren't empty, by name. Only their listing is read."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    return sorted(x for x, _ in listed.collect())


def quote_count(value: Column) -> Column:
    """Quotes of a line that are not escaped."""
    every = F.octet_length(value) - F.octet_length(F.replace(value, F.lit('"'), F.lit("")))
    # without pairs of backslashes, one before a quote escapes it
    single = F.replace(value, F.lit("\\\\"), F.lit(""))
    escaped = F.octet_length(single) - F.octet_length(F.replace(single, F.lit('\\"'), F.lit("\\")))
    return F.when(value.contains('\\"'), every - escaped).when(value.contains('"'), every).otherwise(0)


def end_escaped(value: Column) -> Column:
    """Whether a line ends with an odd number of backslashes."""
    return F.when(value.endswith("\\"), F.length(F.regexp_extract(value, r"(\\+)\z", 1)) % 2 == 1).otherwise(False)


def _quotes(line: bytes) -> int:
    """`quote_count` of a line's bytes."""
    every = line.count(b'"')
    return every - line.replace(b"\\\\", b"").count(b'\\"') if every and b'\\"' in line else every


def _tail(line: bytes) -> bool:
    """`end_escaped` of a line's bytes."""
    return line[-1:] == b"\\" and (len(line) - len(line.rstrip(b"\\"))) % 2 == 1


def splits(source: DataFrame, header: Header) -> DataFrame:
    """A row for each split: whether its first line goes on with a record, whether that is in a quote, whether its
    last line leaves a quote open (open) or has an escaped end (tail), whether the file has a last line end (ended),
    and whether a line like the header's first stands in it, unless it is one and begins the file (odd)."""
    value = F.col("value")
    like = value.cast("binary") == F.lit(bytearray(header.raw.split(b"\n")[0]))
    heads = [F.min(F.when(~value.isin("", "\r"), F.col("_row"))).alias("first"), F.min(F.when(like, F.col("_row"))).alias("at"), F.count_if(like).alias("n")]
    size = F.sum(F.octet_length(value).cast("long") + 1).alias("size")
    each = source.groupBy("_file", "_block", "_length").agg(F.sum(quote_count(value)).alias("quotes"), F.max_by(end_escaped(value), "_row").alias("tail"), size, *heads)
    ended = F.sum("size").over(Window.partitionBy("_file")) == F.col("_length")
    order = Window.partitionBy("_file").orderBy("_block")
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = before % 2 == 1
    return each.select("_file", "_block", inside.alias("inside"), (inside | F.coalesce(F.lag("tail").over(order), F.lit(False))).alias("goes_on"), ((before + F.col("quotes")) % 2 == 1).alias("open"), "tail", ended.alias("ended"), ((F.col("n") > 1) | F.coalesce(F.col("at") > F.col("first"), F.lit(False))).alias("odd"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list, list]]:
    """Joins the lines of each split to records: lists of `_SCHEMA`; 'head', 'middle' and 'tail' pieces cross splits."""
    now, waiting, row, inside, goes_on = None, [], 0, False, False
    files, blocks, rows, values, pieces = [], [], [], [], []

    def give(piece: str) -> None:
        nonlocal waiting
        files.append(now[0])
        blocks.append(now[1])
        rows.append(row)
        values.append(b"\n".join(waiting))
        pieces.append(piece)
        waiting = []

    for batch in batches:
        value = batch.column("value").to_pylist()
        quotes, tails = np.fromiter(map(_quotes, value), np.int64, len(value)), np.fromiter(map(_tail, value), bool, len(value))
        block, at = batch.column("_block").to_numpy(zero_copy_only=False), batch.column("_row").to_numpy(zero_copy_only=False)
        names = batch.column("_file").dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        for s, e in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True):
            this = (names.dictionary[int(code[s])].as_py(), int(block[s]))
            if this != now:
                if waiting:
                    give("middle" if goes_on else "tail")
                now, inside, goes_on = this, bool(batch.column("inside")[s].as_py()), bool(batch.column("goes_on")[s].as_py())
            odd = (np.cumsum(quotes[s:e]) + int(inside)) % 2 == 1
            ends = np.flatnonzero(~odd & ~tails[s:e])
            inside = bool(odd[-1])
            if not waiting and not goes_on and len(ends) == e - s:
                files += [now[0]] * (e - s)
                blocks += [now[1]] * (e - s)
                rows += at[s:e].tolist()
                values += value[s:e]
                pieces += [None] * (e - s)
                continue
            a = s
            for end in (ends + s).tolist():
                row = row if waiting else int(at[a])
                waiting += value[a : end + 1]
                give("head" if goes_on else None)
                goes_on, a = False, end + 1
            if a < e:
                row = row if waiting else int(at[a])
                waiting += value[a:e]
        if values:
            yield files, blocks, rows, values, pieces
            files, blocks, rows, values, pieces = [], [], [], [], []
    if waiting:
        give("middle" if goes_on else "tail")
    if values:
        yield files, blocks, rows, values, pieces


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces that cross splits."""
    for lists in _joined(batches):
        lists = _at([i for i, piece in enumerate(lists[4]) if piece], lists)
        if lists[0]:
            yield _batch(_SCHEMA, [pa.array(x, kind) for x, kind in zip(lists, _KINDS, strict=True)])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list, list]]:
    """`_joined` without the pieces that cross splits."""
    for lists in _joined(batches):
        yield _at([i for i, piece in enumerate(lists[4]) if not piece], lists)


def _at(places: list[int], lists: tuple[list, ...]) -> tuple[list, ...]:
    return lists if len(places) == len(lists[0]) else tuple([x[i] for i in places] for x in lists)


def _records(source: Callable) -> Callable:
    """A function of batches that gives the records of source."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in source(batches):
            yield _batch(_RECORDS, [pa.array(x, kind) for x, kind in zip(lists, _KINDS, strict=False)][:4])

    return found


def _batch(schema: str, columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])


def _cut(source: Callable, cutter: Cutter, keep: Callable[[int, int, bytes], bool]) -> Callable:
    """A function of batches that cuts the records of source to cells; those that are blank or not to be kept have gone."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in source(batches):
            yield _batch(_BRIEF if isinstance(cutter, BriefCutter) else _CUT, _cells(lists, cutter, keep))

    return cells


def _cells(lists: tuple[list, ...], cutter: Cutter, keep: Callable[[int, int, bytes], bool]) -> list[pa.Array]:
    at = [i for i, (block, row, value) in enumerate(zip(*lists[1:4], strict=True)) if value not in (b"", b"\r") and keep(block, row, value)]
    files, blocks, rows, values, _ = _at(at, lists)
    return [*_places(files, blocks, rows), *cutter(values, files, blocks)]


def _places(*lists: list) -> list[pa.Array]:
    return [pa.array(x, kind) for x, kind in zip(lists, _KINDS, strict=False)]


def _cut_and_pieces(cutter: BriefCutter, keep: Callable[[int, int, bytes], bool]) -> Callable:
    """As `_cut`, with the pieces that cross splits as rows without cells."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _joined(batches):
            whole = _cells(_at([i for i, piece in enumerate(lists[4]) if not piece], lists), cutter, keep)
            yield _batch(_BRIEF_OR_PIECE, [*whole, *(pa.nulls(len(whole[0]), kind) for kind in _KINDS[3:])])
            lists = _at([i for i, piece in enumerate(lists[4]) if piece], lists)
            if lists[0]:
                pieces = _places(*lists)
                yield _batch(_BRIEF_OR_PIECE, [*pieces[:3], *(pa.nulls(len(lists[0]), x.type) for x in whole[3:]), *pieces[3:]])

    return cells


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list, list]]:
    """Batches of records as `_joined` gives them."""
    for batch in batches:
        files, blocks, rows, values = (batch.column(x).to_pylist() for x in (*POSITION, "value"))
        yield files, blocks, rows, values, [None] * len(values)


class QuotedRecords:
    """The records of lines, joined over quoted and escaped line ends, without blank ones and the header."""

    def __init__(self, source: DataFrame, header: Header, files: list[str], options: ReadOptions):
        self.header, self.files, self.options = header, files, options
        known = stored(splits(source, header), "splits")
        self.last = known.groupBy("_file").agg(F.max_by(F.struct("open", "tail", "ended"), "_block").alias("x")).select("_file", "x.*")
        ends = self.last.agg(F.min(F.when(F.col("open"), F.col("_file"))).alias("wrong"), F.count_if(F.col("tail") & F.col("ended")).alias("kept")).first()
        if ends["wrong"]:
            raise ValueError(f"the file ends with an open quote: {ends['wrong']}")
        self.kept = ends["kept"]
        n, crosses, self.odd = known.agg(F.count(F.lit(1)), F.max("goes_on"), F.max(F.col("odd") & (F.col("_block") == 0))).first()
        of = known.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), "inside", "goes_on")
        rows = source.join(near(of, n), (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
        rows = rows.select("_file", "_block", "_row", F.col("value").cast("binary").alias("value"), "inside", "goes_on")
        if n > BROADCAST_SPLITS:
            rows = rows.repartition("_file", "_block").sortWithinPartitions("_file", "_block", "_row")
        self.rows = rows
        # what reads the records passes over the pieces that cross splits. If no record crosses splits, a piece is the
        # last record of a file whose end is escaped
        self.crosses, self.joined = crosses, _whole if crosses else _joined
        self.brief, self.of_brief = None, ()

    def _passed(self, through: Callable, schema: str) -> DataFrame:
        """What a function of batches makes of the lines: a pass over the whole input."""
        return self.rows.mapInArrow(through, schema)

    @cached_property
    def crossing(self) -> DataFrame | None:
        """The records that cross splits, joined once from at most two pieces for each split. `keep_brief` finds them on its way."""
        return stored(_crossing(self._passed(_pieces, _SCHEMA)), "crossing") if self.crosses else None

    @cached_property
    def frame(self) -> DataFrame:
        """(_file, _block, _row, value) for each record."""
        found = self._passed(_records(self.joined), _RECORDS)
        if self.crossing is not None:
            found = found.union(self.crossing)
        found = found.withColumn("value", F.col("value").cast("string"))
        if self.kept:
            kept = self.last.filter("tail and ended").select(F.col("_file").alias("_f"))
            # a file's last line end is data if it is escaped; the line reader has taken it away
            found = found.join(near(kept, self.kept), F.col("_file") == F.col("_f"), "left")
            found = found.select("_file", "_block", "_row", F.when(F.col("_f").isNotNull() & end_escaped(F.col("value")), F.concat("value", F.lit("\n"))).otherwise(F.col("value")).alias("value"))
        return _spread(without_header(_filled(found), self.header, self.files), self.options)

    def cells(self, asked: tuple[str, ...]) -> DataFrame:
        """Position and the arrays `_t` of cells and `_q` of whether they are quoted; asked: as of `Cutter`.

        Records are cut in the tasks that join them, without another way to Python and back, unless the
        header or an escaped end of a file has to be told by other rows. What `keep_brief` has kept isn't cut again.
        """
        if self.brief is not None and all(self._kept(i, x) for i, x in enumerate(asked)):
            return _spread(self.brief, self.options)
        cutter = Cutter(asked, self.options.convert_null_to_space)
        if self._by_frame:
            return self._by_rows(self.frame, cutter, lambda block, row, value: True)
        found = self._passed(_cut(self.joined, cutter, self._keep), _CUT)
        if self.crossing is not None:
            found = found.union(self._by_rows(self.crossing, cutter, self._keep))
        return _spread(found, self.options)

    def keep_brief(self, asked: tuple[str, ...], **how: bool) -> None:
        """Keeps the cells, without long texts, below spark.checkpoint.dir; asked, how: as of `BriefCutter`.

        In the same pass the pieces that cross splits are found. Columns without a long text, and lengths, are then
        read from there; RAW cells of a SHORT column too, so they may be asked of columns without any text only.
        """
        cutter = BriefCutter(asked, self.options.convert_null_to_space, **how)
        if self._by_frame:
            kept = stored(self._by_rows(self.frame, cutter, lambda block, row, value: True), "cells")
        elif self.crosses:
            made = stored(self._passed(_cut_and_pieces(cutter, self._keep), _BRIEF_OR_PIECE), "cells")
            pieces = made.filter(F.col("piece").isNotNull()).select(*POSITION, "value", "piece")
            self.crossing = stored(_crossing(pieces), "crossing")
            kept = made.filter(F.col("piece").isNull()).drop("value", "piece").union(stored(self._by_rows(self.crossing, cutter, self._keep), "cells"))
        else:
            kept = stored(self._passed(_cut(self.joined, cutter, self._keep), _BRIEF), "cells")
        self.brief, self.of_brief = kept, asked

    def sized(self, asked: tuple[str, ...]) -> DataFrame | None:
        """As `cells`, with the lengths `_n` of the texts that are left empty; None if not all of them are known."""
        known = lambda i, x: self._kept(i, x) or (x == TEXT and self.of_brief[i] == SHORT and self._left[i] >= 0)
        return _spread(self.brief, self.options) if self.brief is not None and all(known(i, x) for i, x in enumerate(asked)) else None

    def _kept(self, i: int, asked: str) -> bool:
        """Whether the brief cells of a column hold what is asked of it."""
        if asked == TEXT:
            return self.of_brief[i] == SHORT and i not in self._left
        return asked == CLASS or self.of_brief[i] in {RAW: (RAW, SHORT), SHORT: (SHORT,)}[asked]

    @cached_property
    def _left(self) -> dict[int, int]:
        """The columns that have left texts out of the brief cells, and the least of their lengths."""
        left = self.brief.filter(F.col("_n").isNotNull()).select(F.posexplode("_n").alias("i", "n"))
        return dict(left.filter(F.col("n").isNotNull()).groupBy("i").agg(F.min("n")).collect())

    @property
    def _by_frame(self) -> bool:
        return bool(self.kept or (len(self.files) > 1 and self.header.present and self.odd))

    @property
    def _keep(self) -> Callable[[int, int, bytes], bool]:
        """Whether a record, told by its place and text, is none of the header and the blank lines before it."""
        header = self.header
        if len(self.files) > 1:
            return lambda block, row, value: block or not header.present or value != header.raw
        first = (header.block, header.row + header.present)
        return lambda block, row, value: (block, row) >= first

    def _by_rows(self, records: DataFrame, cutter: Cutter, keep: Callable[[int, int, bytes], bool]) -> DataFrame:
        schema = _BRIEF if isinstance(cutter, BriefCutter) else _CUT
        return records.select(*POSITION, F.col("value").cast("binary").alias("value")).mapInArrow(_cut(_listed, cutter, keep), schema)


def _crossing(made: DataFrame) -> DataFrame:
    """Records that cross splits, joined from their pieces, which `made` holds."""
    order = Window.partitionBy("_file").orderBy("_block", "_row")
    part = made.withColumn("_group", F.count_if(F.col("piece") == "tail").over(order))
    joined = part.groupBy("_file", "_group").agg(F.array_sort(F.collect_list(F.struct("_block", "_row", "value"))).alias("x"))
    text = F.array_join(F.transform("x", lambda p: F.decode(p["value"], "ISO-8859-1")), "\n")
    return joined.select("_file", F.col("x")[0]["_block"].alias("_block"), F.col("x")[0]["_row"].alias("_row"), F.encode(text, "ISO-8859-1").alias("value"))


def _filled(found: DataFrame) -> DataFrame:
    return found.filter((F.col("value") != "") & (F.col("value") != "\r"))


def _spread(found: DataFrame, options: ReadOptions) -> DataFrame:
    if options.num_threads and found.rdd.getNumPartitions() < options.num_threads:
        found = found.repartition(options.num_threads)  # rows carry their places, so any order will do
    return found


def line_records(source: DataFrame, header: Header, files: list[str], options: ReadOptions) -> DataFrame:
    """(_file, _block, _row, value) for each line that isn't blank or the header."""
    return without_header(_spread(_filled(source), options), header, files)
