"""Loading delimited text into typed frames, and delivering them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textframe.functions import classify, lexing
from textframe.functions.bytewise import CLASS, RAW, SHORT, TEXT
from textframe.functions.escapes import let, null_to_space
from textframe.operators import levels as levels_
from textframe.options import ReadOptions, input_path
from textframe.plans.infer import SPARK_TYPES, ColumnInfo, code_storage, decide, profile
from textframe.plans.order import POSITION, in_order
from textframe.plans.storage import stored
from textframe.sources.header import Header, find_header
from textframe.sources.records import QuotedRecords, line_records, lines, text_files

_NUMPY = {"float": "float32"}


class TextFrame:
    """A loaded file: its columns' meanings and types, and DataFrames of its values.

    Nothing is read again until a DataFrame is used; only the header and one row of
    aggregates have been read by then.
    """

    def __init__(self, header: Header, columns: list[ColumnInfo], cells: Cells | None, options: ReadOptions, spark: SparkSession):
        self.header, self.columns, self.options, self.spark = header, columns, options, spark
        self._cells = cells
        self._sizes: dict[int, int] = {}
        self._tables: dict[int, DataFrame] = {}

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def info(self, name: str) -> ColumnInfo:
        return self.columns[self._at(name)]

    def _at(self, name: str) -> int:
        try:
            return self.names.index(name)
        except ValueError:
            raise KeyError(name) from None

    @cached_property
    def _placed(self) -> DataFrame:
        """Position and values c0, c1, ..."""
        return self._only(range(len(self.columns)))

    def _only(self, wanted: Iterable[int]) -> DataFrame:
        """Position and the values of some columns, named by their places."""
        wanted = list(wanted)
        return values(self._cells.rows(self._asked(wanted)), self.columns, self.options).select(*POSITION, *(f"c{i}" for i in wanted))

    def _asked(self, wanted: Iterable[int]) -> tuple[str, ...]:
        asked = {i: TEXT if self.columns[i].dtype == "string" else RAW for i in wanted}
        return tuple(asked.get(i, CLASS) for i in range(len(self.columns)))

    def placed(self) -> DataFrame:
        """The rows' places in the files (`_file`, `_block`, `_row`) and the columns c0, c1, ... in the order of the file."""
        return self._placed if self._cells is not None else self._empty()

    def _shown(self, i: int, c: ColumnInfo) -> Column:
        value = F.col(f"c{i}")
        return value.cast("binary") if c.dtype == "string" and self.options.out_encoding == "unknown" else value

    def _named(self, frame: DataFrame, ordered: bool, columns: list[ColumnInfo] | None = None) -> DataFrame:
        frame = in_order(frame) if ordered else frame
        return frame.select(*(self._shown(i, c).alias(c.name, metadata=c.metadata) for i, c in enumerate(columns or self.columns)))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], T.StructType([]))

    def expanded(self, ordered: bool = False) -> DataFrame:
        """Numbers and texts. ordered: rows in file order, which costs a sort."""
        if self._cells is None:
            return self._empty()
        return self._named(self._placed, ordered)

    def encoded(self, ordered: bool = False) -> DataFrame:
        """Numbers and texts, with the codes of their levels in place of categorical columns."""
        if self._cells is None:
            return self._empty()
        frame, columns = self._coded()
        return self._named(frame, ordered, columns)

    def _coded(self) -> tuple[DataFrame, list[ColumnInfo]]:
        frame, columns = self._placed, []
        for i, c in enumerate(self.columns):
            if c.semantics == "cat":
                frame = levels_.encoded(frame, f"c{i}", self._table(i), self.level_count(c.name))
                c = ColumnInfo(c.name, "cat", code_storage(self.level_count(c.name)))
            columns.append(c)
        return frame, columns

    def _table(self, i: int) -> DataFrame:
        if i not in self._tables:
            self._tables[i] = levels_.level_table(self._only([i]), f"c{i}")
        return self._tables[i]

    def levels(self, name: str) -> DataFrame:
        """(code, level) of a categorical column."""
        i = self._at(name)
        if self.columns[i].semantics != "cat":
            raise ValueError(f"{name} is not categorical")
        return self._table(i)

    def level_count(self, name: str) -> int:
        i = self._at(name)
        if i not in self._sizes:
            self._sizes[i] = self.levels(name).count()
        return self._sizes[i]

    def code_dtype(self, name: str) -> str:
        return code_storage(self.level_count(name))

    def level_list(self, name: str) -> list:
        """The levels in the order of their codes, on the driver."""
        out = [bytes(x) for (x,) in self.levels(name).orderBy("code").select(F.col("level").cast("binary")).collect()]
        return out if self.options.out_encoding == "unknown" else [_decoded(x) for x in out]

    def count(self) -> int:
        return self._cells.count() if self._cells is not None else 0

    def column(self, name: str) -> DataFrame:
        """One column, expanded; the others are not computed."""
        i = self._at(name)
        return self._only([i]).select(self._shown(i, self.columns[i]).alias(name, metadata=self.columns[i].metadata))

    def sums(self) -> DataFrame:
        """One row: the sum of each numeric column, and of the byte lengths of each other column."""
        if self._cells is None:
            return self._empty()
        rows = self._cells.sized(self._asked(range(len(self.columns))))
        frame = self._placed if rows is None else values(rows, self.columns, self.options, ("_n",))
        size = lambda i: F.octet_length(f"c{i}") if rows is None else F.coalesce(F.col("_n")[i], F.octet_length(f"c{i}"))
        each = [F.sum(size(i)) if c.dtype == "string" else F.sum(F.col(f"c{i}").cast("double" if c.dtype == "float" else "long")) for i, c in enumerate(self.columns)]
        return frame.agg(*(x.alias(c.name) for x, c in zip(each, self.columns, strict=True)))

    # delivery to the driver

    def to_pandas(self):
        """A pandas frame of numbers and texts, in file order."""
        import pandas as pd

        table = self.expanded(ordered=True).toArrow() if self._cells is not None else None
        if table is None:
            return pd.DataFrame()
        return pd.DataFrame({c.name: _numpy(table.column(i), c) for i, c in enumerate(self.columns)})

    def to_dict(self) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """(frame, levels): arrays of numbers, texts and codes by name, and the levels of categorical columns."""
        frame, found = {}, {}
        for name, data, semantics, names in self.iter_columns(expand=False):
            frame[name] = data
            if semantics == "cat":
                found[name] = names
        return frame, found

    def iter_columns(self, expand: bool = True, forget: bool = True) -> Iterator[tuple[Any, ...]]:
        """(name, data) for each column if expand, else (name, data, semantics, levels), in file order.

        The file is parsed once, into columns below spark.checkpoint.dir, which are brought to the
        driver one at a time. forget: accepted; nothing is kept on the driver in any case.
        """
        if self._cells is None:
            return
        frame, columns = (self._placed, self.columns) if expand else self._coded()
        kept = stored(frame, "columns")
        for i, c in enumerate(columns):
            table = in_order(kept.select(*POSITION, f"c{i}")).select(self._shown(i, c)).toArrow()
            data = _numpy(table.column(0), c)
            if expand:
                yield c.name, data
            else:
                yield c.name, data, c.semantics, np.array(self.level_list(c.name) if c.semantics == "cat" else [], object)


def _decoded(cell: bytes | None) -> str | bytes | None:
    """A cell as str, or as the bytes it is if they are not UTF-8."""
    try:
        return cell if cell is None else cell.decode()
    except UnicodeDecodeError:
        return cell


def _numpy(column, info: ColumnInfo) -> np.ndarray:
    if info.dtype == "string":
        cells = column.to_pylist() if pa.types.is_binary(column.type) else [_decoded(x) for x in column.cast(pa.binary()).to_pylist()]
        out = np.empty(len(cells), object)
        out[:] = cells
        return out
    kind = _NUMPY.get(info.dtype, info.dtype)
    if column.null_count:
        return column.to_pandas().to_numpy(float, na_value=np.nan)
    return column.to_numpy().astype(kind)


def cell_string(token: Column, quoted: Column, options: ReadOptions, done: bool = False) -> Column:
    """The text of a cell in a string column: numbers as if the column had been one of strings from its first cell.

    done: quoted cells are texts already.
    """
    empty = F.lit("") if options.empty_cell == "zero" else F.lit(None).cast("string")

    def text(cell: Column) -> Column:
        return let(lexing.cell_text(cell), null_to_space) if options.convert_null_to_space else lexing.cell_text(cell)

    def other(cell: Column) -> Column:
        kind, real = classify.cell_class(cell), classify.float_text(classify.double_value(cell))
        number = F.coalesce(classify.integer_value(cell).cast("string"), real)
        return F.when(kind == "integer", number).when(kind == "float", real).when(kind == "missing", "nan").when(kind == "empty", empty).otherwise(text(cell))

    # what begins like no number is told apart without their patterns
    plain = token.rlike(r"\A[^\s0-9.?nN-]")
    told = F.when(quoted, token).when(plain, text(token)) if done else F.when(quoted | plain, text(token))
    return told.when(token.rlike(classify.PLAIN), token).otherwise(let(token, other))


def _value(i: int, info: ColumnInfo, options: ReadOptions, done: bool) -> Column:
    """The value of a cell, in its column's type."""
    token = F.col(f"t{i}")
    if info.dtype == "string":
        return cell_string(token, F.lit(False) if options.number_only else F.col(f"q{i}"), options, done)
    kind = SPARK_TYPES[info.dtype]
    zero = F.lit(0) if options.empty_cell == "zero" or options.number_only else F.lit(None)
    nan = F.lit(float("nan"))

    def real(cell: Column) -> Column:
        if options.number_only:
            what = classify.number_only_class(cell)
            return F.when(what == "missing", nan).when(what == "float", classify.lenient_double(cell)).otherwise(classify.integer_prefix(cell).cast("double"))
        if forced:
            return F.when(cell.rlike(classify.EMPTY), zero.cast("double")).otherwise(classify.lenient_double(lexing.cell_text(cell)))
        return F.when(cell.rlike(classify.MISSING), nan).otherwise(zero.cast("double"))

    def whole(cell: Column) -> Column:
        """What is left are floats that are whole, missing digits, and numbers with something after them."""
        if options.number_only:
            return F.when(classify.number_only_class(cell) == "float", classify.lenient_double(cell).try_cast("bigint")).otherwise(classify.integer_prefix(cell))
        if forced:
            return F.when(cell.rlike(classify.EMPTY), zero.cast("bigint")).otherwise(F.coalesce(classify.integer_value(cell), classify.lenient_double(lexing.cell_text(cell)).try_cast("bigint")))
        return F.coalesce(classify.integer_value(cell), classify.double_value(cell).try_cast("bigint"), zero.cast("bigint"))

    forced = options.forced(info.name) == "num"
    number = F.ltrim(token, F.lit(classify.BLANKS))
    if info.dtype == "float":
        return F.when(token.rlike(classify.NUMBER), number.try_cast("double")).otherwise(let(token, real)).cast("float")
    return F.when(token.rlike(classify.SHORT), number.try_cast("bigint")).otherwise(let(token, whole)).cast(kind)


def token_rows(found: DataFrame, n: int, options: ReadOptions) -> DataFrame:
    """Position and the array `_t` of the n raw cells of each record."""
    cut = lexing.number_tokens(F.col("value")) if options.number_only else lexing.tokens(F.col("value"))
    place = F.concat(F.col("_file"), F.lit(", after byte "), F.col("_block").cast("string"))
    return found.select(*POSITION, lexing.once(lexing.checked(cut, n, place)).alias("_t"))


def values(rows: DataFrame, columns: list[ColumnInfo], options: ReadOptions, keep: tuple[str, ...] = POSITION) -> DataFrame:
    """The values c0, c1, ... of the cells `_t`, in their columns' types. Raw cells, unless `_q` tells of them."""
    n, done = range(len(columns)), "_q" in rows.columns
    told = [F.col("_q")[i].alias(f"q{i}") for i in n] if done else []
    rows = rows.select(*keep, *(F.col("_t")[i].alias(f"t{i}") for i in n), *told)
    if not options.number_only and not done:
        rows = rows.select("*", *(lexing.is_quoted(F.col(f"t{i}")).alias(f"q{i}") for i in n))
    return rows.select(*keep, *(_value(i, c, options, done).alias(f"c{i}", metadata=c.metadata) for i, c in enumerate(columns)))


class Cells:
    """The cells of a file's records. With quoted newlines they are cut where records are joined, else by expressions."""

    def __init__(self, source: DataFrame, header: Header, files: list[str], options: ReadOptions):
        self._n, self._options = len(header.names), options
        self.quoted = options.allow_quoted_newlines and not options.number_only
        self._records = (QuotedRecords if self.quoted else line_records)(source, header, files, options)

    def rows(self, asked: tuple[str, ...]) -> DataFrame:
        """Position, the array `_t` of cells, raw or as `Cutter` gives them, and there whether they are quoted (`_q`)."""
        return self._records.cells(asked) if self.quoted else token_rows(self._records, self._n, self._options)

    def sized(self, asked: tuple[str, ...]) -> DataFrame | None:
        """As `rows`, with the lengths `_n` of texts in place of long ones, if inference has kept them."""
        return self._records.sized(asked) if self.quoted else None

    def count(self) -> int:
        return (self._records.frame if self.quoted else self._records).count()

    def profile(self, names: list[str]) -> dict:
        """Aggregates for inference. Texts, or what stands for long ones, are needed where there are limits, raw cells where a column is forced to be numeric."""
        options = self._options
        other = SHORT if options.limits else CLASS
        if all(options.settled(name) for name in names):
            return {}
        if self.quoted:
            asked = (RAW if options.forced(name) == "num" else CLASS if options.settled(name) else SHORT for name in names)
            self._records.keep_brief(tuple(asked), strict=options.limits, digests=options.max_levels is not None)
        rows = self.rows(tuple(RAW if options.forced(name) == "num" else CLASS if options.settled(name) else other for name in names))
        return profile(rows, names, options, lambda t, q: cell_string(t, q, options, self.quoted))


def read_csv(spark: SparkSession, path: str, columns: list[ColumnInfo] | None = None, **options: Any) -> TextFrame:
    """Loads delimited text. options: those of `ReadOptions`.

    columns: the meanings and types of all columns, as another file of the same layout was found to
    have (`TextFrame.columns`). With them nothing is inferred, and cells are read once; a cell that doesn't
    fit its column is an error or, in a float column, lenient as in inference.
    """
    chosen = ReadOptions(**options)
    files = text_files(spark, input_path(path))
    header = find_header(lambda file: lines(spark, file), files, chosen)
    if not header.names:
        return TextFrame(header, [], None, chosen, spark)
    names = list(header.names)
    if columns is not None and [c.name for c in columns] != names:
        raise ValueError(f"columns {[c.name for c in columns]} are given, the file has {names}")
    cells = Cells(lines(spark, input_path(path)), header, files, chosen)
    if columns is None:
        columns = decide(names, cells.profile(names), chosen)
    return TextFrame(header, list(columns), cells, chosen, spark)


# one call for each form of delivery


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def load_csv_to_pandas(filename: str, **options: Any):
    """A pandas frame of numbers and texts."""
    return read_csv(_session(), filename, **options).to_pandas()


def load_csv_to_dict(filename: str, **options: Any) -> tuple[dict, dict]:
    """(frame, levels): arrays by name, with codes for categorical columns, and the levels of those."""
    return read_csv(_session(), filename, **options).to_dict()


def load_csv_to_expanded_columns(filename: str, forget: bool = True, **options: Any) -> Iterator[tuple]:
    """(name, numbers or texts) for each column."""
    return read_csv(_session(), filename, **options).iter_columns(expand=True, forget=forget)


def load_raw_csv(filename: str, forget: bool = True, **options: Any) -> Iterator[tuple]:
    """(name, data, semantics, levels) for each column."""
    return read_csv(_session(), filename, **options).iter_columns(expand=False, forget=forget)


def load_csv_as_iterator(filename: str, expand: bool = True, forget: bool = True, **options: Any) -> Iterator[tuple]:
    """As `load_csv_to_expanded_columns`, or `load_raw_csv` if expand is not set."""
    return read_csv(_session(), filename, **options).iter_columns(expand=expand, forget=forget)


def get_num_cores() -> int:
    """How many tasks Spark runs at once."""
    return _session().sparkContext.defaultParallelism
