"""What each column means and the narrowest type that holds it.

One aggregate gathers, for each column, how many cells are strings, the bounds of its whole
numbers, whether there are fractions, and, if limits are set, the number and length of
distinct texts. The decision is taken on the driver from one row for each column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textframe.functions import classify, lexing
from textframe.options import ReadOptions

#: Rungs of whole numbers, narrowest first: name, least and greatest value, Spark's type.
LADDER = (
    ("uint8", 0, 2**8 - 1, T.ShortType()),
    ("int8", -(2**7), 2**7 - 1, T.ByteType()),
    ("int16", -(2**15), 2**15 - 1, T.ShortType()),
    ("int32", -(2**31), 2**31 - 1, T.IntegerType()),
    ("int64", -(2**63), 2**63 - 1, T.LongType()),
)
#: Codes of levels: name, most levels, Spark's type.
CODES = (("uint8", 2**8 - 1, T.ShortType()), ("uint16", 2**16 - 1, T.IntegerType()), ("uint32", 2**32 - 1, T.LongType()), ("uint64", 2**64 - 1, T.LongType()))
SPARK_TYPES = {name: kind for name, _, _, kind in LADDER} | {name: kind for name, _, kind in CODES} | {"float": T.FloatType(), "string": T.StringType()}


@dataclass(frozen=True)
class ColumnInfo:
    """A column's name, its meaning ('num', 'cat' or 'text') and its storage type."""

    name: str
    semantics: str
    dtype: str

    @property
    def metadata(self) -> dict[str, str]:
        return {"semantics": self.semantics, "dtype": self.dtype}


def storage(least: int | None, greatest: int | None, fractions: bool) -> str:
    """The narrowest rung that holds all values; columns without a value are uint8."""
    if fractions:
        return "float"
    low, high = least or 0, greatest or 0
    return next((name for name, a, b, _ in LADDER if a <= low and high <= b), "float")


def code_storage(levels: int) -> str:
    """The width of the codes of so many levels."""
    return next(name for name, most, _ in CODES if levels <= most)


def _whole(value: Column) -> Column:
    return (value == F.floor(value).cast("double")) & (F.abs(value) < 2.0**63)


def profile(cells: DataFrame, names: list[str], options: ReadOptions, text: Callable[[Column, Column], Column]) -> dict[int, Row]:
    """A row of aggregates for each column, by its place. cells: an array of raw cells `_t` for each record.

    Cells are put below each other and grouped by their place, so the plan has one classifier and
    a few sums however many columns there are; each task gives a row for each column. Columns whose
    meaning and type the caller has set have no row, and where all are set, nothing is read.
    text: the text of a cell, given the cell and whether it is quoted. An array `_q` may tell that of each cell, and with it
    `_n` the lengths of texts that aren't there, which differ if their cells do.
    """
    wanted = [i for i, name in enumerate(names) if not options.settled(name)]
    if not wanted:
        return {}
    told = "_q" in cells.columns
    of = lambda i: [F.col("_t")[i].alias("t"), *([F.col("_q")[i].alias("q"), F.col("_n")[i].alias("n")] if told else [])]
    some = F.array(*(F.struct(F.lit(i).alias("i"), *of(i)) for i in wanted))
    if len(wanted) < len(names):
        each = cells.select(F.inline(some))
    elif told:
        sizes = F.coalesce("_n", F.array().cast("array<int>"))  # the shorter array is filled up with nulls
        each = cells.select(F.col("_t").alias("t"), F.col("_q").alias("q"), sizes.alias("n")).select(F.posexplode(F.arrays_zip("t", "q", "n")).alias("i", "x")).select("i", "x.t", "x.q", "x.n")
    else:
        each = cells.select(F.posexplode("_t").alias("i", "t"))
    cell = F.col("t")
    kind, number, whole = F.col("kind"), F.col("number"), F.col("whole")
    if options.number_only:
        each = each.select("i", "t", classify.number_only_class(cell).alias("kind"))
        real, integer = classify.lenient_double(cell), classify.integer_prefix(cell)
    else:
        each = each if told else each.select("i", "t", lexing.is_quoted(cell).alias("q"), F.lit(None).cast("int").alias("n"))
        kinds = classify.cell_class(cell, F.col("q"))
        real, integer = classify.double_value(cell), classify.integer_value(cell)
        numeric = [i for i, name in enumerate(names) if options.forced(name) == "num"]
        if numeric:
            forced = F.when(cell.rlike(classify.EMPTY) & ~F.col("q"), "empty").when(cell.rlike(classify.INTEGER), "integer").otherwise("float")
            kinds = F.when(F.col("i").isin(numeric), forced).otherwise(kinds)
            real = F.when(F.col("i").isin(numeric), classify.lenient_double(lexing.cell_text(cell))).otherwise(real)
        shown = [text(cell, F.col("q")).alias("shown")] if options.limits else []
        each = each.select("i", "t", "n", kinds.alias("kind"), *shown)
    each = each.select("*", F.when(kind == "float", real).alias("number"), F.when(kind == "integer", integer).alias("whole"))
    value = F.coalesce(whole, F.when(_whole(number), number.try_cast("bigint")))
    if not options.number_only and options.empty_cell == "zero":
        value = F.coalesce(value, F.when(kind == "empty", F.lit(0).cast("bigint")))
    fraction = (kind == "missing") | ((kind == "float") & ~F.coalesce(_whole(number), F.lit(False))) | ((kind == "integer") & whole.isNull())
    sums = [F.count_if(kind == "string").alias("strings"), F.min(value).alias("low"), F.max(value).alias("high"), F.max(F.coalesce(fraction, F.lit(False))).alias("fractions")]
    if options.limits and not options.number_only:
        sums.append(F.max(F.coalesce("n", F.octet_length("shown"))).alias("longest"))
        if options.max_levels is not None:
            # 96 bits of hashes stand for the texts, which are not shuffled
            sums.append(F.count_distinct(F.when(F.col("shown").isNotNull(), F.struct("n", F.xxhash64("shown"), F.hash("shown")))).alias("levels"))
    return {row["i"]: row for row in each.groupBy("i").agg(*sums).collect()}


def decide(names: list[str], rows: dict[int, Row], options: ReadOptions) -> list[ColumnInfo]:
    """The meaning and storage of each column. Columns without a record are numeric, unless forced."""
    out = []
    for i, name in enumerate(names):
        row, forced = rows.get(i), options.forced(name)
        meaning = forced or ("cat" if row and row["strings"] else "num")
        if meaning == "cat" and options.limits and row and not options.number_only:
            long = options.max_level_name_length is not None and (row["longest"] or 0) > options.max_level_name_length
            many = options.max_levels is not None and row["levels"] > options.max_levels
            meaning = "text" if long or many else "cat"
        dtype = "string" if meaning != "num" else storage(row["low"], row["high"], row["fractions"]) if row else LADDER[0][0]
        out.append(ColumnInfo(name, meaning, dtype))
    return out
