"""What a cell is: missing, integer, float or string; and its value as a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textframe.functions.escapes import let

#: Fixed values of the format: patterns of unquoted cells (leading blanks are allowed, trailing ones are not).
MISSING = r"\A[ \t\n\x0B\f\r]*(?:\?|[nN][aA][nN])\z"
INTEGER = r"\A[ \t\n\x0B\f\r]*-?[0-9]+\z"
FLOAT = r"\A[ \t\n\x0B\f\r]*-?(?:[0-9]*\.[0-9]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+)\z"
EMPTY = r"\A[ \t\n\x0B\f\r]*-?\z"
#: The longest beginning that reads as a number, for columns forced to be numeric.
_PREFIX = r"\A[ \t\n\x0B\f\r]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_FRACTION = r"\A[ \t\n\x0B\f\r]*-?[0-9]*[.eE]"
_NUMBER_ONLY = r"\A[ \t\n\x0B\f\r]*(-?[0-9]*)"
#: Whole numbers that any cast takes, and whatever is an integer or a float.
SHORT = r"\A[ \t\n\x0B\f\r]*-?[0-9]{1,18}\z"
NUMBER = r"\A[ \t\n\x0B\f\r]*-?(?:[0-9]+|[0-9]*\.[0-9]+|(?:[0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+)\z"
#: Whole numbers that are written as they are read.
PLAIN = r"\A(?:0|-?[1-9][0-9]{0,17})\z"
BLANKS = " \t\n\v\f\r"


def cell_class(cell: Column, quoted: Column | None = None) -> Column:
    """'missing', 'integer', 'float', 'empty' or 'string'. Quoted cells are always strings."""
    out = F.when(cell.rlike(INTEGER), "integer").when(cell.rlike(FLOAT), "float").when(cell.rlike(MISSING), "missing").when(cell.rlike(EMPTY), "empty").otherwise("string")
    return out if quoted is None else F.when(quoted, "string").otherwise(out)


def number_only_class(cell: Column) -> Column:
    """The class under number_only: what begins with digits and a point or exponent is a float, all else an integer."""
    # no cell is both; numbers are the most frequent
    return F.when(cell.rlike(SHORT), "integer").when(cell.rlike(_FRACTION), "float").when(cell.rlike(MISSING), "missing").otherwise("integer")


def integer_value(cell: Column) -> Column:
    """An integer cell as bigint; null if it does not fit, and for other cells.

    Casts that fail are dear, so the patterns, which are cheap, come first.
    """
    text = F.ltrim(cell, F.lit(BLANKS))
    return F.when(cell.rlike(SHORT), text.try_cast("bigint")).when(cell.rlike(INTEGER), text.try_cast("bigint"))


def double_value(cell: Column) -> Column:
    """An integer or float cell as double; null for other cells."""
    return F.when(cell.rlike(NUMBER), F.ltrim(cell, F.lit(BLANKS)).try_cast("double"))


def integer_prefix(cell: Column) -> Column:
    """Digits at the start, as bigint; 0 if there are none, or too many."""

    def found(text: Column) -> Column:
        prefix = F.regexp_extract(text, _NUMBER_ONLY, 1)
        return F.when(prefix.rlike("[0-9]"), prefix.try_cast("bigint"))

    # most cells need no pattern but the first
    return F.coalesce(F.when(cell.rlike(SHORT), F.ltrim(cell, F.lit(BLANKS)).try_cast("bigint")).otherwise(let(cell, found)), F.lit(0).cast("bigint"))


def lenient_double(cell: Column) -> Column:
    """A number from any text: its longest numeric beginning, else 0; NaN for empty texts and those that begin with n or ?."""

    def other(token: Column) -> Column:
        first, prefix = F.substring(F.ltrim(token, F.lit(BLANKS)), 1, 1), F.regexp_extract(token, _PREFIX, 1)
        found = F.when(prefix != "", prefix.try_cast("double"))
        return F.when(first.isin("", "n", "N", "?"), F.lit(float("nan"))).when(first.between("0", "9") | first.isin("-", "+", "."), F.coalesce(found, F.lit(0.0))).otherwise(0.0)

    # most cells need no pattern but the first
    return F.when(cell.rlike(NUMBER), F.ltrim(cell, F.lit(BLANKS)).try_cast("double")).otherwise(let(cell, other))


def float_text(value: Column) -> Column:
    """A number as text of a string column: six decimals of its 32-bit value; nan for NaN."""
    return F.when(F.isnan(value), "nan").otherwise(F.format_string("%f", value.cast("float").cast("double")))
