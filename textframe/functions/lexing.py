"""From a record's text to its cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textframe.functions.escapes import from_latin1, let, to_latin1, unescape

#: Fixed values of the format: a cell up to its comma; quotes open and close anywhere, a backslash takes the next character.
_CELL = r'((?:[^",\\]++|\\[\s\S]|"(?:[^"\\]++|\\[\s\S])*+")*+),'
_ESCAPE_OR_QUOTE = r'(\\[\s\S])|"'
_QUOTED_OR_CR = r'("(?:[^"\\]++|\\[\s\S])*+")|(\\[\s\S])|\r'


def tokens(record: Column) -> Column:
    """The raw cells of a record: quotes and escapes still in them; CR is dropped where it is not quoted.

    Records without quotes and backslashes are split at commas. Others are lexed; one
    that is not UTF-8 is lexed byte by byte. A quote that is never closed is an error.
    """
    plain = F.split(F.when(record.contains("\r"), F.replace(record, F.lit("\r"), F.lit(""))).otherwise(record), ",", -1)

    def lexed(text: Column) -> Column:
        lone = F.when(text.endswith("\\"), F.length(F.regexp_extract(text, r"(\\+)\z", 1)) % 2 == 1).otherwise(False)
        cut = F.when(lone, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
        return let(F.when(cut.contains("\r"), F.regexp_replace(cut, _QUOTED_OR_CR, "$1$2")).otherwise(cut), matched)

    def matched(text: Column) -> Column:
        found = F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(_CELL), F.lit(1))
        return let(found, lambda cells: F.when(F.aggregate(cells, F.lit(0), lambda n, x: n + F.length(x) + 1) == F.length(text) + 1, cells).otherwise(fail))

    fail = F.raise_error(F.lit("a record ends with an open quote")).cast("array<string>")
    bytewise = let(to_latin1(record), lambda text: F.transform(lexed(text), from_latin1))
    special = record.contains('"') | record.contains("\\")
    return F.when(~F.is_valid_utf8(record), bytewise).when(special, let(record, lexed)).otherwise(plain)


def number_tokens(record: Column) -> Column:
    """The cells of a record that holds numbers only."""
    return F.split(F.when(record.contains("\r"), F.replace(record, F.lit("\r"), F.lit(""))).otherwise(record), ",", -1)


def is_quoted(token: Column) -> Column:
    """Whether any part of a raw cell is in quotes."""
    bare = F.regexp_replace(token, r"\\[\s\S]", "")
    return F.when(token.startswith('"'), True).when(token.contains('"'), bare.contains('"')).otherwise(False)


def cell_text(token: Column) -> Column:
    """A raw cell without its quotes, its escapes decoded."""

    bare = lambda text: F.regexp_replace(text, _ESCAPE_OR_QUOTE, "$1")

    def slow(cell: Column) -> Column:
        # where no quote can be escaped, they all go
        matched = F.when(F.is_valid_utf8(cell), bare(cell)).otherwise(from_latin1(let(to_latin1(cell), bare)))
        return let(F.when(cell.contains('\\"'), matched).otherwise(F.replace(cell, F.lit('"'), F.lit(""))), unescape)

    return F.when(token.contains('"') | token.contains("\\"), let(token, slow)).otherwise(token)


def checked(found: Column, n: int, at: Column | None = None) -> Column:
    """The cells, or an error if there are not n of them. at: the record's place, as text."""
    where = F.lit("") if at is None else F.concat(F.lit(" at "), at)
    message = F.concat(F.lit("a record has "), F.size(found).cast("string"), F.lit(f" cells, {n} are expected"), where)
    return F.when(F.size(found) == n, found).otherwise(F.raise_error(message).cast("array<string>"))


def once(found: Column) -> Column:
    """found, marked as not deterministic, so that it is computed once for each row that earlier filters leave.

    Otherwise later filters would be moved below, and lex (and fail on) lines that were filtered out.
    """
    return F.when(F.rand(0) + 1 > 0.5, found)  # always so, which the optimizer can't tell
