"""Names of columns, from a file's first record."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textframe.functions.bytewise import unescape
from textframe.options import ReadOptions
from textframe.plans.order import near


@dataclass(frozen=True)
class Header:
    """names: of all columns. present: whether the first record is the header. block, row: where that record stands; raw: as it stands."""

    names: tuple[str, ...]
    present: bool
    block: int = 0
    row: int = -1
    raw: bytes = b""


def split_header(line: bytes) -> list[bytes]:
    """The names of a header record. Here, and only here, single quotes quote too."""
    names, cell, quote, at = [], bytearray(), None, 0
    while at < len(line):
        char = line[at : at + 1]
        if char == b"\\":
            cell += line[at : at + 2]
            at += 1
        elif quote:
            if char == quote:
                quote = None
            else:
                cell += char
        elif char in (b'"', b"'"):
            quote = char
        elif char == b",":
            names.append(bytes(cell))
            cell = bytearray()
        elif char != b"\r":
            cell += char
        at += 1
    return [*names, bytes(cell)]


def decode_name(name: bytes) -> str:
    """A name with its escapes decoded; NUL becomes a space."""
    return unescape(name).replace(b"\0", b" ").decode("utf-8", "replace")


def read_header(source: DataFrame, options: ReadOptions) -> Header:
    """The header of a file's lines. The first record is one if its names differ from each other and no_header isn't set.

    Only the first lines are read. A file of blanks has no columns.
    """
    shown = source.filter(F.col("value").rlike(r"[^ \t\x0B\f\r\n]") | F.col("value").endswith("\\"))
    first = shown.limit(1).select("_block", "_row", F.col("value").cast("binary")).collect()
    if not first:
        return Header((), True)
    block, row, value = first[0][0], first[0][1], bytes(first[0][2])
    quoted = options.allow_quoted_newlines and not options.number_only
    lines, read = 1, 1
    while quoted and read == lines and _goes_on(value):  # until the record ends, or the file
        lines *= 8
        later = source.filter(F.col("_row") >= row).limit(lines).select(F.col("value").cast("binary")).collect()
        read = len(later)
        found = [bytes(x) for (x,) in later]
        open_, ends = False, len(found)
        for i, line in enumerate(found):
            open_ ^= _quotes(line) % 2 == 1
            if not open_ and not _tail(line):
                ends = i + 1
                break
        value = b"\n".join(found[:ends])
    cells = [decode_name(x) for x in split_header(value.lstrip(b" \t\v\f\r\n"))]
    if options.no_header or len(set(cells)) < len(cells):
        return Header(tuple(f"col{i}" for i in range(len(cells))), False, block, row)
    return Header(tuple(cells), True, block, row, value)


def _quotes(line: bytes) -> int:
    """Quotes that are not escaped."""
    return re.sub(rb"\\[\s\S]", b"", line).count(b'"')


def _tail(line: bytes) -> bool:
    """Whether the end is escaped."""
    return (len(line) - len(line.rstrip(b"\\"))) % 2 == 1


def _goes_on(record: bytes) -> bool:
    """Whether a record has an open quote or an escaped end."""
    return _quotes(record) % 2 == 1 or _tail(record)


def find_header(read: Callable[[str], DataFrame], files: list[str], options: ReadOptions) -> Header:
    """The header of the first file, by name, that has one. read: gives the lines of a file."""
    header = Header((), True)
    for file in files:
        header = read_header(read(file), options)
        if header.names:
            break
    return header


def without_header(found: DataFrame, header: Header, files: list[str]) -> DataFrame:
    """Records without the header. Of several files, each may begin with the same header.

    Where every line like the header begins a file, as is usual, they are told by their text;
    only where that text is found elsewhere too, first lines are told by their place.
    """
    if len(files) <= 1:  # blank lines before the first record go too
        first = header.row + 1 if header.present else header.row
        return found.filter((F.col("_block") > header.block) | ((F.col("_block") == header.block) & (F.col("_row") >= first)))
    if not header.present:
        return found
    same = (F.col("value").cast("binary") == F.lit(bytearray(header.raw))) & (F.col("_block") == 0)
    at = F.min(F.when(same, F.col("_row")))
    each = found.filter("_block = 0").groupBy("_file").agg(F.min("_row").alias("first"), at.alias("at"), F.count_if(same).alias("n"))
    odd = each.filter("n > 1 or at > first")
    if odd.isEmpty():
        return found.filter(~same)
    first = each.filter("at = first").select(F.col("_file").alias("_f"), F.col("first").alias("_first"))
    return found.join(near(first, len(files)), (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_first")), "left_anti")
