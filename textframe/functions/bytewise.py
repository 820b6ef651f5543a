"""The lexer and the escapes again, on bytes in Python tasks: there, patterns and codecs pass over a record some ten times as fast.

What a record's cells are, whether they are quoted and what their texts are is as in `lexing` and `escapes`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa

from textframe.functions.escapes import DECODED

#: Fixed values of the format, as in `lexing` and `escapes`.
_CELL = re.compile(rb'((?:[^",\\]++|\\.|"(?:[^"\\]++|\\.)*+")*+),', re.S)
_QUOTED_OR_CR = re.compile(rb'("(?:[^"\\]++|\\.)*+")|(\\.)|\r', re.S)
_ESCAPE_OR_QUOTE = re.compile(rb'(\\.)|"', re.S)
_ESCAPED = re.compile(rb"\\.", re.S)
_UNIT = re.compile(rb"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[\s\S]|\Z)")
#: Escapes that mean the same to Python's codec, those of most texts first.
_SHARED = (b"\\x", b"\\'", b'\\"', b"\\n", b"\\r", b"\\t", b"\\b", b"\\f", b"\\v")
#: Those of one byte, other than of a quote.
_LETTERS = tuple(x for x in _SHARED if x not in (b"\\x", b'\\"'))
#: Bytes that cells other than strings begin with.
_NUMBER_LIKE = frozenset(b" \t\n\v\f\r0123456789.?nN-")

#: What is asked of a column's cells. RAW: as they stand. TEXT: quoted ones, and those that begin like no number, as
#: their text. CLASS: quoted ones are left empty, as nothing but that they are quoted is asked. SHORT: as TEXT, but texts
#: of more than `SHORT_BYTES` are left out and their lengths are given.
RAW, TEXT, CLASS, SHORT = "raw", "text", "class", "short"
SHORT_BYTES = 128
CELLS = "_t array<string>, _q array<boolean>"
#: `_n`: for each cell whose text is left out the bytes of that, -1 if that isn't known; else null, as for records without any.
BRIEF = f"{CELLS}, _n array<int>"


def tokens(record: bytes) -> list[bytes]:
    """The raw cells of a record, as `lexing.tokens`. No pattern is needed where each cell is wholly in quotes or without any."""
    if b'"' not in record and b"\\" not in record:
        return record.replace(b"\r", b"").split(b",")
    if record[-1:] == b"\\" and (len(record) - len(record.rstrip(b"\\"))) % 2:
        record = record[:-1]
    return _simple_tokens(record) or _matched_tokens(record)


def _simple_tokens(record: bytes) -> list[bytes] | None:
    """The cells, from one quote or comma to the next; None if there are others than said above."""
    found, at, size = [], 0, len(record)
    while True:
        if record[at : at + 1] == b'"':
            end = record.find(b'"', at + 1)
            while end > 0 and record[end - 1] == 0x5C:  # escaped, if by an odd number of backslashes
                first = end - 1
                while record[first - 1] == 0x5C:
                    first -= 1
                if (end - first) % 2 == 0:
                    break
                end = record.find(b'"', end + 1)
            if end < 0:
                return None
            found.append(record[at : end + 1])
            at = end + 1
            if at == size or (at == size - 1 and record[at] == 0x0D):
                return found
            if record[at] != 0x2C:
                return None
        else:
            end = record.find(b",", at)
            cell = record[at : end if end >= 0 else size]
            if b'"' in cell or b"\\" in cell:
                return None
            found.append(cell.replace(b"\r", b""))
            if end < 0:
                return found
            at = end
        at += 1


def _matched_tokens(record: bytes) -> list[bytes]:
    if b"\r" in record:
        record = _QUOTED_OR_CR.sub(rb"\1\2", record)
    found = _CELL.findall(record + b",")
    if sum(map(len, found)) + len(found) != len(record) + 1:
        raise ValueError("a record ends with an open quote")
    return found


def is_quoted(token: bytes) -> bool:
    return token[:1] == b'"' or (b'"' in token and b'"' in _ESCAPED.sub(b"", token))


def _unit(m: re.Match) -> bytes:
    x = m[1]
    if len(x) > 1:
        code = int(x[1:], 16)
        return bytes([code]) if x[:1] == b"x" else chr(code).encode("utf-8", "surrogatepass") if code <= 0x10FFFF else b""
    if x in (b"x", b"u", b"U"):
        raise ValueError(f"too few hex digits after the escape \\{x.decode()}")
    return DECODED.get(x.decode("latin-1"), x.decode("latin-1")).encode("latin-1")


def unescape(text: bytes) -> bytes:
    """Decodes backslash escapes, as `escapes.unescape`: by Python's codec if it knows all of them, else one by one."""
    if b"\\" not in text:
        return text
    single = text.replace(b"\\\\", b"")  # each backslash left begins an escape
    left = single.count(b"\\")
    for escape in _SHARED:
        if not left:
            break
        left -= single.count(escape)
    if not left:
        try:
            return text.decode("unicode_escape").encode("latin-1")
        except UnicodeDecodeError:  # too few digits
            pass
    return _UNIT.sub(_unit, text)


def cell_text(token: bytes) -> bytes:
    """A raw cell without its quotes, its escapes decoded."""
    if b'"' not in token and b"\\" not in token:
        return token
    if b'\\"' not in token:
        return unescape(token.replace(b'"', b""))
    inner = token[1:-1]
    single = inner.replace(b"\\\\", b"")
    if token[:1] == token[-1:] == b'"' and single.count(b'\\"') == inner.count(b'"') and single[-1:] != b"\\":
        return unescape(inner)  # all quotes but the outer ones are escaped
    return unescape(_ESCAPE_OR_QUOTE.sub(rb"\1", token))


def text_size(token: bytes) -> int | None:
    """The bytes of `cell_text`, where they can be told without decoding: of cells wholly in quotes, whose escapes are of one letter."""
    if len(token) < 2 or token[:1] != b'"' or token[-1:] != b'"':
        return None
    inner = token[1:-1]
    if b"\\" not in inner:
        return None if b'"' in inner else len(inner)
    single = inner.replace(b"\\\\", b"")  # each backslash left begins an escape
    quotes = single.count(b'\\"')
    if single[-1:] == b"\\" or quotes != inner.count(b'"'):
        return None
    escapes = single.count(b"\\")
    left = escapes - quotes
    for escape in _LETTERS:
        if not left:
            break
        left -= single.count(escape)
    return None if left else len(inner) - escapes - (len(inner) - len(single)) // 2


class Cutter:
    """Cuts records to cells. asked: RAW, TEXT or CLASS for each column. spaces: NUL characters of texts become spaces."""

    def __init__(self, asked: tuple[str, ...], spaces: bool):
        self.asked, self.spaces = asked, spaces

    def __call__(self, values: Iterable[bytes], files: list[str], blocks: list[int]) -> list[pa.Array]:
        """Arrays of `CELLS`. files, blocks: where the records stand."""
        cells, quoted, ends = [], [], [0]
        for found in self._found(values, files, blocks):
            for cell, asked in zip(found, self.asked, strict=True):
                done = is_quoted(cell)
                if asked == TEXT and (done or (cell and cell[0] not in _NUMBER_LIKE)):
                    cell, done = cell_text(cell), True
                    if self.spaces:
                        cell = cell.replace(b"\0", b" ")
                elif asked == CLASS and done:
                    cell = b""
                cells.append(cell)
                quoted.append(done)
            ends.append(len(cells))
        return _lists(cells, quoted, ends)

    def _found(self, values: Iterable[bytes], files: list[str], blocks: list[int]) -> Iterator[list[bytes]]:
        n = len(self.asked)
        for at, record in enumerate(values):
            found = tokens(record)
            if len(found) != n:
                raise ValueError(f"a record has {len(found)} cells, {n} are expected at {files[at]}, after byte {blocks[at]}")
            yield found


class BriefCutter(Cutter):
    """Cuts records to cells of which only short texts are kept. asked: RAW, SHORT or CLASS.

    strict: a text that can't be decoded is an error; else its length is unknown, and the error comes where it is asked
    for. digests: long texts are not left empty, but replaced by 128 bits of hash, as hex digits.
    """

    def __init__(self, asked: tuple[str, ...], spaces: bool, strict: bool = False, digests: bool = False):
        super().__init__(asked, spaces)
        self.strict, self.digests = strict, digests

    def __call__(self, values: Iterable[bytes], files: list[str], blocks: list[int]) -> list[pa.Array]:
        """Arrays of `BRIEF`."""
        cells, quoted, ends, sizes = [], [], [0], []
        for found in self._found(values, files, blocks):
            left = {}
            for i, (cell, asked) in enumerate(zip(found, self.asked, strict=True)):
                done = is_quoted(cell)
                if asked == SHORT and (done or (cell and cell[0] not in _NUMBER_LIKE)):
                    (cell, size), done = self._short(cell), True
                    if size is not None:
                        left[i] = size
                elif asked == CLASS and done:
                    cell, left[i] = b"", -1
                cells.append(cell)
                quoted.append(done)
            ends.append(len(cells))
            sizes.append([left.get(i) for i in range(len(found))] if left else None)
        return [*_lists(cells, quoted, ends), pa.array(sizes, pa.list_(pa.int32()))]

    def _short(self, cell: bytes) -> tuple[bytes, int | None]:
        """The text of a cell, if short, and else what stands for it and its length."""
        size = None if self.digests else text_size(cell)
        if size is not None and size > SHORT_BYTES:
            return b"", size
        try:
            cell = cell_text(cell)
        except ValueError:
            if self.strict:
                raise
            return b"", -1
        if self.spaces:
            cell = cell.replace(b"\0", b" ")
        if len(cell) > SHORT_BYTES:
            return blake2b(cell, digest_size=16).hexdigest().encode() if self.digests else b"", len(cell)
        return cell, None


def _lists(cells: list[bytes], quoted: list[bool], ends: list[int]) -> list[pa.Array]:
    """Arrays of `CELLS`. ends: where the cells of each record end."""
    ends = pa.array(ends, pa.int32())
    # bytes that aren't UTF-8 stay as they are
    return [pa.ListArray.from_arrays(ends, pa.array(cells, pa.binary()).view(pa.string())), pa.ListArray.from_arrays(ends, pa.array(quoted, pa.bool_()))]
