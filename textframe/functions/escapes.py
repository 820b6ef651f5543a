"""Backslash escapes: decoding and encoding of cells, without losing a byte.

Spark's regular expressions work on characters, and would replace bytes that are not
UTF-8. So cells that need work are taken to Latin-1, where each byte is one character,
and back. Cells without anything to do are passed on as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the format: the letter after a backslash, and what it stands for.
DECODED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "e": "\\"}
#: Fixed values of the format: characters with an escape of their own on output.
ENCODED = {"\b": "\\b", "\v": "\\v", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\", '"': '\\"', "'": "\\'"}
#: Fixed values of the format: characters that a quoted string escapes, and how.
QUOTED = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\f": "\\f", "\b": "\\b", "\v": "\\v"}

_UNIT = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[\s\S])|[^\\]+|\\\z"
_VALID = (
    r"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    r"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once. Keeps what is done to few cells out of the code generated for all."""
    return F.transform(F.array(value), use)[0]


def to_latin1(text: Column) -> Column:
    """One character for each byte."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def from_latin1(text: Column) -> Column:
    """The bytes again, as a string that may not be UTF-8."""
    return F.encode(text, "ISO-8859-1").cast("string")


def code_point_bytes(code: Column) -> Column:
    """The UTF-8 bytes of a code point, as Latin-1; nothing beyond U+10FFFF. Surrogates get three bytes."""
    low = lambda shift: F.char((F.shiftright(code, shift) % 64 + 128).cast("long"))
    lead = lambda shift, mark: F.char((F.shiftright(code, shift) + mark).cast("long"))
    return (
        F.when(code < 0x80, F.char(code))
        .when(code < 0x800, F.concat(lead(6, 0xC0), low(0)))
        .when(code < 0x10000, F.concat(lead(12, 0xE0), low(6), low(0)))
        .when(code <= 0x10FFFF, F.concat(lead(18, 0xF0), low(12), low(6), low(0)))
        .otherwise("")
    )


def _decoded_unit(unit: Column) -> Column:
    kind = F.substring(unit, 2, 1)
    code = F.conv(F.substring(unit, 3, 8), 16, 10).cast("long")
    short = F.raise_error(F.concat(F.lit("too few hex digits after the escape "), unit)).cast("string")
    out = F.when(~unit.startswith("\\"), unit).when(F.length(unit) == 1, "")
    for letter, char in DECODED.items():
        out = out.when(unit == f"\\{letter}", char)
    out = out.when(kind.isin("x", "u", "U") & (F.length(unit) == 2), short)
    out = out.when(F.length(unit) == 2, kind).when(kind == "x", F.char(code))
    return out.otherwise(code_point_bytes(code))


def _byte_lit(byte: int) -> Column:
    """A string of one byte, which in UTF-8 stands nowhere."""
    return F.lit(bytearray([byte])).cast("string")


def _replaced(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def unescape(text: Column) -> Column:
    """Decodes backslash escapes; a lone backslash at the end goes, too few hex digits are an error.

    Valid UTF-8 is decoded by replacing the whole text escape by escape; what that can't do is decoded unit by unit.
    """

    def units(cell: Column) -> Column:
        found = F.regexp_extract_all(to_latin1(cell), F.lit(_UNIT), F.lit(0))
        return from_latin1(F.array_join(F.transform(found, _decoded_unit), ""))

    def decoded(cell: Column) -> Column:
        quick = F.when(F.is_valid_utf8(cell), F.when(cell.contains("\\x"), _by_percent(cell)).otherwise(_by_letters(cell)))
        return let(quick, lambda x: F.when(x.isNull(), units(cell)).otherwise(x))

    return F.when(text.contains("\\"), let(text, decoded)).otherwise(text)


#: So many different escapes of code points are replaced in the whole text.
_POINTS = 16
_POINT = r"\\(?:u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})"
#: Escapes of a letter or quote that stand for one character other than a backslash.
_LETTERS = {f"\\{x}": char for x, char in DECODED.items() if char != "\\"} | {'\\"': '"', "\\'": "'"}


def _by_letters(cell: Column) -> Column:
    """cell decoded; null if there are escapes of another kind than letters, quotes and at most `_POINTS` code points."""
    slash = _byte_lit(0xFF)

    def point(x: Column, unit: Column) -> Column:
        """All escapes like the first one of a code point."""
        code = F.conv(F.substring(unit, 3, 8), 16, 10).cast("long")
        return F.when(unit != "", F.replace(x, unit, F.when(code == ord("\\"), slash).otherwise(from_latin1(code_point_bytes(code))))).otherwise(x)

    def points(x: Column) -> Column:
        more = lambda x: let(F.regexp_extract(x, _POINT, 0), lambda unit: point(x, unit))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_POINTS)), x, lambda x, _: F.when(x.contains("\\"), more(x)).otherwise(x))

    # pairs of backslashes first, so that each one left begins an escape
    marked = F.replace(F.replace(cell, F.lit("\\\\"), slash), F.lit("\\e"), slash)
    decoded = lambda x: F.when(~x.contains("\\"), F.replace(x, slash, F.lit("\\")))
    letters = let(marked, lambda x: F.when(x.contains("\\"), _replaced(x, _LETTERS)).otherwise(x))
    return let(let(letters, lambda x: F.when(x.contains("\\u") | x.contains("\\U"), points(x)).otherwise(x)), decoded)


def _by_percent(cell: Column) -> Column:
    """cell decoded as a URL is, with its escapes written that way; null if there are code points, or bytes that aren't UTF-8."""
    percent = {"%": "%25", "+": "%2B", "\\\\": "%5C", "\\e": "%5C"} | {x: f"%{ord(char):02X}" for x, char in _LETTERS.items()}
    # its digits may be of any script, those of an escape may not
    digits = F.when(~cell.rlike(r"\\x(?![0-9a-fA-F]{2})"), F.replace(_replaced(cell, percent), F.lit("\\x"), F.lit("%")))
    decoded = let(digits, lambda x: F.when(~x.contains("\\"), F.try_url_decode(x)))
    return let(decoded, lambda x: F.when(~x.contains("\ufffd"), x))


def null_to_space(text: Column) -> Column:
    return F.when(text.contains("\0"), F.replace(text, F.lit("\0"), F.lit(" "))).otherwise(text)


def _byte(char: Column) -> Column:
    return F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(F.ascii(char)), 2, "0")))


def _escaped(char: Column) -> Column:
    out = None
    for raw, shown in ENCODED.items():
        out = F.when(char == raw, shown) if out is None else out.when(char == raw, shown)
    return out.otherwise(_byte(char))


def _ascii(printable: bool, newlines: bool) -> Callable[[Column], Column]:
    """A function of bytes, in Python, whose codecs write bytes beyond ASCII as `\\xhh` without a look at each."""
    pairs = [(x.encode(), ENCODED[x].encode()) for x in ("\\", '"', "'", *("\n" * newlines))] + [(b"\x7f", b"\\x7f")]
    if printable:
        pairs = dict(pairs) | {bytes([i]): ENCODED.get(chr(i), f"\\x{i:02x}").encode() for i in range(0x20)}
        pairs = list(pairs.items())

    def encoded(data: bytes | None) -> bytes | None:
        if data is None:
            return None
        for raw, shown in pairs:
            if raw in data:
                data = data.replace(raw, shown)
        return data if data.isascii() else data.decode("latin-1").encode("ascii", "backslashreplace")

    @F.arrow_udf("binary")
    def escaped(texts: pa.Array) -> pa.Array:
        return pa.array([encoded(x) for x in texts.to_pylist()], pa.binary())

    return escaped


def escape(text: Column, out_encoding: str = "arbitrary", newlines: bool = False) -> Column:
    """Escapes a cell for writing; newlines: line ends are escaped too.

    'arbitrary' escapes backslashes and both quotes; 'utf-8' also bytes that aren't valid
    UTF-8; 'ascii' also bytes from 0x7f on; 'printable_ascii' those and all below 0x20.
    """
    if out_encoding not in ("arbitrary", "utf-8", "ascii", "printable_ascii"):
        raise ValueError(f"unknown out_encoding {out_encoding!r}")
    odd = "\"'\\\\" + ("\\n" if newlines else "")
    pick = lambda unit: F.when(unit.rlike(rf"\A[{odd}]\z"), _escaped(unit)).otherwise(unit)
    units = lambda latin: F.regexp_extract_all(latin, F.lit(rf"[{odd}]|[^{odd}]+"), F.lit(0))

    if out_encoding in ("ascii", "printable_ascii"):
        return _ascii(out_encoding == "printable_ascii", newlines)(text.cast("binary")).cast("string")

    def slow(cell: Column) -> Column:
        own = _replaced(cell, {x: ENCODED[x] for x in ("\\", '"', "'", *("\n" * newlines))})
        if out_encoding != "utf-8":
            return own
        latin = to_latin1(cell)
        whole = F.regexp_extract_all(latin, F.lit(rf"(?:{_VALID})+|[\s\S]"), F.lit(0))
        stray = lambda u: (F.length(u) == 1) & (F.ascii(u) >= 0x80)
        strict = F.transform(whole, lambda u: F.when(stray(u), _byte(u)).otherwise(F.array_join(F.transform(units(u), pick), "")))
        return F.when(F.is_valid_utf8(cell), own).otherwise(from_latin1(F.array_join(strict, "")))

    quick = text.contains("\\") | text.contains('"') | text.contains("'")
    if newlines:
        quick = quick | text.contains("\n")
    if out_encoding == "utf-8":
        quick = quick | ~F.is_valid_utf8(text)
    return F.when(quick, let(text, slow)).otherwise(text)


def as_quoted_string(text: Column, do_not_escape_newlines: bool = False) -> Column:
    """The text in double quotes, with its quotes, backslashes and control characters escaped."""
    out = text
    for raw in ("\\", *(x for x in QUOTED if x != "\\" and not (do_not_escape_newlines and x == "\n"))):
        out = F.replace(out, F.lit(raw), F.lit(QUOTED[raw]))
    return F.concat(F.lit('"'), out, F.lit('"'))


def quoted_if_needed(text: Column) -> Column:
    """As `as_quoted_string`, for texts that are empty or hold anything but plain characters; others as they are."""
    return F.when((text == "") | text.rlike(r"""[\s"'\\,]"""), as_quoted_string(text)).otherwise(text)


def escape_text(text: str | bytes, options) -> bytes:
    """One header name, on the driver, as `escape` does for cells."""
    data = text if isinstance(text, bytes) else text.encode("utf-8", "surrogateescape")
    odd = set(b"\\\"'") | (set() if options.allow_quoted_newlines else set(b"\n"))
    if options.out_encoding in ("ascii", "printable_ascii"):
        odd |= set(range(0x7F, 0x100))
    if options.out_encoding == "printable_ascii":
        odd |= set(range(0x20))
    out = bytearray()
    for byte in data:
        if byte in odd:
            out += ENCODED.get(chr(byte), f"\\x{byte:02x}").encode()
        else:
            out.append(byte)
    return bytes(out)
