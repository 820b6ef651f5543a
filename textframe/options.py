"""Options of the reader and of the writer."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

SEMANTICS = ("num", "cat", "text")
OUT_ENCODINGS = ("arbitrary", "utf-8", "ascii", "printable_ascii")


@dataclass(frozen=True)
class ReadOptions:
    """How a file is read.

    num_threads: least number of splits of a scan; 0 leaves it to Spark.
    allow_quoted_newlines: records may go on over lines inside quotes or after a backslash.
    block_size: accepted, without effect; Spark reads by its own blocks.
    number_only: cells are numbers without quotes or escapes; a quicker lexer is used.
    no_header: the first record is data and columns are col0, col1, ...
    max_level_name_length, max_levels: a categorical column above either becomes text.
    cat_names, text_names, num_names: meanings that hold for columns, in this order of precedence.
    in_encoding: accepted for documentation; bytes are never re-coded on reading.
    out_encoding: 'utf-8' gives strings, 'unknown' gives the bytes as they are.
    convert_null_to_space: NUL characters in cells become spaces.
    empty_cell: 'zero' (numeric columns get 0, others '') or 'null'.
    """

    num_threads: int = 0
    allow_quoted_newlines: bool = False
    block_size: int = 32768
    number_only: bool = False
    no_header: bool = False
    max_level_name_length: int | None = None
    max_levels: int | None = None
    cat_names: tuple[str, ...] = ()
    text_names: tuple[str, ...] = ()
    num_names: tuple[str, ...] = ()
    in_encoding: str | None = None
    out_encoding: str = "utf-8"
    convert_null_to_space: bool = True
    empty_cell: str = "zero"

    def __post_init__(self) -> None:
        for name in ("cat_names", "text_names", "num_names"):
            value = getattr(self, name)
            object.__setattr__(self, name, (value,) if isinstance(value, str) else tuple(value or ()))
        if self.out_encoding is None:
            object.__setattr__(self, "out_encoding", "utf-8")
        if self.in_encoding not in (None, "utf-8", "unknown"):
            raise ValueError(f"in_encoding must be 'utf-8' or 'unknown', not {self.in_encoding!r}")
        if self.out_encoding not in ("utf-8", "unknown"):
            raise ValueError(f"out_encoding must be 'utf-8' or 'unknown', not {self.out_encoding!r}")
        if self.empty_cell not in ("zero", "null"):
            raise ValueError(f"empty_cell must be 'zero' or 'null', not {self.empty_cell!r}")
        if self.num_threads < 0:
            raise ValueError("num_threads must not be negative")
        for name in ("max_levels", "max_level_name_length"):
            if (getattr(self, name) or 0) < 0:
                raise ValueError(f"{name} must not be negative")

    @property
    def limits(self) -> bool:
        return self.max_levels is not None or self.max_level_name_length is not None

    def forced(self, name: str) -> str | None:
        """The meaning that the caller has set for a column."""
        for meaning, names in (("cat", self.cat_names), ("num", self.num_names), ("text", self.text_names)):
            if name in names:
                return meaning
        return None

    def settled(self, name: str) -> bool:
        """Whether a column is one of texts whatever its cells are."""
        return self.forced(name) == "text" or self.forced(name) == "cat" and (self.number_only or not self.limits)


@dataclass(frozen=True)
class WriteOptions:
    """How a frame is written. dos ends lines with CR LF."""

    allow_quoted_newlines: bool = True
    out_encoding: str = "arbitrary"
    dos: bool = False

    def __post_init__(self) -> None:
        if self.out_encoding not in OUT_ENCODINGS:
            raise ValueError(f"out_encoding must be one of {', '.join(OUT_ENCODINGS)}, not {self.out_encoding!r}")


def input_path(uri: str) -> str:
    """A path for Spark's readers: plain and Windows paths as they are, file: URIs as paths, other schemes untouched."""
    if not isinstance(uri, str) or not uri:
        raise ValueError("a path or URI is expected")
    if re.match(r"[A-Za-z]:[\\/]", uri) or "://" not in uri and not uri.startswith("file:"):
        return uri
    parts = urlsplit(uri)
    if parts.scheme == "file":
        if parts.netloc not in ("", "localhost"):
            raise ValueError(f"a file URI can't name another host: {uri}")
        return unquote(parts.path)
    if parts.scheme in ("http", "https", "ftp"):
        raise ValueError(f"files can't be read by {parts.scheme}: {uri}")
    return uri
