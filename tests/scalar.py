"""The file grammar as a loop over bytes: slow, plain, and independent of the library's expressions."""

from __future__ import annotations

import re

SIMPLE = {"n": 10, "t": 9, "r": 13, "b": 8, "f": 12, "v": 11, "0": 0, "e": 92}


def decode(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        if raw[i] != 92:
            out.append(raw[i])
            i += 1
            continue
        if i + 1 == len(raw):
            break
        c = chr(raw[i + 1])
        digits = {"x": 2, "u": 4, "U": 8}.get(c)
        if digits:
            text = raw[i + 2 : i + 2 + digits].decode("latin-1")
            if not re.fullmatch(f"[0-9a-fA-F]{{{digits}}}", text):
                raise ValueError("short escape")
            code = int(text, 16)
            if c == "x":
                out.append(code)
            elif code <= 0x10FFFF:
                out += chr(code).encode("utf-8", "surrogatepass")
            i += 2 + digits
        else:
            out.append(SIMPLE.get(c, raw[i + 1]))
            i += 2
    return bytes(out)


def parse(data: bytes) -> list[list[tuple[bytes, bool]]]:
    """Records of (raw cell, quoted): quotes dropped, escapes still in."""
    records, record, cell, quoted, open_, size = [], [], bytearray(), False, False, 0
    i = 0

    def close():
        nonlocal cell, quoted
        record.append((bytes(cell), quoted))
        cell, quoted = bytearray(), False

    while i < len(data):
        c = data[i]
        size += 1
        if c == 92:
            cell += data[i : i + 2]
            i += 1
        elif c == 34:
            open_, quoted = not open_, True
        elif open_:
            cell.append(c)
        elif c == 44:
            close()
        elif c == 10:
            if size > 1 and not (size == 2 and data[i - 1] == 13):
                close()
                records.append(record)
            record, cell, quoted, size = [], bytearray(), False, 0
        elif c != 13:
            cell.append(c)
        i += 1
    if open_:
        raise ValueError("open quote")
    if size:
        close()
        records.append(record)
    return records
