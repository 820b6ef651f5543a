"""Writing, and that what is written loads again as it was."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import textframe as tf
from textframe.functions import escapes
from tests import scalar


def content(path):
    return b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))


def random_bytes(rng, kind):
    n = int(rng.integers(0, 60))
    if kind == "arbitrary":
        return bytes(rng.integers(0, 256, n).astype(np.uint8))
    if kind == "ascii":
        return bytes(rng.integers(0, 128, n).astype(np.uint8))
    if kind == "printable":
        return bytes(rng.integers(32, 127, n).astype(np.uint8))
    return "".join(chr(x) for x in rng.choice([0x41, 0x7F, 0xE9, 0x4E00, 0x1F600, 0x10FFFF, 0x0A, 0x22], n)).encode()


@pytest.mark.parametrize("encoding", ["arbitrary", "utf-8", "ascii", "printable_ascii"])
@pytest.mark.parametrize(("newlines", "dos"), [(True, False), (False, True)])
def test_bytes_come_back(spark, tmp_path, encoding, newlines, dos):
    rng = np.random.default_rng(len(encoding) + 2 * newlines + dos)
    cells = [random_bytes(rng, kind) for kind in ("arbitrary", "ascii", "printable", "unicode") for _ in range(30)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, x binary").repartition(3).sortWithinPartitions("i")
    path = tmp_path / "out"
    tf.save_frame(str(path), frame, allow_quoted_newlines=newlines, out_encoding=encoding, dos=dos)
    written = content(path)
    if encoding == "printable_ascii":
        assert not [b for b in written if (b < 32 and b not in (10, 13)) or b > 126]
    if encoding == "ascii":
        assert max(written) < 0x7F
    if encoding == "utf-8":
        written.decode()
    if not newlines:
        assert written.count(b"\n") == len(cells) + 1
    loaded = tf.read_csv(spark, str(path), allow_quoted_newlines=newlines, out_encoding="unknown", convert_null_to_space=False, text_names="x").to_pandas()
    assert {i: x for i, x in zip(loaded["i"], loaded["x"], strict=True)} == dict(enumerate(cells))
    for record, line in zip(scalar.parse(written)[1:], loaded["x"], strict=True):
        assert scalar.decode(record[1][0]) == line


def test_mixed_frames_come_back(spark, tmp_path):
    rng = np.random.default_rng(8)
    for rows in (0, 1, 40):
        frame = pd.DataFrame({"cat": rng.choice(["one, two\nthree", 'a "quoted" one', "\\back"], rows), "f": rng.standard_normal(rows).astype(np.float32)})
        for kind in ("uint8", "int8", "int16", "uint32", "int64"):
            info = np.iinfo(kind)
            frame[kind] = rng.integers(max(info.min, -(2**62)), min(info.max, 2**62), rows).astype(kind)
        path = str(tmp_path / f"mixed{rows}")
        tf.save_frame(path, frame, spark=spark)
        got = tf.read_csv(spark, path, allow_quoted_newlines=True).to_pandas()
        assert list(got.columns) == list(frame.columns) and len(got) == rows
        for name in frame:
            if name == "cat":
                assert list(got[name]) == list(frame[name])
            else:
                np.testing.assert_array_equal(got[name].to_numpy(float), frame[name].to_numpy(float))


def test_form_of_a_file(spark, tmp_path):
    rows = [(1, "x,'y'", 1.5, True, None), (None, None, float("nan"), False, "b\nc")]
    frame = spark.createDataFrame(rows, 'i int, `na"me` string, f double, b boolean, t string')
    tf.save_frame(str(tmp_path / "a"), frame, allow_quoted_newlines=False, dos=True)
    assert content(tmp_path / "a") == b'"i","na\\"me","f","b","t"\r\n1,"x,\\\'y\\\'",1.5,True,""\r\nnan,"",nan,False,"b\\nc"\r\n'
    tf.save_frame(str(tmp_path / "b"), {"k": [1, 2], "v": [b"\xff", b"ok"]}, out_encoding="utf-8", spark=spark)
    assert content(tmp_path / "b") == b'"k","v"\n1,"\\xff"\n2,"ok"\n'
    with pytest.raises(ValueError):
        tf.save_frame(str(tmp_path / "c"), spark.createDataFrame([([1],)], "a array<int>"))
    with pytest.raises(TypeError):
        tf.save_frame(str(tmp_path / "d"), [1, 2], spark=spark)


def test_decoding_against_bytes(spark):
    rng = np.random.default_rng(2)
    units = [b"\\n", b"\\t", b"\\r", b"\\b", b"\\f", b"\\v", b"\\0", b"\\e", b"\\x9f", b"\\u00E9", b"\\uD800", b"\\U0001f600", b"\\UFFFFFFFF", b"\\q", b"\\\\", b"a", b"\xc3\xa9", b"\xfe", b"\n"]
    cells = [b"".join(units[i] for i in rng.integers(0, len(units), rng.integers(0, 9))) for _ in range(300)] + [b"end\\", b"\\"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, x binary")
    got = {r.i: bytes(r.y) for r in frame.select("i", escapes.unescape(F.col("x").cast("string")).cast("binary").alias("y")).collect()}
    assert got == {i: scalar.decode(x) for i, x in enumerate(cells)}


def test_every_byte_is_escaped_as_said(spark):
    frame = spark.createDataFrame([(bytes([b]),) for b in range(256)], "x binary").select("x", *(escapes.escape(F.col("x").cast("string"), e).cast("binary").alias(e.replace("-", "_")) for e in ("arbitrary", "utf-8", "ascii", "printable_ascii")))
    named = {8: b"\\b", 11: b"\\v", 10: b"\\n", 13: b"\\r", 9: b"\\t"}
    for r in frame.collect():
        b = r.x[0]
        plain = b"\\" + r.x if b in b"\\\"'" else bytes(r.x)
        coded = b"\\x%02x" % b
        assert bytes(r.arbitrary) == plain
        assert bytes(r.utf_8) == (coded if b >= 0x80 else plain)
        assert bytes(r.ascii) == (coded if b >= 0x7F else plain)
        assert bytes(r.printable_ascii) == (named.get(b, coded) if b < 32 else coded if b >= 0x7F else plain)


def test_quoted_strings(spark):
    rows = spark.createDataFrame([("",), ("plain",), ('a "b" \\ \n\t\r\f\b\v',), ("with space",)], "x string")
    got = rows.select(escapes.as_quoted_string(F.col("x")).alias("a"), escapes.as_quoted_string(F.col("x"), True).alias("b"), escapes.quoted_if_needed(F.col("x")).alias("c")).collect()
    assert [r.a for r in got] == ['""', '"plain"', '"a \\"b\\" \\\\ \\n\\t\\r\\f\\b\\v"', '"with space"']
    assert got[2].b == '"a \\"b\\" \\\\ \n\\t\\r\\f\\b\\v"'
    assert [r.c for r in got] == ['""', "plain", '"a \\"b\\" \\\\ \\n\\t\\r\\f\\b\\v"', '"with space"']
