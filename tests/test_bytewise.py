"""The lexer on bytes against that of expressions, and reading and comparing that pass over a file no oftener than needed."""

import random

import pytest
from pyspark.sql import functions as F

import textframe as tf
from textframe import frame as frame_
from textframe.functions import bytewise, lexing
from textframe.operators import diagnostics
from textframe.sources import records as records_


def _records(n: int) -> list[bytes]:
    """Records without an open quote or too short an escape."""
    pick = random.Random(5)
    found = []
    while len(found) < n:
        record = b"".join(pick.choice([b'"', b'"a,', b'b"', b",", b"\\\\", b'\\"', b"\\", b"\r", b"\n", b"\\xc3\\xa9", b"\\u00e9", b"\\e", b"\\0", b"\xc3\xa9", b"\xff", b"1", b"x"]) for _ in range(pick.randint(0, 12)))
        try:
            [bytewise.cell_text(x) for x in bytewise.tokens(record)]
        except ValueError:
            continue
        found.append(record)
    return found


def test_as_the_expressions(spark):
    records = _records(2000)
    rows = spark.createDataFrame(list(enumerate(map(bytearray, records))), "i int, v binary").select("i", F.col("v").cast("string").alias("v"))
    cells = rows.select("i", F.posexplode(lexing.tokens(F.col("v"))).alias("at", "t"))
    got = cells.select("i", "at", F.col("t").cast("binary"), lexing.is_quoted(F.col("t")), lexing.cell_text(F.col("t")).cast("binary")).orderBy("i", "at").collect()
    want = [(i, at, t, bytewise.is_quoted(t), bytewise.cell_text(t)) for i, record in enumerate(records) for at, t in enumerate(bytewise.tokens(record))]
    assert [(i, at, bytes(t), q, bytes(x)) for i, at, t, q, x in got] == want


@pytest.mark.parametrize(("record", "message"), [(b'a,"b', "open quote"), (b'"a"b"', "open quote")])
def test_open_quotes(record, message):
    with pytest.raises(ValueError, match=message):
        bytewise.tokens(record)


def test_too_few_digits():
    with pytest.raises(ValueError, match="too few hex digits"):
        bytewise.cell_text(b'"\\x4"')


def test_quoted_newlines_need_no_patterns(spark, tmp_path, monkeypatch):
    """Records over several splits of several files, each with the header: cut to cells where they are joined."""

    def fail(*_):
        raise AssertionError("records are lexed by expressions")

    for name in ("tokens", "is_quoted"):
        monkeypatch.setattr(lexing, name, fail)
    texts = [f"{i}\n" + "é'\\\" ,\n" * (i % 40) for i in range(120)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "n int, t string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        for encoding in ("arbitrary", "ascii"):
            path = f"{tmp_path}/{encoding}"
            tf.write_parts(rows.repartition(3), path, out_encoding=encoding, dos=encoding == "ascii")
            got = tf.read_csv(spark, path, allow_quoted_newlines=True, max_level_name_length=100)
            assert [(c.semantics, c.dtype) for c in got.columns] == [("num", "uint8"), ("text", "string")]
            assert {r.n: r.t for r in got.expanded().collect()} == dict(enumerate(texts))
            assert sorted(r.n for r in got.column("n").collect()) == list(range(120))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_inference_reads_quoted_cells_as_such_only(spark, put, monkeypatch):
    """Without limits, inference asks nothing of a quoted cell but that it is one; forced numbers are read from their text."""
    asked = []
    rows = frame_.QuotedRecords.cells
    monkeypatch.setattr(frame_.QuotedRecords, "cells", lambda self, x: asked.append(x) or rows(self, x))
    path = put(b'a,b,c\n1,"x\ny","7"\n2,z,\n')
    got = tf.read_csv(spark, path, allow_quoted_newlines=True, num_names="c")
    assert asked == [("class", "class", "raw")]
    assert [tuple(r) for r in got.expanded(ordered=True).collect()] == [(1, "x\ny", 7), (2, "z", 0)]
    assert asked[1:] == [("raw", "text", "raw")]
    assert sorted(r.level for r in got.levels("b").collect()) == ["x\ny", "z"]
    assert asked[2:] == [("class", "text", "class")]


@pytest.fixture
def passes(spark, monkeypatch):
    """A list that gets a member for each pass over all lines that goes through Python, in splits of 1 kB."""
    found = []
    passed = frame_.QuotedRecords._passed
    monkeypatch.setattr(frame_.QuotedRecords, "_passed", lambda self, *x: found.append(x) or passed(self, *x))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    yield found
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _mixed() -> list[tuple[int, str, str]]:
    """Texts of no, few and many bytes, with line ends, NUL and escapes."""
    texts = [f"{i}\n" + "é'\\\" ,\n\0" * (i % 40) for i in range(119)] + [""]
    return [(i, x, "de" if i % 3 else "") for i, x in enumerate(texts)]


def _sizes(rows: list[tuple]) -> tuple:
    return tuple(sum(x if isinstance(x, int) else len(x.encode()) for x in column) for column in zip(*rows, strict=True))


@pytest.mark.parametrize("parts", [1, 3])
def test_sums_in_one_pass(spark, tmp_path, passes, parts):
    """Inference, sums, levels and short columns read the lines once, records that cross splits too; long texts take another pass."""
    rows = _mixed()
    tf.write_parts(spark.createDataFrame(rows, "n int, t string, l string").repartition(parts), f"{tmp_path}/x")
    got = tf.read_csv(spark, f"{tmp_path}/x", allow_quoted_newlines=True)
    assert got._cells._records.crosses
    assert tuple(got.sums().first()) == _sizes(rows)
    assert sorted(got.level_list("l")) == ["", "de"]
    assert sorted(r.n for r in got.column("n").collect()) == list(range(120))
    assert len(passes) == 1
    assert sorted(map(tuple, got.expanded().collect())) == [(i, x.replace("\0", " "), y) for i, x, y in rows]
    assert len(passes) == 2


@pytest.mark.parametrize("limit", [{"max_level_name_length": 40}, {"max_levels": 60}, {"max_levels": 119}, {"max_levels": 120, "max_level_name_length": 1000}])
def test_limits_in_one_pass(spark, tmp_path, passes, limit):
    """Lengths and numbers of levels, and the levels of short columns, come from the pass that infers."""
    rows = _mixed()
    longest, levels = max(len(x.encode()) for _, x, _ in rows), len({x for _, x, _ in rows})
    tf.write_parts(spark.createDataFrame(rows, "n int, t string, l string").repartition(2), f"{tmp_path}/x")
    got = tf.read_csv(spark, f"{tmp_path}/x", allow_quoted_newlines=True, **limit)
    beyond = longest > limit.get("max_level_name_length", longest) or levels > limit.get("max_levels", levels)
    assert [(c.semantics, c.dtype) for c in got.columns] == [("num", "uint8"), ("text" if beyond else "cat", "string"), ("cat", "string")]
    assert got.code_dtype("l") == "uint8"
    assert len(passes) == 1
    assert tuple(got.sums().first()) == _sizes(rows)
    assert len(passes) == 1


def test_long_levels_are_told_apart(spark, put):
    """Levels of one length count as different, equal ones once; and limits tell of texts that can't be decoded."""
    rows = [x * 200 for x in ("a", "b", "c", "a")]
    path = put(("t\n" + "".join(f'"{x}\n"\n' for x in rows)).encode())
    for most, meaning in ((2, "text"), (3, "cat")):
        got = tf.read_csv(spark, path, allow_quoted_newlines=True, max_levels=most)
        assert got.columns[0].semantics == meaning
    assert got.level_list("t") == [f"{x * 200}\n" for x in "abc"]
    with pytest.raises(Exception, match="too few hex digits"):
        tf.read_csv(spark, put(b'a\n"\\x4"\n'), allow_quoted_newlines=True, max_level_name_length=40)


def test_sizes_and_quotes_without_decoding():
    """Where a size is told, it is the decoded text's."""
    told, pick = 0, random.Random(7)
    units = [b"\\\\", b'\\"', b"\\'", b"\\n", b"x", b"\n", b"\xff", b"\xc3\xa9", b"\\x41", b"\\e", b'""']
    cells = [b'"' + b"".join(pick.choices(units, [9, 9, 9, 9, 9, 9, 9, 9, 1, 1, 1], k=pick.randint(0, 9))) + b'"' for _ in range(2000)]
    for cell in [*cells, *(x for record in _records(500) for x in bytewise.tokens(record))]:
        size = bytewise.text_size(cell)
        told += size is not None
        assert size in (None, len(bytewise.cell_text(cell)))
    assert told > 1000
    assert bytewise.text_size(b'"a\\n\\\\\\"\\\'"') == 5
    assert bytewise.text_size(b'"\\x41"') is None


def test_quotes_of_lines(spark):
    """Quotes and escaped ends of lines, as in the expressions."""
    lines = [x.replace(b"\n", b"") for x in _records(500)]
    rows = spark.createDataFrame(list(enumerate(map(bytearray, lines))), "i int, v binary").select("i", F.col("v").cast("string").alias("v"))
    got = rows.select("i", records_.quote_count(F.col("v")), records_.end_escaped(F.col("v"))).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(i, records_._quotes(x), records_._tail(x)) for i, x in enumerate(lines)]


def test_sums_of_set_and_odd_columns(spark, put, passes):
    """Texts that inference doesn't read, or can't decode, are read where they are asked for."""
    long = "ü" * 100
    path = put(f'a,b,c,d\n1,"{long}\ny","7",3\n2,"{long}",\\x38,\n'.encode())
    got = tf.read_csv(spark, path, allow_quoted_newlines=True, text_names="b", num_names="c", empty_cell="null")
    assert tuple(got.sums().first()) == (3, 402, 15, 3)
    bad = tf.read_csv(spark, put(b'a,b\n1,"x\ny"\n2,"\\x4"\n'), allow_quoted_newlines=True)
    assert [(c.semantics, c.dtype) for c in bad.columns] == [("num", "uint8"), ("cat", "string")]
    assert bad.column("a").count() == 2
    with pytest.raises(Exception, match="too few hex digits"):
        bad.sums().first()


def test_bytes_that_are_not_text(spark, put):
    """Short and long cells that aren't UTF-8 keep their bytes."""
    rows = [b"\xff\n\xc3", b"\xfe" * 300]
    path = put(b"a\n" + b"".join(b'"' + x + b'"\n' for x in rows))
    got = tf.read_csv(spark, path, allow_quoted_newlines=True, out_encoding="unknown")
    assert got.sums().first()[0] == 303
    assert got.level_list("a") == rows


def test_compared_frames_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    schema = "_file string, _block bigint, _row bigint, n bigint, s string"
    a, b = (spark.createDataFrame([("f", 0, i, i, f"{i % k}") for i in range(50)], schema).mapInArrow(each, schema) for k in (7, 5))
    row = diagnostics.compare_frames(a, b).first()
    assert row.n == 0.0 and row.s == sum(i % 7 != i % 5 for i in range(50)) / 50
    assert seen.value == 100
