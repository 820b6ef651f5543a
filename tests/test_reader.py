"""Loading: grammar, headers, meanings, storage, and that splits do not matter."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import textframe as tf
from textframe.functions import lexing
from textframe.plans.infer import LADDER, storage
from textframe.sources.header import split_header
from tests import scalar


def load(spark, put, content, **options):
    return tf.read_csv(spark, put(content), **options)


def columns(frame):
    return {n: list(frame.to_pandas()[n]) for n in frame.names}


def kinds(frame):
    return [(c.semantics, c.dtype) for c in frame.columns]


@pytest.mark.parametrize("body", [b"", b"\n", b" \n   \n \n", b"\r\n", b"\v\t \n", b"\n\n\n", b" \r\n \r\n"])
def test_blank_files_have_no_columns(spark, put, body):
    for quoted in (False, True):
        frame = load(spark, put, body, allow_quoted_newlines=quoted)
        assert frame.columns == [] and frame.count() == 0 and len(frame.to_pandas().columns) == 0


@pytest.mark.parametrize("rows", [0, 1, 40])
@pytest.mark.parametrize("wide", [4])
@pytest.mark.parametrize("number_only", [False, True])
@pytest.mark.parametrize("no_header", [False, True])
def test_numbers(spark, put, rows, wide, number_only, no_header):
    if rows < 2 and no_header:
        pytest.skip("one row without a header is a header unless told")
    rng = np.random.default_rng(rows + wide)
    data = np.stack([np.arange(rows) * (i + 1) if i % 2 == 0 else rng.standard_normal(rows) for i in range(wide)], 1) if rows else np.zeros((0, wide))
    names = [f"col{i}" if no_header else "ABCD"[i] for i in range(wide)]
    lines = ([] if no_header else [",".join(names)]) + [",".join(repr(float(x)) if i % 2 else str(int(x)) for i, x in enumerate(row)) for row in data]
    frame = load(spark, put, ("\n".join(lines) + "\n").encode(), number_only=number_only, no_header=no_header)
    assert frame.names == names
    got = frame.to_pandas()
    assert len(got) == rows
    for i, name in enumerate(names):
        np.testing.assert_allclose(got[name].to_numpy(float), data[:, i], rtol=1e-6)


def test_odd_quotes_and_escapes(spark, put):
    frame = load(spark, put, b'A,B,C\n"\\"",,7\n"\\\\",X,8\n"\n","\\\\\\"",9\n', allow_quoted_newlines=True)
    assert columns(frame) == {"A": ['"', "\\", "\n"], "B": ["", "X", '\\"'], "C": [7, 8, 9]}
    frame = load(spark, put, b'x,y\nc\\,d,1\n"a""b"z,2\n"",3\n')
    assert columns(frame) == {"x": ["c,d", "abz", ""], "y": [1, 2, 3]}


def test_escaped_last_line_end(spark, put):
    assert columns(load(spark, put, b"a,b\n1,x\\\n", allow_quoted_newlines=True))["b"] == ["x\n"]
    assert columns(load(spark, put, b"a,b\n1,x\\", allow_quoted_newlines=True))["b"] == ["x"]
    assert columns(load(spark, put, b"a,b\n1,x\\\ny\n2,z", allow_quoted_newlines=True))["b"] == ["x\ny", "z"]


def test_every_escape(spark, put):
    frame = load(spark, put, b"a,b\n\\n\\\\n\\x41\\xff\\u00e9\\U0001F600\\q\\,\\0end,1\n", convert_null_to_space=False, out_encoding="unknown")
    assert columns(frame)["a"] == [bytes.fromhex("0a5c6e41ffc3a9f09f9880712c00") + b"end"]
    with pytest.raises(Exception, match="hex digits"):
        columns(load(spark, put, b"a,b\nz\\x4,1\n"))


def test_empty_cells(spark, put):
    body = b"a,b,c\n1,,\n,,3\n,5,\n"
    assert columns(load(spark, put, body, number_only=True)) == {"a": [1, 0, 0], "b": [0, 0, 5], "c": [0, 3, 0]}
    assert columns(load(spark, put, body)) == {"a": [1, 0, 0], "b": [0, 0, 5], "c": [0, 3, 0]}
    assert load(spark, put, body, empty_cell="null").expanded().filter("a is null").count() == 2


def test_names_look_like_numbers(spark, put):
    assert kinds(load(spark, put, b"x,y\nA.1,3ABC\nA.2,4ABC\n")) == [("cat", "string")] * 2
    assert load(spark, put, b"1,2\n3,4\n").names == ["1", "2"]
    assert load(spark, put, b"1,1\n3,4\n").names == ["col0", "col1"]


def test_headers(spark, put):
    assert split_header(b"'a,b',\"c\"\"d\",e\\,f\r") == [b"a,b", b"cd", b"e\\,f"]
    assert load(spark, put, b"\n  \n a,'b,c'\n1,2\n").names == ["a", "b,c"]
    assert load(spark, put, b"a,b\\n\\x41,c").names == ["a", "b\nA", "c"]
    assert load(spark, put, b'"a\nb",c\n1,2\n', allow_quoted_newlines=True).names == ["a\nb", "c"]


def test_ragged_records_fail(spark, put):
    for body in (b"a,b\n1\n", b"a,b\n1,2,3\n"):
        with pytest.raises(Exception, match="cells"):
            load(spark, put, body)
    with pytest.raises(Exception, match="open quote"):
        load(spark, put, b'a,b\n"x,1\n', allow_quoted_newlines=True)
    with pytest.raises(Exception, match="open quote"):
        load(spark, put, b'a,b\n"x,1\n')


def test_carriage_returns(spark, put):
    assert columns(load(spark, put, b'a,b\r\n1\r,"x\ry"\r\n\r\n2,z\r\n')) == {"a": [1, 2], "b": ["x\ry", "z"]}


@pytest.mark.parametrize(
    ("values", "dtype"),
    [(["0", "255"], "uint8"), (["-1", "127"], "int8"), (["-1", "128"], "int16"), (["40000"], "int32"), (["-3000000000"], "int64"), (["99999999999999999999"], "float"), (["1.0", "2e1"], "uint8"), (["1.5"], "float"), (["3", "?"], "float"), ([], "uint8"), (["200", "5", "-1"], "int16")],
)
def test_narrowest_storage(spark, put, values, dtype):
    frame = load(spark, put, "\n".join(["a", *values, ""]).encode())
    assert kinds(frame) == [("num", dtype)]
    got = frame.to_pandas()["a"]
    assert str(got.dtype) == {"float": "float32"}.get(dtype, dtype)
    np.testing.assert_allclose(got.to_numpy(float), [float("nan") if x == "?" else float(np.float32(x)) if dtype == "float" else float(x) for x in values], rtol=1e-6)


def test_storage_against_the_ladder():
    for name, low, high, _ in LADDER:
        assert storage(low, high, False) == name
    assert storage(None, None, False) == "uint8" and storage(0, 1, True) == "float"


def test_mixed_columns_are_text_from_the_start(spark, put):
    frame = load(spark, put, b"a,b\n30,x\n1.5,y\n?,z\n,w\nword,v\n007,u\n")
    assert columns(frame)["a"] == ["30", "1.500000", "nan", "", "word", "7"]


def test_quoted_numbers_make_categories(spark, put):
    frame = load(spark, put, b'a\n"5"\n6\n')
    assert kinds(frame) == [("cat", "string")] and columns(frame)["a"] == ["5", "6"]


def test_forced_meanings(spark, put):
    body = b"a,b,c\n1,abc,x\n2.5,12abc,y\n?,nope,x\n"
    frame = load(spark, put, body, cat_names="a", num_names=["b"], text_names=("c", "a"))
    assert [c.semantics for c in frame.columns] == ["cat", "num", "text"]
    got = columns(frame)
    assert got["a"] == ["1", "2.500000", "nan"] and got["c"] == ["x", "y", "x"]
    assert got["b"][:2] == [0, 12] and np.isnan(got["b"][2])


def test_limits_make_text(spark, put):
    body = b"a,b\nx,long level\ny,z\nz,z\n"
    assert [c.semantics for c in load(spark, put, body, max_levels=2).columns] == ["text", "cat"]
    assert [c.semantics for c in load(spark, put, body, max_level_name_length=5).columns] == ["cat", "text"]
    assert [c.semantics for c in load(spark, put, body, max_levels=3, max_level_name_length=10).columns] == ["cat", "cat"]


def test_levels_by_first_appearance(spark, put):
    frame, names = load(spark, put, b"a,b\nno,1\nnan,2\nyes,3\nno,4\n").to_dict()
    assert list(names["a"]) == ["no", "nan", "yes"] and list(frame["a"]) == [0, 1, 2, 0] and frame["a"].dtype == np.uint8
    assert "b" not in names
    wide = load(spark, put, b"a\n" + b"".join(b"v%d\n" % (i % 300) for i in range(900)))
    assert wide.code_dtype("a") == "uint16" and wide.level_list("a") == [f"v{i}" for i in range(300)]
    assert list(wide.to_dict()[0]["a"]) == [i % 300 for i in range(900)]


def test_ways_of_delivery(spark, put):
    path = put(b"a,b\nx,1\ny,2\nx,3\n")
    assert list(tf.load_csv_to_pandas(path)["a"]) == ["x", "y", "x"]
    assert {n: list(x) for n, x in tf.load_csv_to_expanded_columns(path)} == {"a": ["x", "y", "x"], "b": [1, 2, 3]}
    raw = {n: (list(x), s, list(v)) for n, x, s, v in tf.load_raw_csv(path)}
    assert raw == {"a": ([0, 1, 0], "cat", ["x", "y"]), "b": ([1, 2, 3], "num", [])}
    assert len(list(tf.load_csv_as_iterator(path, expand=False))[0]) == 4 and len(list(tf.load_csv_as_iterator(path, forget=False))[0]) == 2
    frame, names = tf.load_csv_to_dict(f"file://{path}")
    assert list(frame["b"]) == [1, 2, 3] and list(names["a"]) == ["x", "y"]
    assert tf.get_num_cores() >= 1
    loaded = tf.read_csv(spark, path)
    assert loaded.sums().first().asDict() == {"a": 3, "b": 6} and loaded.column("b").columns == ["b"] and loaded.count() == 3
    assert loaded.expanded().schema["a"].metadata["semantics"] == "cat"


def test_options():
    for bad in ({"out_encoding": "latin"}, {"in_encoding": "x"}, {"num_threads": -1}, {"empty_cell": "none"}, {"max_levels": -1}):
        with pytest.raises(ValueError):
            tf.ReadOptions(**bad)
    with pytest.raises(ValueError):
        tf.WriteOptions(out_encoding="utf-16")
    from textframe.options import input_path

    assert input_path("file:///a%20b") == "/a b" and input_path("C:\\x.csv") == "C:\\x.csv" and input_path("hdfs://h/x") == "hdfs://h/x"
    for bad in ("", "http://a/b", "file://host/x"):
        with pytest.raises(ValueError):
            input_path(bad)


def test_nul_and_invalid_bytes(spark, put):
    body = b"a,b\nx\0y\xff\xfe,1\n\"\xc3\xa9\xff,\",2\n"
    assert columns(load(spark, put, body, out_encoding="unknown"))["a"] == [b"x y\xff\xfe", b"\xc3\xa9\xff,"]
    assert columns(load(spark, put, body, out_encoding="unknown", convert_null_to_space=False))["a"][0] == b"x\0y\xff\xfe"
    assert columns(load(spark, put, body))["a"] == [b"x y\xff\xfe", b"\xc3\xa9\xff,"]


def random_file(rng, rows, quoted):
    alphabet = [b"a", b"1", b" ", b"\\\\", b"\\\"", b"\\,", b"\xc3\xa9", b"\xff", b"\r", b"\\n", b"\\q"]
    inside = [*alphabet, b",", b"\n" if quoted else b";", b"\\\n" if quoted else b";"]
    out = [b"p,q,r"]
    for _ in range(rows):
        cells = []
        for _ in range(3):
            cell = b"".join(alphabet[i] for i in rng.integers(0, len(alphabet), rng.integers(1, 6)))
            if rng.random() < 0.5:
                cell += b'"' + b"".join(inside[i] for i in rng.integers(0, len(inside), rng.integers(0, 12))) + b'"'
            cells.append(cell)
        out.append(b",".join(cells))
    return b"\n".join(out) + b"\n"


@pytest.mark.parametrize("quoted", [False, True])
@pytest.mark.parametrize("size", ["300", "10m"])
def test_lexer_against_bytes_for_any_split(spark, put, quoted, size):
    """The same cells as a loop over bytes gives, in the same order, however the file is cut."""
    body = random_file(np.random.default_rng(17 + quoted), 150, quoted)
    want = [tuple(scalar.decode(x).replace(b"\0", b" ") for x, _ in record) for record in scalar.parse(body)[1:]]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        frame = load(spark, put, body, allow_quoted_newlines=quoted, out_encoding="unknown", text_names=("p", "q", "r"))
        got = frame.to_pandas()
        shown = list(zip(*(got[n] for n in "pqr"), strict=True))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain = lambda x: not x.strip(b" \t\r\n\v\f-0123456789.eE+?naNA")  # noqa: E731  numbers are rewritten
    assert len(shown) == len(want)
    assert [tuple(x for x in r if not plain(x)) for r, w in zip(shown, want, strict=True)] == [tuple(x for x, y in zip(w, r, strict=True) if not plain(y)) for r, w in zip(shown, want, strict=True)]


def test_tokens_are_total(spark):
    rows = spark.createDataFrame([("a,b",), ("",), (None,), ("\\",), ('"a,b",c',), ("x" * 100_000,), ('"' + "\\\\" * 20_000 + '"',)], "v string")
    got = [r.t for r in rows.select(lexing.tokens(F.col("v")).alias("t")).collect()]
    assert got == [["a", "b"], [""], None, [""], ['"a,b"', "c"], ["x" * 100_000], ['"' + "\\\\" * 20_000 + '"']]


def test_folders_of_files_with_headers(spark, tmp_path):
    path = str(tmp_path / "many")
    frame = spark.range(100).select(F.col("id").alias("n"), F.concat(F.lit("v"), F.col("id")).alias("s")).repartition(5)
    tf.write_parts(frame, path)
    loaded = tf.read_csv(spark, path)
    assert loaded.names == ["n", "s"] and sorted(loaded.to_pandas()["n"]) == list(range(100))
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "a.csv").write_bytes(b"x,y\n1,2\nx,y\n")
    (odd / "b.csv").write_bytes(b"x,y\n3,4\n")
    (odd / "c.csv").write_bytes(b"")
    assert sorted(tf.read_csv(spark, str(odd)).to_pandas()["x"]) == ["1", "3", "x"]


def test_stream(spark, tmp_path):
    from textframe.streaming.stream import read_stream

    folder = tmp_path / "in"
    tf.write_parts(spark.range(50).select(F.col("id").alias("n"), F.lit('say "hi", you').alias("s")).repartition(2), str(folder))
    batch = tf.read_csv(spark, str(folder))
    stream = read_stream(spark, str(folder), batch.columns, header='"n","s"')
    query = stream.writeStream.format("memory").queryName("loaded").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    key = lambda rows: sorted((r.n, r.s) for r in rows)
    assert key(spark.table("loaded").collect()) == key(batch.expanded().collect())
