"""Files and frames of unusual shapes: long headers, odd names, no rows, given columns; settings stay as they were."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textframe import read_csv, write_parts
from textframe.operators import diagnostics
from textframe.sources import records


@pytest.mark.parametrize("lines", [3, 5000])
def test_headers_of_any_length(spark, put, lines):
    name = "\n".join(f"line {i}" for i in range(lines))
    path = put(f'"{name}",b\n1,2\n3,4\n'.encode())
    frame = read_csv(spark, path, allow_quoted_newlines=True)
    assert frame.names == [name, "b"] and frame.count() == 2
    bare = read_csv(spark, path, allow_quoted_newlines=True, no_header=True)
    assert bare.names == ["col0", "col1"] and bare.count() == 3


def test_odd_names_are_written_and_pulled(spark, tmp_path):
    names = ["a`b", "x, y", 'q"q', "back\\slash", "_file", "x.y"]
    frame = spark.createDataFrame([(1, "u", "v", 2.5, 3, "w")], "a int, b string, c string, d double, e int, f string").toDF(*names)
    write_parts(frame, str(tmp_path / "odd"))
    loaded = read_csv(spark, str(tmp_path / "odd"))
    assert loaded.names == names
    assert [loaded.column(n).first()[0] for n in names] == [1, "u", "v", 2.5, 3, "w"]
    assert {n: x.tolist() for n, x in loaded.iter_columns()} == dict(zip(names, [[1], ["u"], ["v"], [2.5], [3], ["w"]], strict=True))


def test_repeated_names_are_written(spark, tmp_path):
    frame = spark.range(2).select(F.col("id").alias("a"), (F.col("id") + 5).alias("b")).toDF("a", "a")
    write_parts(frame.coalesce(1), str(tmp_path / "twice"))
    text = "".join(p.read_text() for p in (tmp_path / "twice").glob("part-*"))
    assert text == '"a","a"\n0,5\n1,6\n'


def test_frames_without_rows_keep_their_columns(spark, tmp_path):
    write_parts(spark.createDataFrame([], "a int, b string"), str(tmp_path / "none"))
    loaded = read_csv(spark, str(tmp_path / "none"))
    assert loaded.names == ["a", "b"] and loaded.count() == 0 and loaded.expanded().count() == 0


def test_num_threads_changes_no_setting(spark, put):
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    path = put(b"a\n" + b"".join(b"%d\n" % i for i in range(1000)))
    frame = read_csv(spark, path, num_threads=6)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) == before
    assert frame.expanded().rdd.getNumPartitions() >= 6
    assert frame.to_pandas()["a"].tolist() == list(range(1000))


def test_given_columns_need_no_inference(spark, put, monkeypatch):
    from textframe import frame as frames

    path, other = put(b"a,b\n1,x\n300,y\n"), put(b"a,b\n7,z\n")
    known = read_csv(spark, path).columns
    monkeypatch.setattr(frames, "profile", lambda *_: pytest.fail("inferred"))
    loaded = read_csv(spark, other, columns=known)
    assert loaded.columns == known and loaded.expanded().collect() == [(7, "z")]
    with pytest.raises(ValueError, match="are given"):
        read_csv(spark, put(b"a,c\n1,2\n"), columns=known)


def test_columns_are_parsed_once(spark, put, monkeypatch):
    from textframe import frame as frames

    path = put(b"a,b,c\n" + b"".join(b"%d,t%d,%d.5\n" % (i, i % 3, i) for i in range(50)))
    made = []
    kept = frames.stored
    monkeypatch.setattr(frames, "stored", lambda df, name: made.append(name) or kept(df, name))
    found = {name: (x.tolist(), meaning, list(names)) for name, x, meaning, names in read_csv(spark, path).iter_columns(expand=False)}
    assert made == ["columns"]
    assert found["a"][0] == list(range(50)) and found["b"] == ([i % 3 for i in range(50)], "cat", ["t0", "t1", "t2"]) and found["c"][0][1] == 1.5


def test_levels_by_shuffle(spark, put, monkeypatch):
    from textframe.operators import levels

    path = put(b"a,b\n" + b"".join(b"%d,t%d\n" % (i, i * 7 % 5) for i in range(200)))
    want = read_csv(spark, path).to_dict()
    monkeypatch.setattr(levels, "_small", lambda _: False)
    got = read_csv(spark, path).to_dict()
    assert all((want[0][k] == got[0][k]).all() for k in want[0]) and want[1]["b"].tolist() == got[1]["b"].tolist()


def test_compare_frames_sees_columns_with_underscores(spark):
    rows = [("f", 0, i, i, "x") for i in range(3)]
    a = spark.createDataFrame(rows, "_file string, _block bigint, _row bigint, _n1 int, `_b``c` string")
    b = a.withColumn("_n1", F.col("_n1") + 2)
    assert diagnostics.compare_frames(a, b).first().asDict() == {"_n1": 2.0, "_b`c": 0.0}


def test_compare_with_pandas(spark, put):
    path = put(b"a,b,c\n1,x,1.5\n2,y,?\n,z,2.25\n")
    assert list(diagnostics.compare_with_pandas(path).first()) == [0.0, 0.0, 0.0]


def test_golden_frame(spark, put):
    """Markers for missing values, levels in order of appearance, and the narrowest types."""
    cells = [("?", "no", "1"), ("2.5", "nan", "200"), ("3", "yes", "-1"), ("nan", "no", "7")]
    frame = read_csv(spark, put(b"x,answer,n\n" + "".join(",".join(c) + "\n" for c in cells).encode()))
    assert [(c.name, c.semantics, c.dtype) for c in frame.columns] == [("x", "num", "float"), ("answer", "cat", "string"), ("n", "num", "int16")]
    table = frame.to_pandas()
    assert np.array_equal(table["x"], [np.nan, 2.5, 3, np.nan], equal_nan=True) and table["answer"].tolist() == ["no", "nan", "yes", "no"]
    codes, names = frame.to_dict()
    assert codes["answer"].tolist() == [0, 1, 2, 0] and names["answer"].tolist() == ["no", "nan", "yes"]
    assert codes["answer"].dtype == np.uint8 and codes["n"].dtype == np.int16


def test_records_across_many_splits(spark, put):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab\n,"), rng.integers(0, 90))) for _ in range(300)]
    path = put(b"i,t\n" + "".join(f'{i},"{x}"\n' for i, x in enumerate(texts)).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        assert records.lines(spark, path).rdd.getNumPartitions() > 8
        got = read_csv(spark, path, allow_quoted_newlines=True, text_names=("t",)).to_pandas()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got["t"].tolist() == texts


def test_small_splits_share_tasks(spark, tmp_path):
    from textframe import queries

    path = str(tmp_path / "many")
    write_parts(spark.range(100_000).coalesce(1), path)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.maxPartitionNum")
    before = [spark.conf.get(x, None) for x in names]
    with queries._small_splits(spark, path):
        found = records.lines(spark, path)
        assert found.select("_file", "_block").distinct().count() > 30
        assert found.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert [spark.conf.get(x, None) for x in names] == before


def test_codes_and_levels_are_joined_as_arrays(spark, monkeypatch):
    from textframe import queries

    keys, codes, names = np.array([7, 5, 9], "int32"), np.array([1, 0, 1], "uint8"), np.array(["x", "é"], object)
    monkeypatch.setattr(type(spark), "_createFromLocal", lambda *_: pytest.fail("rows"), raising=False)
    frame = queries._joined_again(spark, keys, codes, names)
    assert frame.dtypes == [("o_orderkey", "bigint"), ("o_orderpriority", "string")]
    assert [tuple(x) for x in frame.collect()] == [(7, "é"), (5, "x"), (9, "é")]
    none = queries._joined_again(spark, keys[:0], codes[:0], names[:0])
    assert none.dtypes == frame.dtypes and none.count() == 0


def test_columns_that_are_set_to_text_are_not_inferred(spark, put, monkeypatch):
    from textframe.plans import infer

    cells = ["0", "30", "-7", "007", "-0", "1.5", "", "?", "123456789012345678", "12345678901234567890", "x"]
    path = put(("a,b\n" + "".join(f"{x},{i}\n" for i, x in enumerate(cells))).encode())
    frame = read_csv(spark, path, text_names="a")
    assert [c.dtype for c in frame.columns] == ["string", "uint8"]
    monkeypatch.setattr(infer.classify, "cell_class", lambda *_: pytest.fail("inferred"))
    assert [c.semantics for c in read_csv(spark, path, text_names=("a", "b")).columns] == ["text", "text"]
    monkeypatch.undo()
    assert frame.to_pandas()["a"].tolist() == ["0", "30", "-7", "7", "0", "1.500000", "", "nan", "123456789012345678", "12345679395506094000.000000", "x"]
