"""Whole-file baselines, comparison of frames, and the registered queries."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import textframe as tf
from textframe import queries
from textframe.functions import classify
from textframe.operators import diagnostics
from textframe.plans.order import POSITION


@pytest.mark.parametrize("body", [b"", b"\n", b"a", b"a\n", b"a\n\nb", b"a\r\n\r\n", b"\n\n\n", b"\xff\0\n"])
def test_newlines_and_bytes(spark, put, body):
    path = put(body)
    assert tf.baseline_newline_count(path) == body.count(b"\n")
    assert diagnostics.byte_counts(spark, path).first()[0] == len(body)
    assert tf.baseline_disk_to_mem(path) is None


def test_averages(put):
    path = put(b"a,b,c\n1,2.5,x\n3,,7\n\n5,?,12abc\n")
    got = tf.baseline_average_columns(path)
    assert got["a"] == 9 / 4 and math.isnan(got["b"]) and got["c"] == 19 / 4
    got = tf.baseline_average_columns(put(b"a,b,c\n1,2.5,nan\n3,,7\n5,  ,8\n"), type_check=True)
    assert got["a"] == 3 and got["b"] == 4.5 / 3 and math.isnan(got["c"])
    assert tf.baseline_average_columns(put(b" \n")) == {}


def test_cell_classes(spark):
    cells = {"?": "missing", " nAn": "missing", "5": "integer", "-5": "integer", "\t7": "integer", "+5": "string", "5 ": "string", ".5": "float", "1.5": "float", "1e5": "float", "1.e5": "float", "-1.5E+3": "float", "1.": "string", "+1.5": "string", "": "empty", "  ": "empty", "-": "empty", "1.5f": "string", "Infinity": "string", "5\n": "string"}
    rows = spark.createDataFrame([(x,) for x in cells], "x string")
    assert {r.x: r.k for r in rows.select("x", classify.cell_class(F.col("x")).alias("k")).collect()} == cells
    assert {r.k for r in rows.select(classify.cell_class(F.col("x"), F.lit(True)).alias("k")).collect()} == {"string"}


def test_lenient_numbers(spark):
    cells = {"": math.nan, "  ": math.nan, "nope": math.nan, "?x": math.nan, "abc": 0.0, "12abc": 12.0, " -1.5e2z": -150.0, "+3": 3.0, ".5.5": 0.5, "Infinity": 0.0, "-Infinity": 0.0, "1.5f": 1.5}
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in cells], "x string").select("x", classify.lenient_double(F.col("x")).alias("y")).collect()}
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in cells.items()}
    whole = {"12abc": 12, "abc": 0, "": 0, "-7.5": -7, "+5": 0, "99999999999999999999": 0}
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in whole], "x string").select("x", classify.integer_prefix(F.col("x")).alias("y")).collect()}
    assert got == whole


def test_compare_frames(spark, put):
    a, b = (tf.read_csv(spark, put(x))._placed.toDF(*POSITION, "n", "s") for x in (b"n,s\n1,x\n2.5,y\n", b"n,s\n1,x\n4,z\n"))
    assert diagnostics.compare_frames(a, a).first().asDict() == {"n": 0.0, "s": 0.0}
    assert diagnostics.compare_frames(a, b).first().asDict() == {"n": 1.5, "s": 0.5}


def test_column_sums(spark):
    frame = spark.createDataFrame([(1, 1.5, "é"), (2, -0.5, None)], "i int, f double, s string")
    assert diagnostics.column_sums(frame).first().asDict() == {"i": 3, "f": 1.0, "s": 2}


SOME = ["scan_roundtrip_nation", "scan_roundtrip_documents", "scan_number_only_lineitem", "infer_semantics_orders", "forced_cat", "levels_first_appearance", "encode_codes", "newline_count", "average_columns_type_check", "column_sums_lineitem", "escape_encode_ascii", "compare_frames", "classify_cells"]


@pytest.mark.parametrize("name", SOME)
def test_queries(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.queries()[name](spark, sf_dir)
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    names = [x[0] for x in con.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want))


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(queries.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
