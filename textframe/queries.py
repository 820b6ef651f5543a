"""The catalogue of queries over the given tables, each with SQL that gives the same rows.

Most write a table as delimited text with this library's writer into a new shared folder,
read it back with its reader, and return what was asked of the loaded frame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textframe.frame import TextFrame, read_csv
from textframe.functions import classify, escapes, lexing
from textframe.operators import diagnostics, levels
from textframe.plans.order import POSITION
from textframe.plans.storage import shared_dir, stored
from textframe.sources.records import text_files
from textframe.sources.writer import save_frame, write_parts

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Raw:
    """Cells that are written as they are, without quotes; takes the place of a frame in `_written`."""

    def __init__(self, cells: DataFrame):
        self.cells, self.sparkSession = cells, cells.sparkSession


def _written(frame: DataFrame | _Raw, **options) -> str:
    """A new folder with frame as delimited text, one file for each partition."""
    path = shared_dir(frame.sparkSession, "text")
    if isinstance(frame, _Raw):
        names = ",".join(frame.cells.columns)
        first = F.monotonically_increasing_id() % (1 << 33) == 0
        line = F.concat_ws(",", *(F.coalesce(F.col(c), F.lit("")) for c in frame.cells.columns))
        frame.cells.select(F.when(first, F.concat(F.lit(names + "\n"), line)).otherwise(line).alias("value")).write.option("lineSep", "\n").text(path)
    else:
        write_parts(frame, path, **options)
    return path


def _again(frame: DataFrame | _Raw, writing: dict | None = None, **reading) -> TextFrame:
    """frame written and read back."""
    return read_csv(frame.sparkSession, _written(frame, **(writing or {})), **reading)


def _plain(frame: DataFrame) -> DataFrame:
    """Whole numbers as bigint and floats as double, so that types do not depend on what values were found."""
    wide = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}
    return frame.select(*(F.col(c).cast(wide.get(kind, kind)).alias(c) for c, kind in frame.dtypes))


_LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load and sum: lineitem's numeric columns through delimited text, and the sum of each."""
    return column_sums_lineitem(spark, sf_dir)


# round trips


@_query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def scan_roundtrip_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_again(_table(spark, sf_dir, "region").select("r_regionkey", "r_name")).expanded())


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def scan_roundtrip_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "text")
    save_frame(path, _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return _plain(read_csv(spark, path).expanded())


@_query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, CAST(CAST(s_acctbal AS REAL) AS DOUBLE) AS s_acctbal FROM supplier")
def scan_roundtrip_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_again(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")).expanded())


@_query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, CAST(CAST(c_acctbal AS REAL) AS DOUBLE) AS c_acctbal, c_mktsegment FROM customer")
def scan_roundtrip_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_again(_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")).expanded())


@_query("SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def scan_roundtrip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return _plain(_again(docs, allow_quoted_newlines=True, text_names=("text",)).expanded())


@_query("SELECT CAST(page_id AS BIGINT) AS page_id, url, html FROM pages")
def scan_roundtrip_pages_escaped_newlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return _plain(_again(pages, {"allow_quoted_newlines": False}, text_names=("url", "html")).expanded())


@_query("SELECT CAST(event_id AS BIGINT) AS event_id, props FROM events")
def scan_roundtrip_events_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_again(_table(spark, sf_dir, "events").select("event_id", "props")).expanded())


@_query("SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations")
def dos_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return _plain(_again(turns, {"dos": True}, allow_quoted_newlines=True).expanded())


@_query("SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, md5(text) AS digest FROM documents")
def scan_bytes_out_encoding_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    loaded = _again(docs, {"out_encoding": "ascii"}, allow_quoted_newlines=True, out_encoding="unknown", text_names="text").expanded()
    return loaded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("digest"))


# headers


@_query("SELECT CAST(n_nationkey AS BIGINT) AS col0, n_name AS col1 FROM nation UNION ALL SELECT 77, 'X'")
def scan_no_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header line is data too; it is made to look like a row."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("77"), F.col("n_name").alias("X"))
    path = shared_dir(spark, "text")
    save_frame(path, rows)
    return read_csv(spark, path, no_header=True, num_names="col0").expanded().select(F.col("col0").cast("bigint").alias("col0"), "col1")


@_query("SELECT n_name AS col0, n_name AS col1 FROM nation UNION ALL SELECT 'n', 'n'")
def scan_duplicate_header_is_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("n"), F.col("n_name").alias("m"))
    path = shared_dir(spark, "text")
    save_frame(path, rows)
    return read_csv(spark, _retitled(spark, path)).expanded()


def _retitled(spark: SparkSession, path: str) -> str:
    """A copy of a file whose header is n,n."""
    out = shared_dir(spark, "text")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines.select(F.when(F.col("value") == '"n","m"', '"n","n"').otherwise(F.col("value")).alias("value")).coalesce(1).write.text(out)
    return out


# numbers


@_query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, CAST(CAST(l_extendedprice AS REAL) AS DOUBLE) AS l_extendedprice FROM lineitem")
def scan_number_only_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return _plain(_again(rows, number_only=True).expanded())


@_query("SELECT CAST(l_orderkey AS BIGINT) AS a, CAST(CASE WHEN l_linenumber = 3 THEN 0 ELSE l_partkey END AS BIGINT) AS b FROM lineitem")
def empty_cells_number_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    cell = F.when(F.col("l_linenumber") == 3, "").otherwise(F.col("l_partkey").cast("string"))
    return _plain(_again(_Raw(rows.select(F.col("l_orderkey").cast("string").alias("a"), cell.alias("b"))), number_only=True).expanded())


@_query("SELECT count(*) AS n_rows, count(*) FILTER (l_linenumber = 3) AS n_nan, round(sum(CASE WHEN l_linenumber <> 3 THEN l_partkey END), 0) AS total FROM lineitem")
def missing_markers_to_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    cell = F.when(F.col("l_linenumber") == 3, F.when(F.col("l_orderkey") % 2 == 0, "?").otherwise("NaN")).otherwise(F.col("l_partkey").cast("string"))
    loaded = _again(_Raw(rows.select(F.col("l_orderkey").cast("string").alias("a"), cell.alias("b")))).expanded()
    nan = F.isnan("b")
    return loaded.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(nan).alias("n_nan"), F.round(F.sum(F.when(~nan, F.col("b").cast("double"))), 0).alias("total"))


@_query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity FROM lineitem")
def whole_floats_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _again(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"))
    if loaded.info("l_quantity").dtype != "uint8":
        raise ValueError("whole floats are expected to narrow")
    return _plain(loaded.expanded())


@_query("SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(CAST(l_extendedprice AS REAL) AS DOUBLE) AS l_extendedprice FROM lineitem")
def float32_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_again(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")).expanded())


_CELLS = {"lower(o_orderpriority)": "string", "'?'": "missing", "'nAn'": "missing", "CAST(o_orderkey AS VARCHAR)": "integer", "'-' || CAST(o_orderkey AS VARCHAR)": "integer", "'+' || CAST(o_orderkey AS VARCHAR)": "string"}
_CELLS |= {"'  ' || CAST(o_orderkey AS VARCHAR)": "integer", "CAST(o_orderkey AS VARCHAR) || ' '": "string", "CAST(o_orderkey AS VARCHAR) || '.'": "string", "'.' || CAST(o_orderkey AS VARCHAR)": "float", "CAST(o_orderkey AS VARCHAR) || 'e5'": "float", "CAST(o_orderkey AS VARCHAR) || '.e-5'": "float", "CAST(o_orderkey AS VARCHAR) || 'ABC'": "string", "''": "empty", "'-'": "empty", "'Infinity'": "string"}


@_query(" UNION ALL ".join(f"SELECT {cell} AS cell, '{kind}' AS class, count(*) AS n FROM orders GROUP BY 1" for cell, kind in _CELLS.items()))
def classify_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of cells made from orders, each in many shapes."""
    orders = _table(spark, sf_dir, "orders")
    shapes = F.array(*(F.expr(x.replace("VARCHAR", "STRING")) for x in _CELLS))
    cells = orders.select(F.posexplode(shapes).alias("shape", "cell"))
    return cells.select("shape", "cell", classify.cell_class(F.col("cell")).alias("class")).groupBy("shape", "cell", "class").agg(F.count(F.lit(1)).alias("n")).drop("shape")


# meanings and storage


def _meanings(frame: TextFrame) -> DataFrame:
    rows = [(c.name, c.semantics, frame.code_dtype(c.name) if c.semantics == "cat" else c.dtype) for c in frame.columns]
    return frame.spark.createDataFrame(rows, "name string, semantics string, dtype string")


_RUNGS = "CASE WHEN min({0}) >= 0 AND max({0}) <= 255 THEN 'uint8' WHEN min({0}) >= -128 AND max({0}) <= 127 THEN 'int8' WHEN min({0}) >= -32768 AND max({0}) <= 32767 THEN 'int16' WHEN min({0}) >= -2147483648 AND max({0}) <= 2147483647 THEN 'int32' ELSE 'int64' END"
_WIDTH = "CASE WHEN count(DISTINCT {0}) <= 255 THEN 'uint8' WHEN count(DISTINCT {0}) <= 65535 THEN 'uint16' ELSE 'uint32' END"


@_query(
    " UNION ALL ".join(f"SELECT '{c}' AS name, 'num' AS semantics, {_RUNGS.format(c)} AS dtype FROM orders" for c in ("o_orderkey", "o_custkey"))
    + " UNION ALL SELECT 'o_totalprice', 'num', 'float' UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', 'cat', {_WIDTH.format(c)} FROM orders" for c in ("o_orderstatus", "o_orderpriority"))
)
def infer_semantics_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meanings(_again(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")))


_LADDER = {"a": "l_linenumber", "b": "l_linenumber - 4", "c": "(l_partkey % 300) - 7", "d": "l_orderkey * 7 - 9", "e": "l_orderkey * 5000000000"}


@_query(" UNION ALL ".join(f"SELECT '{name}' AS name, 'num' AS semantics, {_RUNGS.format('x')} AS dtype FROM (SELECT {x} AS x FROM lineitem)" for name, x in _LADDER.items()))
def infer_storage_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return _meanings(_again(rows.select(*(F.expr(x.replace("5000000000", "5000000000L")).alias(name) for name, x in _LADDER.items()))))


@_query(f"SELECT 'c_name' AS name, 'cat' AS semantics, {_WIDTH.format('c_name')} AS dtype FROM customer UNION ALL SELECT 'c_mktsegment', 'cat', {_WIDTH.format('c_mktsegment')} FROM customer")
def code_width_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meanings(_again(_table(spark, sf_dir, "customer").select("c_name", "c_mktsegment")))


@_query("SELECT 'c_name' AS name, CASE WHEN count(DISTINCT c_name) > 20 THEN 'text' ELSE 'cat' END AS semantics, CASE WHEN count(DISTINCT c_name) > 20 THEN 'string' ELSE 'uint8' END AS dtype FROM customer UNION ALL SELECT 'c_mktsegment', 'cat', 'uint8'")
def max_levels_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meanings(_again(_table(spark, sf_dir, "customer").select("c_name", "c_mktsegment"), max_levels=20))


@_query("SELECT 'lang' AS name, 'cat' AS semantics, 'uint8' AS dtype UNION ALL SELECT 'text', CASE WHEN max(octet_length(encode(text))) > 40 THEN 'text' ELSE 'cat' END, 'string' FROM documents")
def max_level_name_length_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meanings(_again(_table(spark, sf_dir, "documents").select("lang", "text"), allow_quoted_newlines=True, max_level_name_length=40))


@_query("SELECT CAST(CAST(l_linenumber AS BIGINT) AS VARCHAR) AS l_linenumber, printf('%.6f', CAST(CAST(l_discount AS REAL) AS DOUBLE)) AS l_discount FROM lineitem")
def forced_cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_linenumber", "l_discount")
    return _again(rows, cat_names=("l_linenumber", "l_discount")).expanded()


@_query("SELECT CAST(CAST(l_partkey AS BIGINT) AS VARCHAR) AS l_partkey, l_returnflag FROM lineitem")
def forced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    return _again(rows, text_names=("l_partkey", "l_returnflag")).expanded()


@_query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(regexp_extract(o_orderpriority, '^[0-9]+') AS BIGINT) AS o_orderpriority FROM orders")
def forced_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-URGENT, 2-HIGH and so on, read as the numbers they begin with."""
    return _plain(_again(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), num_names="o_orderpriority").expanded())


# levels and codes

_LEVELS = "SELECT {0} AS level, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY {0}"


def _by_key(spark: SparkSession, sf_dir: str) -> TextFrame:
    """Orders in the order of their keys, in one file after the other."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return _again(rows.orderBy("o_orderkey"))


@_query(_LEVELS.format("o_orderpriority"))
def levels_first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_key(spark, sf_dir).levels("o_orderpriority").select("level", F.col("code").cast("bigint").alias("code"))


@_query(f"WITH l AS ({_LEVELS.format('o_orderstatus')}) SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(code AS BIGINT) AS code FROM orders JOIN l ON o_orderstatus = level")
def encode_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _by_key(spark, sf_dir).encoded()
    return loaded.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_orderstatus").cast("bigint").alias("code"))


@_query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_orderpriority FROM orders")
def decode_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _by_key(spark, sf_dir)
    coded = loaded.encoded().select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderpriority")
    return levels.decoded(coded, "o_orderpriority", loaded.levels("o_orderpriority"), loaded.level_count("o_orderpriority"))


# the reader on files of other shapes


@contextmanager
def _small_splits(spark: SparkSession, path: str) -> Iterator[None]:
    """Files are cut into splits of 16 kB, of which a task reads some thousand, as starting a task for each takes longer than reading it."""
    length = sum(n for _, n in spark.read.format("binaryFile").load(path).select("path", "length").collect())
    tasks = max(spark.sparkContext.defaultParallelism, -(-length // (16 << 20)))
    wanted = {"spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.maxPartitionNum": str(tasks)}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@_query("SELECT CAST(doc_id AS BIGINT) AS doc_id, text FROM documents")
def records_across_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of 16 kB, so that many texts with line ends begin in one split and end in another."""
    path = _written(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    with _small_splits(spark, path):
        return stored(_plain(read_csv(spark, path, allow_quoted_newlines=True, text_names=("text",)).expanded()), "across")


@_query("SELECT CAST(l_orderkey AS BIGINT) AS a, CAST(l_partkey AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY ALL")
def blank_lines_are_no_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty line, or one with a carriage return only, after each record."""
    rows = _table(spark, sf_dir, "lineitem")
    b = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "\n").otherwise("\n\r"))
    path = _written(_Raw(rows.select(F.col("l_orderkey").cast("string").alias("a"), b.alias("b"))))
    return _plain(read_csv(spark, path).expanded()).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT sum(l_orderkey) / (2 * count(*)) AS a, sum(l_partkey) / (2 * count(*)) AS b FROM lineitem")
def average_columns_with_blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank lines count as lines, and add nothing."""
    rows = _table(spark, sf_dir, "lineitem")
    b = F.concat(F.col("l_partkey").cast("string"), F.lit("\n"))
    return diagnostics.column_averages(spark, _written(_Raw(rows.select(F.col("l_orderkey").cast("string").alias("a"), b.alias("b")))))


@_query("SELECT " + ", ".join(f"round(sum(CAST(CAST({c} AS REAL) AS DOUBLE)), 2) AS {c}" for c in _LINEITEM) + " FROM lineitem")
def given_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of a known layout: meanings and types come from another file, and nothing is inferred."""
    some = _table(spark, sf_dir, "lineitem").select(*_LINEITEM)
    known = _again(some).columns
    sums = read_csv(spark, _written(some), columns=known).sums()
    return sums.select(*(F.round(F.col(c).cast("double"), 2).alias(c) for c in _LINEITEM))


@_query("SELECT CAST(c_custkey AS BIGINT) AS \"a `b`\", c_name AS \"x, y\", c_mktsegment AS \"it's \"\"quoted\"\" \\\" FROM customer")
def odd_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with backticks, commas, quotes and backslashes are escaped in the header and decoded again."""
    frame = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").toDF("a `b`", "x, y", "it's \"quoted\" \\")
    loaded = _again(frame)
    i, x, y = (loaded.column(c) for c in loaded.names)
    names = i.columns + x.columns + y.columns
    return loaded.expanded().toDF("i", "x", "y").select(F.col("i").cast("bigint"), "x", "y").toDF(*names)


@_query("SELECT doc_id, CASE WHEN regexp_matches(left(text, 20), '[\\s\"''\\\\,]') OR left(text, 20) = '' THEN '\"' || replace(replace(replace(replace(replace(left(text, 20), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '\"' ELSE left(text, 20) END AS quoted FROM documents")
def quoted_if_needed_beginnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of texts: most need quotes, single long words don't."""
    return _table(spark, sf_dir, "documents").select("doc_id", escapes.quoted_if_needed(F.substring("text", 1, 20)).alias("quoted"))


@_query("SELECT 2.0::DOUBLE AS c_custkey, avg(CASE WHEN c_custkey % 7 = 0 THEN 1.0 ELSE 0.0 END) AS c_name, 0.0::DOUBLE AS c_nationkey FROM customer")
def compare_frames_that_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One id of a thousand is off by two, and each seventh name differs."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey").orderBy("c_custkey")
    key = F.col("c_custkey")
    other = rows.select((key + F.when(key == 5, 2).otherwise(0)).alias("c_custkey"), F.when(key % 7 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), "c_nationkey")
    return diagnostics.compare_frames(*(_again(x).placed().toDF(*POSITION, *rows.columns) for x in (rows, other)))


def _delivered(spark: SparkSession, found: dict) -> DataFrame:
    """(place, name, n, total): how many values a column has on the driver, and the sum of its numbers or of its texts' lengths."""
    rows = [(i, name, len(x), float(sum(len(v) for v in x) if x.dtype == object else x.astype(float).sum())) for i, (name, x) in enumerate(found.items())]
    return spark.createDataFrame(rows, "place bigint, name string, n bigint, total double")


_DELIVERED = """SELECT CAST(0 AS BIGINT) AS place, 's_suppkey' AS name, count(*) AS n, CAST(sum(s_suppkey) AS DOUBLE) AS total FROM supplier
UNION ALL SELECT 1, 's_name', count(*), CAST(sum(length(s_name)) AS DOUBLE) FROM supplier UNION ALL SELECT 2, 's_nationkey', count(*), CAST(sum(s_nationkey) AS DOUBLE) FROM supplier"""


@_query(_DELIVERED)
def to_pandas_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pandas frame of a loaded file."""
    frame = _again(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")).to_pandas()
    return _delivered(spark, {c: frame[c].to_numpy() for c in frame.columns})


@_query(_DELIVERED)
def expanded_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns pulled one by one, expanded."""
    return _delivered(spark, dict(_again(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")).iter_columns(expand=True)))


@_query("""WITH r AS (SELECT DISTINCT o_orderpriority AS l FROM orders)
SELECT 'o_orderkey' AS name, 'num' AS semantics, CAST(0 AS BIGINT) AS levels, count(*) AS n FROM orders
UNION ALL SELECT 'o_orderpriority', 'cat', (SELECT count(*) FROM r), count(*) FROM orders""")
def raw_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns pulled one by one as they are, with meanings and levels; each code is one of the levels'."""
    loaded = _again(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"))
    rows = [(name, meaning, len(names), int(sum(x < len(names)) if len(names) else len(x))) for name, x, meaning, names in loaded.iter_columns(expand=False)]
    return spark.createDataFrame(rows, "name string, semantics string, levels bigint, n bigint")


def _joined_again(spark: SparkSession, keys: np.ndarray, codes: np.ndarray, names: np.ndarray) -> DataFrame:
    """Keys and the levels of codes, from arrays as they are; a tuple for each row would take the driver's memory and time."""
    found = pa.array(names, pa.string()).take(pa.array(codes.astype("int64")))
    return spark.createDataFrame(pa.table({"o_orderkey": pa.array(keys.astype("int64")), "o_orderpriority": found}))


@_query("SELECT o_orderkey, l.o_orderpriority FROM orders o JOIN (SELECT DISTINCT o_orderpriority FROM orders) l USING (o_orderpriority)")
def dict_codes_and_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays by name with codes, and their levels, put together again."""
    frame, names = _again(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")).to_dict()
    return _joined_again(spark, frame["o_orderkey"], frame["o_orderpriority"], names["o_orderpriority"])


# diagnostics


@_query("SELECT CAST(sum(length(text) - length(replace(text, chr(10), ''))) + count(*) + 1 AS BIGINT) AS newlines FROM documents")
def newline_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    headers = len(text_files(spark, path))  # each file has one
    return diagnostics.newline_counts(spark, path).select((F.col("newlines") - headers + 1).alias("newlines"))


@_query("SELECT CAST(sum(octet_length(encode(CAST(doc_id AS VARCHAR) || ',\"' || replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), '''', '\\''') || '\"')) + 1) + 16 AS BIGINT) AS bytes FROM documents")
def disk_to_mem_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    headers = len(text_files(spark, path))  # each file has one, of 16 bytes
    return diagnostics.byte_counts(spark, path).select((F.col("bytes") - 16 * (headers - 1)).alias("bytes"))


@_query("SELECT " + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _LINEITEM) + " FROM lineitem")
def average_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(_table(spark, sf_dir, "lineitem").select(*_LINEITEM))
    means = diagnostics.column_averages(spark, path)
    return means.select(*(F.round(c, 4).alias(c) for c in means.columns))


@_query("SELECT round(avg(l_orderkey), 4) AS a, round(avg(CASE WHEN l_linenumber = 3 THEN 2 ELSE l_partkey END), 4) AS b, CAST('nan' AS DOUBLE) AS c FROM lineitem")
def average_columns_type_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank cells count their length; one missing marker makes the mean NaN."""
    rows = _table(spark, sf_dir, "lineitem")
    b = F.when(F.col("l_linenumber") == 3, "  ").otherwise(F.col("l_partkey").cast("string"))
    c = F.when(F.col("l_linenumber") == 1, "?").otherwise("5")
    path = _written(_Raw(rows.select(F.col("l_orderkey").cast("string").alias("a"), b.alias("b"), c.alias("c"))))
    means = diagnostics.column_averages(spark, path, type_check=True)
    return means.select(*(F.round(x, 4).alias(x) for x in means.columns))


@_query("SELECT " + ", ".join(f"round(sum(CAST(CAST({c} AS REAL) AS DOUBLE)), 2) AS {c}" for c in _LINEITEM) + " FROM lineitem")
def column_sums_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _again(_table(spark, sf_dir, "lineitem").select(*_LINEITEM)).sums()
    return sums.select(*(F.round(F.col(c).cast("double"), 2).alias(c) for c in _LINEITEM))


@_query("SELECT CAST(sum(doc_id) AS BIGINT) AS doc_id, CAST(sum(octet_length(encode(text))) AS BIGINT) AS text, CAST(sum(octet_length(encode(lang))) AS BIGINT) AS lang FROM documents")
def column_sums_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), allow_quoted_newlines=True).sums()


@_query("SELECT 0.0::DOUBLE AS doc_id, 0.0::DOUBLE AS text, 0.0::DOUBLE AS lang WHERE (SELECT count(*) FROM documents) > 0")
def compare_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ways of writing and reading documents give the same frame."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").orderBy("doc_id")
    names = ["doc_id", "text", "lang"]
    loaded = [_again(docs, {"out_encoding": e, "dos": e == "ascii"}, allow_quoted_newlines=True)._placed.toDF(*POSITION, *names) for e in ("arbitrary", "ascii")]
    return diagnostics.compare_frames(*loaded)


# escapes


@_query("SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), '''', '\\''') AS escaped FROM documents")
def escape_encode_arbitrary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", escapes.escape(F.col("text")).alias("escaped"))


@_query("SELECT doc_id, replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), '''', '\\'''), chr(10), '\\n') AS escaped FROM documents")
def escape_encode_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", escapes.escape(F.col("text"), "utf-8", newlines=True).alias("escaped"))


_HEX_BYTES = "array_to_string(list_transform(regexp_extract_all({0}, '[\\s\\S]'), lambda c: CASE WHEN c = '\\' THEN '\\\\' WHEN c = '\"' THEN '\\\"' WHEN c = '''' THEN '\\''' {1} WHEN ord(c) >= 127 THEN regexp_replace(lower(hex(encode(c))), '(..)', '\\\\x\\1', 'g') ELSE c END), '')"


@_query(f"SELECT doc_id, {_HEX_BYTES.format('text', '')} AS escaped FROM documents")
def escape_encode_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", escapes.escape(F.col("text"), "ascii").alias("escaped"))


@_query(f"SELECT page_id, {_HEX_BYTES.format('html', "WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t'")} AS escaped FROM pages")
def escape_encode_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", escapes.escape(F.col("html"), "printable_ascii").alias("escaped"))


@_query("SELECT doc_id, text AS decoded FROM documents")
def escape_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", escapes.unescape(escapes.escape(F.col("text"), "printable_ascii")).alias("decoded"))


@_query("SELECT doc_id, replace(text, 'e', chr(233)) AS decoded FROM documents")
def escape_decode_code_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    marked = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("e"), F.lit("\\u00e9"))
    return docs.select("doc_id", escapes.unescape(marked).alias("decoded"))


@_query("SELECT doc_id, replace(text, 'e', ' ') AS spaced FROM documents")
def null_to_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", escapes.null_to_space(F.replace("text", F.lit("e"), F.lit("\0"))).alias("spaced"))


@_query("SELECT doc_id, " + "'\"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '\"' AS quoted FROM documents")
def quoted_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", escapes.as_quoted_string(F.col("text")).alias("quoted"))


@_query("SELECT doc_id, CASE WHEN regexp_matches(lang, '[\\s\"''\\\\,]') OR lang = '' THEN '\"' || lang || '\"' ELSE lang END AS quoted FROM documents")
def quoted_if_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", escapes.quoted_if_needed(F.col("lang")).alias("quoted"))


@_query("SELECT doc_id, CAST(1 AS BIGINT) AS n_cells, text AS cell, true AS quoted FROM documents")
def lex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quoted cell for each text, whatever commas, quotes and line ends are in it."""
    docs = _table(spark, sf_dir, "documents")
    record = F.concat(F.lit('"'), escapes.escape(F.col("text")), F.lit('"'))
    found = docs.select("doc_id", lexing.tokens(record).alias("t"))
    return found.select("doc_id", F.size("t").cast("bigint").alias("n_cells"), lexing.cell_text(F.col("t")[0]).alias("cell"), lexing.is_quoted(F.col("t")[0]).alias("quoted"))


# what Spark gives on a loaded frame


@_query("SELECT o_orderpriority, count(*) AS n, round(sum(CAST(CAST(o_totalprice AS REAL) AS DOUBLE)), 1) AS total FROM orders WHERE o_orderstatus = 'O' GROUP BY o_orderpriority")
def loaded_filter_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _again(_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")).expanded()
    return loaded.filter("o_orderstatus = 'O'").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 1).alias("total"))


@_query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def loaded_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = _again(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")).expanded()
    nations = _again(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")).expanded()
    return suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"]).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
