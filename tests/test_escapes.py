"""Escapes are replaced in the whole text, and only what that can't do is decoded unit by unit."""

from pyspark.sql import functions as F

from textframe.functions import escapes


def _values(spark, texts, value):
    frame = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, b binary").select("i", F.col("b").cast("string").alias("t"))
    return [x if x is None else bytes(x) for (x,) in frame.orderBy("i").select(value.cast("binary")).collect()]


def test_bytes_are_decoded_at_once(spark):
    texts = {rb"\xc3\xa9+%41\n\\x41\'": "é+%41\n\\x41'".encode(), rb"\x5c\x22\e": b'\\"\\', rb"\x41\u00e9": None, rb"\xff": None, rb"\x4": None, "\\x１１".encode(): None}
    assert _values(spark, texts, escapes._by_percent(F.col("t"))) == list(texts.values())
    others = {rb"\x41\u00e9": "Aé".encode(), rb"\xff": b"\xff", rb"\xef\xbf\xbd": "\ufffd".encode(), b"\xff\\x41": b"\xffA"}
    whole = {k: v for k, v in texts.items() if v} | others
    assert _values(spark, whole, escapes.unescape(F.col("t"))) == list(whole.values())


def test_letters_are_decoded_at_once(spark):
    texts = {rb"\\n\n\\\"\'\e\0": b"\\n\n\\\"'\\\0", rb"\q": None, b"a\\": None, "é\\t".encode(): "é\t".encode()}
    assert _values(spark, texts, escapes._by_letters(F.col("t"))) == list(texts.values())


def test_ascii_is_written_in_batches(spark):
    """By a function of batches, not by an expression for each character."""
    column = escapes.escape(F.col("t"), "printable_ascii")
    assert _values(spark, ["é\x7f\n\x00'".encode(), b"\xff\\", b""], column) == [rb"\xc3\xa9\x7f\n\x00\'", rb"\xff\\", b""]
    assert "ArrowEvalPython" in spark.range(1).select(F.lit("é").alias("t")).select(column)._jdf.queryExecution().executedPlan().toString()


def test_code_points_are_decoded_at_once(spark):
    texts = {rb"\u00e9\u005c\\u00e9\U0001F600\u00e9\n": "é\\\\u00e9😀é\n".encode(), b"".join(rb"\u00%02x" % i for i in range(65, 65 + 17)): None, rb"\u12": None}
    assert _values(spark, texts, escapes._by_letters(F.col("t"))) == list(texts.values())
    many = b"".join(rb"\u00%02x" % i for i in range(65, 65 + 17))
    assert _values(spark, [many], escapes.unescape(F.col("t"))) == [bytes(range(65, 65 + 17))]


def test_quotes_are_counted_without_patterns(spark):
    from textframe.sources.records import quote_count

    texts = {b'"a"': 2, rb'"\"\\"\\\"': 2, rb'\\\\"': 1, b'\\"': 0, b"": 0, b'\xff"\\': 1}
    counts = quote_count(F.col("t"))
    assert [int(x) for x in _values(spark, texts, counts.cast("string"))] == list(texts.values())
    assert "regexp" not in str(counts)


def test_cells_without_escaped_quotes_need_no_pattern(spark, monkeypatch):
    from textframe.functions import lexing

    texts = {b'"a, b"': b"a, b", b'"it\\\'s" "x"': b"it's x", rb'"\\\"\n"': b'\\"\n', b'"\xff\\"': b'\xff"'}
    assert _values(spark, texts, lexing.cell_text(F.col("t"))) == list(texts.values())
    monkeypatch.setattr(lexing, "_ESCAPE_OR_QUOTE", "(")  # no pattern at all: fails where it is used
    plain = list(texts)[:2]
    assert _values(spark, plain, lexing.cell_text(F.col("t"))) == [texts[x] for x in plain]
