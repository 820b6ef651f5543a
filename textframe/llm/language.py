"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (DIMENSIONS long, drawn from the letter's
code point), and so has the gap between words. Three letters in a row are bound into one
vector by multiplying the first, rotated twice, with the second, rotated once, and the
third. A text's vector bundles (adds) those of all its letter triples; a language's
prototype bundles all texts of that language. The nearest prototype by cosine is the
prediction, its cosine (0 if negative) the score.

Prototypes are whole-number sums formed in each task and added up by Spark, so they do
not depend on how rows are dealt; one vector for each language reaches the driver, and
the languages of a table are few whatever its size. Texts are read whole, in two narrow
passes. The distinct triples of a batch are bound once, SLICE at a time, and only the
triples that a text has are kept for it, so many letters or one very long text cost no
memory beyond a few times the batch.

Null texts, and those without a letter, are `und` with score 0, and so is every text if
no language was learned. Ties go to the language whose name sorts first. Rows with a
null language or in the held-out fold teach nothing. Rows are neither merged nor dropped;
columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textframe.llm._common import held_out

DIMENSIONS = 1024
SEED = 20_000
UNKNOWN = "und"
#: Texts that are read together, and triples that are bound together, at most.
ROWS = 512
SLICE = 2048
#: Size up to which a table takes the place of a sort.
TABLE = 1 << 22


@lru_cache(30_000)
def letter_vector(code: int) -> np.ndarray:
    """The vector of a letter; 0 is the gap between words."""
    return np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


@lru_cache(30_000)
def _turned(code: int, turn: int) -> np.ndarray:
    return np.roll(letter_vector(code), turn)


class Reader:
    """Turns texts into counts of letter triples. Keeps what it knows of letters between batches."""

    def __init__(self):
        self.known = np.full(0x110000, -1, np.int32)  # code point to place in `letters`; 0 is no letter
        self.letters = [0]
        self.place = {0: 0}

    def _learn(self, codes: np.ndarray) -> None:
        for code in np.unique(codes).tolist():
            char = chr(code)
            low = ord(char.lower()[0]) if char.isalpha() else 0
            if low not in self.place:
                self.place[low] = len(self.letters)
                self.letters.append(low)
            self.known[code] = self.place[low]

    def triples(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(triples, place, text, n): the distinct triples, as rows of letters, and where each occurs: its place among them, the text, and how often."""
        codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        at = self.known[codes]
        if (new := at < 0).any():
            self._learn(codes[new])
            at = self.known[codes]
        text = np.repeat(np.arange(len(texts) + 1), [1 + len(x) for x in texts] + [1])  # a text and the line end before it
        gap = at == 0
        kept = ~(gap & np.append(False, gap[:-1])) | (np.diff(text, prepend=-1) != 0)
        at, text = at[kept], text[kept]
        a, b, c = at[:-2], at[1:-1], at[2:]
        whole = (text[:-2] == text[1:-1]) & (b > 0) & ((c == 0) | (text[2:] == text[1:-1]))
        whole |= (text[:-2] == text[2:]) & (b == 0) & (a > 0) & (c > 0)
        size = len(self.letters)
        code = ((a.astype(np.int64) * size + b) * size + c)[whole]
        text, rows = text[:-2][whole], max(1, len(texts))
        distinct, rank = _ranked(code, size**3)
        names = np.array(self.letters)
        letters = np.stack([names[distinct // size**2], names[distinct // size % size], names[distinct % size]], 1)
        pair = rank * rows + text
        if rows * len(distinct) <= TABLE:
            counts = np.bincount(pair, minlength=rows * len(distinct))
            pair = np.flatnonzero(counts)
            n = counts[pair]
        else:
            pair, n = np.unique(pair, return_counts=True)
        return letters, pair // rows, pair % rows, n


def _ranked(code: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes below `most`, and each code's place among them."""
    if most > TABLE:
        return np.unique(code, return_inverse=True)
    there = np.zeros(most, bool)
    there[code] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1).astype(np.int64)[code]


def bundle(triples: np.ndarray, place: np.ndarray, of: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """The sums of the triples' vectors for each of `rows` groups; place: in triples, ascending; of: group; n: how often.

    Triples are bound SLICE at a time, so memory grows with neither their number nor the texts' length.
    """
    out = np.zeros((rows, DIMENSIONS))
    kind = np.float32 if n.sum(dtype=np.int64) < 1 << 24 else np.float64  # whole numbers, exact in either
    for first in range(0, len(triples), SLICE):
        a, b = np.searchsorted(place, (first, first + SLICE))
        size = min(SLICE, len(triples) - first)
        counts = np.bincount(of[a:b] * size + place[a:b] - first, n[a:b], rows * size).reshape(rows, size)
        some = np.flatnonzero(counts.any(1))
        out[some] += counts[some].astype(kind) @ bind(triples[first : first + size]).astype(kind, copy=False)
    return out


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows and about `most` bytes of text."""
    from textframe.llm._common import parts

    for batch in parts(batches, "text", most):
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def bind(triples: np.ndarray) -> np.ndarray:
    """The vectors of letter triples."""
    out = np.empty((len(triples), DIMENSIONS), np.float32)
    tables = []
    for turn, column in zip((2, 1, 0), triples.T, strict=True):
        letters, rank = np.unique(column, return_inverse=True)
        tables.append((np.stack([_turned(x, turn) for x in letters.tolist()]) if len(letters) else np.zeros((0, DIMENSIONS), np.int8), rank))
    (x, i), (y, j), (z, k) = tables
    np.multiply(x[i] * y[j], z[k], out=out, casting="unsafe")
    return out


def prototypes(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Language to the sum of its texts' vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        reader = Reader()
        for batch in _pieces(batches, 1_000_000):
            langs = batch.column("lang").to_pylist()
            triples, place, text, n = reader.triples([x or "" for x in batch.column("text").to_pylist()])
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs])[text]
            for name, total in zip(names, bundle(triples, place, of, n, len(names)), strict=True):
                sums[name] = sums.get(name, 0) + total.round().astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "sums"])

    each = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    rows = each.mapInArrow(run, "lang string, sums array<bigint>").select("lang", F.posexplode("sums").alias("at", "part"))
    out: dict[str, np.ndarray] = {}
    for lang, at, part in rows.groupBy("lang", "at").agg(F.sum("part")).collect():
        out.setdefault(lang, np.zeros(DIMENSIONS))[at] = part
    return {x: v for x, v in sorted(out.items()) if v.any()}


def predict(docs: DataFrame, learned: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for each row of docs."""
    names = [*learned, UNKNOWN]
    unit = np.stack([v / np.linalg.norm(v) for v in learned.values()]) if learned else np.zeros((0, DIMENSIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in _pieces(batches, 1_000_000):
            triples, place, text, n = reader.triples([x or "" for x in batch.column("text").to_pylist()])
            found = np.bincount(text, minlength=batch.num_rows) > 0 if len(unit) else np.zeros(batch.num_rows, bool)
            best, score = np.full(len(found), len(unit)), np.zeros(len(found))
            if found.any():
                vectors = bundle(triples, place, text, n, len(found))[found]
                near = vectors @ unit.T
                best[found] = near.argmax(1)
                score[found] = near.max(1) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
            out = pa.array(np.array(names, object)[best], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), out, pa.array(np.clip(score, 0, 1))], ["id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """What op2 returns."""
    learned = prototypes(docs.filter(~held_out(F.col("doc_id"))))
    return predict(docs, learned).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
