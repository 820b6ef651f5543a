"""A corpus pipeline: toxicity, near-duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes each
stage's rows as Parquet below spark.checkpoint.dir and reads them for the next. All but
the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textframe.llm import decontaminate, pieces, secrets, simhash, toxicity
from textframe.llm._common import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is one half or more go.

    A null text counts as empty and has the score of no evidence; without usable labels all rows
    stay. Texts of any length are read whole; equal texts have equal scores, so repeated rows stay or
    go together. Null ids are scored like others. An empty table gives no rows. Columns pass through.
    """
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays: the smallest doc_id's, null last.

    Null and empty texts, and those without a word, are one group. Of rows that share the smallest
    id, the one with the smallest hashes stays; of rows equal in all columns, one. Ids that are
    null or stand for several texts lose no group. Texts of any length are read whole. An empty
    table gives no rows. Columns pass through, whatever their names.
    """
    return simhash.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold nothing, nor are null or empty items held. All rows of an id that
    holds an item go, a null id's too. Texts of any length are read whole; items that equal each
    other change nothing. Empty tables of documents or items leave the documents as they are.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every row stays, and n_chars follows the text where it is a number.

    Null texts stay null, and so does their n_chars. Spans that overlap are replaced by one mark.
    Texts of any length are read whole; repeated rows stay repeated. An empty table gives no rows.
    """
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each text and of what they decode to.

    Null texts count as empty and have no ids. Texts of any length are read whole; repeated rows
    and null ids give rows like others. An empty table gives no rows. Other columns are left out.
    """
    return pieces.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("pieces", tokens),
]

#: SQL can't express the learned score, fingerprints, structural parsing or segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
