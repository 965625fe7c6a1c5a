"""A training-corpus pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All stages but the last return the columns of
``documents``; the last gives each remaining document's tokens as counts and digests.

Every stage works on whole texts of any length and takes an empty table to an empty result. Rows
are kept or dropped one by one: a null identifier is smaller than every other one, and rows may
share an identifier with different texts. Further columns, whatever their names, go along to the
last stage but one. What each stage does with nulls, empty texts, ties and repeated rows stands
with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from cairn.session import materialise, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``und`` goes: null and empty texts and those without a letter.

    Repeated rows are judged alike; where no row has a language to learn from, all documents go.
    """
    found = language_id.fit_and_identify(docs)
    return found.filter(F.col("lid.lang_pred") != "und").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id; null and empty texts are equal.

    Of rows that repeat both text and that identifier one stays, whichever; a null identifier stays
    only if the text has no other.
    """
    return exact_dedup.mark_exact(docs, keep="largest").filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the row with the least doc_id, a null one being the least.

    Of different texts under that identifier the one with the least hash stays; rows that repeat
    both are one document (the stage before leaves one of them). Null and wordless texts stay.
    """
    return near_dedup.drop_near(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough words from the benchmark to count as contaminated.

    Null and wordless texts stay; repeated rows are judged alike; without a benchmark all stay.
    """
    found = decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~decontaminate.contaminated()).select("row.*")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's tokens, and the digest of the text they decode to.

    A null text counts as empty; each row, repeated or not, gives one row.
    """
    return bpe.op9_bpe(spark, docs)


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenise),
]

#: SQL cannot express the first, third and last stage; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``; each one's result is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
