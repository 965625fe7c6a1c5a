"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bpe, decontaminate, exact_dedup, language_id, line_dedup, near_dedup, ngram_join, quality, spelling, substring_dedup, toxicity, warc, whitening
from cairn.session import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": lambda s, d: line_dedup.op1_line_dedup(s, table(s, d, "documents")),
        "op2_language_id": lambda s, d: language_id.op2_language_id(s, table(s, d, "documents")),
        "op3_toxicity": lambda s, d: toxicity.op3_toxicity(s, table(s, d, "documents"), table(s, d, "labels")),
        "op4_warc": lambda s, d: warc.op4_warc(s, table(s, d, "pages")),
        "op5_quality": lambda s, d: quality.op5_quality(s, table(s, d, "documents"), table(s, d, "labels")),
        "op6_exact_dedup": lambda s, d: exact_dedup.op6_exact_dedup(s, table(s, d, "documents")),
        "op7_decontaminate": lambda s, d: decontaminate.op7_decontaminate(s, table(s, d, "documents"), table(s, d, "benchmark")),
        "op8_substring_dedup": lambda s, d: substring_dedup.op8_substring_dedup(s, table(s, d, "documents")),
        "op10_near_dedup": lambda s, d: near_dedup.op10_near_dedup(s, table(s, d, "documents")),
        "op11_spelling_variants": lambda s, d: spelling.op11_spelling_variants(s, table(s, d, "documents")),
        "op13_ngram_join": lambda s, d: ngram_join.op13_ngram_join(s, table(s, d, "documents")),
        "op12_whitening": lambda s, d: whitening.op12_whitening(s, table(s, d, "embeddings")),
        "op9_bpe": lambda s, d: bpe.op9_bpe(s, table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op4_warc": warc.ORACLE_SQL,
        "op6_exact_dedup": exact_dedup.ORACLE_SQL,
        "op7_decontaminate": decontaminate.ORACLE_SQL,
        "op8_substring_dedup": substring_dedup.ORACLE_SQL,
        "op13_ngram_join": ngram_join.ORACLE_SQL,
    }
