"""Queries of this subpackage and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, collocations, decontamination, filter_audit, lm_score, near_dedup, packing, quality, sharding, token_counts, toxicity, url_filter, vector_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_lm_score": lm_score.op3_lm_score,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_sharding": sharding.op7_sharding,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_vector_search": vector_search.op9_vector_search,
        "op10_quality": quality.op10_quality,
        "op11_collocations": collocations.op11_collocations,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_packing": packing.op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_lm_score": lm_score.oracle_sql(),
        "op5_url_filter": url_filter.oracle_sql(),
        "op6_near_dedup": near_dedup.oracle_sql(),
        "op8_decontamination": decontamination.oracle_sql(),
        "op9_vector_search": vector_search.oracle_sql(),
        "op11_collocations": collocations.oracle_sql(),
        "op12_filter_audit": filter_audit.oracle_sql(),
    }
