"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import (bpe, byte_bpe, embedding_dedup, exact_dedup, language_id, lexical_search, packing, pii,
                       quality, simhash_dedup, spelling_variants, substring_dedup, url_filter)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": packing.op1_packing,
        "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_bpe": bpe.op4_bpe,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_language_id": language_id.op7_language_id,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_pii": pii.op9_pii,
        "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
        "op11_byte_bpe": byte_bpe.op11_byte_bpe,
        "op12_spelling_variants": spelling_variants.op12_spelling_variants,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": exact_dedup.SQL,
        "op6_url_filter": url_filter.SQL,
        "op13_lexical_search": lexical_search.SQL,
    }
