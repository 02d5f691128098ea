"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_fingerprint, op2_ngram_jaccard, op3_substring_dedup, op4_packing, op5_language_id, op6_token_counts, op7_url_filter, op8_sampled_pieces, op9_quality_rules, op10_quality_classifier, op11_source_divergence, op12_exact_dedup, op13_schema_rewrite

MODULES = (op1_fingerprint, op2_ngram_jaccard, op3_substring_dedup, op4_packing, op5_language_id, op6_token_counts, op7_url_filter, op8_sampled_pieces, op9_quality_rules, op10_quality_classifier, op11_source_divergence, op12_exact_dedup, op13_schema_rewrite)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(m, name) for m in MODULES for name in (m.__name__.rpartition(".")[2],)}


def oracle_sql() -> dict[str, str]:
    return {m.__name__.rpartition(".")[2]: m.ORACLE_SQL for m in MODULES if getattr(m, "ORACLE_SQL", None)}
