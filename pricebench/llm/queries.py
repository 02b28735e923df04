"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricebench.llm import main_text, near_dedup, prefix_trie, quality_rules, secret_scans, source_divergence, top_k
from pricebench.llm.byte_bpe import op3_byte_bpe
from pricebench.llm.licences import op10_licences
from pricebench.llm.packing import op6_packing
from pricebench.llm.quality_model import op5_quality_model
from pricebench.llm.quotations import op7_quotations
from pricebench.llm.token_counts import op4_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": main_text.op1_main_text,
        "op2_top_k": top_k.op2_top_k,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_token_counts": op4_token_counts,
        "op5_quality_model": op5_quality_model,
        "op6_packing": op6_packing,
        "op7_quotations": op7_quotations,
        "op8_minmax_dedup": near_dedup.op8_minmax_dedup,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op9_cleaned_text": quality_rules.op9_cleaned_text,
        "op10_licences": op10_licences,
        "op11_source_divergence": source_divergence.op11_source_divergence,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_secret_scans": secret_scans.op13_secret_scans,
    }


def oracles() -> dict[str, str]:
    return {
        "op1_main_text": main_text.ORACLE,
        "op2_top_k": top_k.ORACLE,
        "op8_minmax_dedup": near_dedup.ORACLE,
        "op9_quality_rules": quality_rules.ORACLE,
        "op9_cleaned_text": quality_rules.CLEANED_ORACLE,
        "op11_source_divergence": source_divergence.ORACLE,
        "op12_prefix_trie": prefix_trie.ORACLE,
        "op13_secret_scans": secret_scans.ORACLE,
    }
