"""The corpus operators' queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketloom.llm import (
    decontamination, fill_in_middle, line_dedup, lm_scoring, minmax_dedup, mixing, neighbours, ngram_join, prefix_trie, quality, sharding, span_dedup, toxicity,
)

MODULES = {
    "op1_toxicity": toxicity,
    "op2_ngram_join": ngram_join,
    "op3_line_dedup": line_dedup,
    "op4_neighbours": neighbours,
    "op5_span_dedup": span_dedup,
    "op6_sharding": sharding,
    "op7_mixing": mixing,
    "op8_lm_scoring": lm_scoring,
    "op9_quality": quality,
    "op10_decontamination": decontamination,
    "op11_prefix_trie": prefix_trie,
    "op12_minmax_dedup": minmax_dedup,
    "op13_fill_in_middle": fill_in_middle,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in MODULES.items() if getattr(module, "ORACLE_SQL", None)}
