"""Queries of the training-data operators, by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_mix_sources": "mixing",
    "op2_language_id": "language_crf",
    "op3_token_counts": "unigram_count",
    "op4_toxicity": "toxicity",
    "op5_quality_rules": "quality_rules",
    "op6_pack_sequences": "packing",
    "op7_bit_packed_ids": "bitpack",
    "op8_substring_dedup": "substring_dedup",
    "op9_matroska": "matroska",
    "op10_jaccard_join": "jaccard_join",
    "op11_token_alignment": "alignment",
    "op12_collocations": "collocations",
    "op13_suffix_dedup": "suffix_dedup",
}


def queries() -> dict:
    import corpus_pipeline

    found = {name: import_module(f"spanwise.llm.{module}").query for name, module in _MODULES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"spanwise.llm.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
