"""Queries of the text operators and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "op1_length_packing": "length_packing",
    "op3_quality_rules": "quality_rules",
    "op2_toxicity": "toxicity",
    "op4_merge_dropout": "merge_dropout",
    "op5_license_scan": "license_scan",
    "op6_quality_classifier": "quality_classifier",
    "op7_chat_format": "chat_format",
    "op8_token_records": "token_records",
    "op9_ngram_jaccard_join": "ngram_jaccard_join",
    "op10_exact_dedup": "exact_dedup",
    "op11_merkle_manifest": "merkle_manifest",
    "op12_spelling_variants": "spelling_variants",
    "op13_segment_tree_bpe": "segment_bpe",
}


def _modules():
    return {name: import_module(f".{module}", __package__) for name, module in MODULES.items()}


def queries() -> dict:
    import corpus_pipeline

    return {**{name: getattr(module, name) for name, module in _modules().items()}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL[name] for name, module in _modules().items() if getattr(module, "ORACLE_SQL", {}).get(name)}
