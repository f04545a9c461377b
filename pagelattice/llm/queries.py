"""Queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: query -> (module, function)
_WHERE = {
    "op5_token_store": ("store", "op5_token_store"),
    "op7_source_mix": ("mixing", "op7_source_mix"),
    "op9_line_dedup": ("lines", "op9_line_dedup"),
    "op4_ngram_join": ("jaccard", "op4_ngram_join"),
    "op3_media_packets": ("media", "op3_media_packets"),
    "op8_chat_format": ("chat", "op8_chat_format"),
    "op1_secret_scan": ("secrets", "op1_secret_scan"),
    "op6_quality_rules": ("quality", "op6_quality_rules"),
    "quality_ablation": ("quality", "quality_ablation"),
    "op2_bpe": ("bpe", "op2_bpe"),
    "op10_toxicity": ("toxicity", "op10_toxicity"),
}


def queries() -> dict:
    """Every query by name."""
    return {q: getattr(importlib.import_module(f"{__package__}.{m}"), f) for q, (m, f) in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    out: dict[str, str] = {}
    for m in dict.fromkeys(m for m, _ in _WHERE.values()):
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), "ORACLE", {})
    return out
