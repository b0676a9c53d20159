"""Registry of the queries of this subpackage and of their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_secrets": "op1_secrets",
    "op2_language": "op2_language",
    "op3_near_vectors": "op3_near_vectors",
    "op4_substrings": "op4_substrings",
    "op5_packing": "op5_packing",
    "op6_jaccard": "op6_jaccard",
    "op7_url_filters": "op7_url_filters",
    "op8_mixing": "op8_mixing",
    "op9_topk": "op9_topk",
    "op10_licenses": "op10_licenses",
    "op11_divergence": "op11_divergence",
    "op12_conversations": "op12_conversations",
    "op13_warc": "op13_warc",
}


def queries() -> dict:
    return {name: import_module(f"murmur.llm.{m}").query for name, m in _MODULES.items()}


def oracle_sql() -> dict:
    out = {}
    for name, m in _MODULES.items():
        sql = getattr(import_module(f"murmur.llm.{m}"), "ORACLE", None)
        if sql:
            out[name] = sql
    return out
