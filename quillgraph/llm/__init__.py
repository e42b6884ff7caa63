"""Training-data operators. Nothing else in the library imports this subpackage.

queries() and oracle_sql() list the contract queries; each lives beside its operator.
"""

from __future__ import annotations

import importlib

MODULES = {
    "op1_html_wrapper": "html_wrapper",
    "op2_pii_crf": "pii_crf",
    "op3_quality_weak": "quality_weak",
    "op4_lm_mixing": "lm_mixing",
    "op5_license_join": "license_join",
    "op6_lang_rank": "lang_rank",
    "op7_odd_sketch": "near_dedup",
    "op8_token_prefix": "token_prefix",
    "op9_bpe_stream": "bpe_stream",
    "op10_decontaminate": "decontaminate",
    "op11_conversation_trie": "conversation_trie",
    "op12_fill_middle": "fill_middle",
    "op13_url_filter": "url_filter",
}


def queries() -> dict:
    """Name to a function of (spark, sf_dir) for each of the thirteen operators."""
    return {name: importlib.import_module(f"{__name__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    loaded = {name: importlib.import_module(f"{__name__}.{module}") for name, module in MODULES.items()}
    return {name: module.ORACLE_SQL for name, module in loaded.items() if getattr(module, "ORACLE_SQL", None)}
