"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: Query name -> (module, SQL constant or None).
_WHERE = {
    "op1_mixing": ("mixing", "OP1_SQL"),
    "op2_sharding": ("sharding", "OP2_SQL"),
    "op3_ngram_jaccard_join": ("jaccard_join", "OP3_SQL"),
    "op4_language_id": ("langid", None),
    "op5_chat_formatting": ("chat", None),
    "op6_byte_bpe": ("bpe", None),
    "op7_exact_dedup": ("exact_dedup", "OP7_SQL"),
    "op8_suffix_array_dedup": ("repeats", "OP8_SQL"),
    "op9_quality_rules": ("quality", "OP9_SQL"),
    "op10_warc": ("warc", "OP10_SQL"),
    "op11_fill_in_middle": ("fim", "OP11_SQL"),
    "op12_word_bpe": ("word_bpe", None),
    "op13_vector_codes": ("vector_codes", "OP13_SQL"),
}


def _module(name: str):
    return importlib.import_module(f"{__package__}.{name}")


def queries() -> dict:
    return {q: getattr(_module(m), q) for q, (m, _) in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    return {q: getattr(_module(m), sql) for q, (m, sql) in _WHERE.items() if sql}
