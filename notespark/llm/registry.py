"""The registered queries on training documents, and their SQL where SQL can state them."""

from __future__ import annotations

from notespark.llm import (
    conversation_trie,
    exact_dedup,
    mixing,
    pack_windows,
    pii,
    quality_rules,
    shuffle_shards,
    simhash,
    sketches,
    suffix_dedup,
    token_files,
    toxicity,
    vector_codes,
)

MODULES = [
    simhash, token_files, pack_windows, shuffle_shards, quality_rules, pii, suffix_dedup, exact_dedup, toxicity, mixing,
    conversation_trie, sketches, vector_codes,
]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
