"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

MODULES = ["simhash", "toxicity", "quality", "embeddings", "lattice_lm", "pii", "byte_bpe", "token_counts", "media", "mixing", "trie", "whitening", "repeats"]


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"riskweave.llm.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"riskweave.llm.{name}").ORACLE
    return out
