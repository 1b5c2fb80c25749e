"""Registry of the training-data queries: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

_MODULES = ("jaccard", "decontaminate", "embeddings", "secrets", "chat", "bpe", "langid", "lines", "chunks", "quality")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _m in _MODULES:
    _mod = importlib.import_module(f"concordat.llm.{_m}")
    QUERIES[_mod.NAME] = _mod.query
    if getattr(_mod, "ORACLE_SQL", None):
        ORACLES[_mod.NAME] = _mod.ORACLE_SQL
