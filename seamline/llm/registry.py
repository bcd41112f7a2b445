"""The registered queries and oracle SQL of this subpackage."""

from __future__ import annotations

import importlib

#: One module a line, each with QUERIES and, where SQL can say it, ORACLE.
MODULES = (
    "q_chat",
    "q_quality",
    "q_bpe",
    "q_licences",
    "q_mixing",
    "q_html",
    "q_repeats",
    "q_minhash",
    "q_caps",
    "q_hmm",
    "q_urls",
    "q_repair",
    "q_spelling",
)


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"seamline.llm.{name}"), what, {})
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
