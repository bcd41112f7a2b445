"""All queries on the reference's operators, with their SQL equivalents."""

from __future__ import annotations

import importlib

#: Modules of seamline.plans, each with QUERIES and, where SQL can say it, ORACLE.
MODULES: tuple[str, ...] = (
    "q_ordered",
    "q_eventhistory",
    "q_ladder",
    "q_homogeneity",
    "q_geometry",
    "q_groupstats",
    "q_segments",
    "q_search",
    "q_matching",
    "q_intervals",
    "q_more",
    "q_profiles",
    "q_repair",
    "q_boosted",
    "q_stages",
    "q_reads",
    "q_tables",
    "q_streaming",
)


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"seamline.plans.{name}"), what, {})
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
