"""Queries over the given tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "sources",
    "verbs",
    "tokens",
    "sketches",
    "algebra",
    "entities",
    "ingest",
    "graphs",
    "search",
    "versions",
    "probability",
    "streams",
)


def load_all() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"bitloom.plans.{name}")
