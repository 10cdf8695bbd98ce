"""Registered queries over the benchmark tables, with their DuckDB equivalents."""

from __future__ import annotations


MODULES = ("retrieval", "texts", "corpora", "spans", "sections", "interactions", "streams")


def all_workloads() -> dict:
    """Name -> (query, sql or None) of every registered query."""
    from importlib import import_module

    found: dict = {}
    for name in MODULES:
        found.update(import_module(f"spanloom.workloads.{name}").WORKLOADS)
    return found
