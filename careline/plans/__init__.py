"""Registered queries."""

from importlib import import_module

MODULES = ["queries_text", "queries_turns", "queries_detect", "queries_graph", "queries_reports",
           "queries_streams", "queries_io"]


def _load():
    for m in MODULES:
        import_module(f"careline.plans.{m}")
    return import_module("careline.plans.registry")


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_sql() -> dict:
    return dict(_load().ORACLE)
