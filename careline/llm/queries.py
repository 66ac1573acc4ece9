"""Queries of the training-data operators: name -> query, and name -> SQL."""

from importlib import import_module

MODULES = ["q_decontaminate", "q_langid", "q_simhash", "q_exact", "q_packing", "q_quality", "q_warc", "q_tokens",
           "q_extract", "q_chat", "q_search", "q_runs", "q_urls"]


def _all(kind: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"careline.llm.{m}"), kind)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")
