"""Named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


# ---- writing SQL from rule tables ---------------------------------------------------

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(values: Sequence[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def sql_any(text: str, terms: Sequence[str]) -> str:
    """True if any term is part of the text."""
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def sql_count(text: str, terms: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({text}, {q(t)})::INT" for t in terms) + ")"


def sql_match(text: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, {q(p)})" for p in patterns) + ")"


def sql_replace(text: str, pairs: Sequence[tuple[str, str]], flags: str = "g") -> str:
    for pattern, new in pairs:
        text = f"regexp_replace({text}, {q(pattern)}, {q(new)}, '{flags}')"
    return text


WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WS}+|{WS}+$', '', 'g')"


def sql_values(rows: Sequence[Sequence], names: str) -> str:
    def lit(v) -> str:
        return q(v) if isinstance(v, str) else ("NULL" if v is None else str(v))
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {names}"
