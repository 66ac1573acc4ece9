"""Small readers for the rule tables, which are kept as plain text."""

from __future__ import annotations


def words(block: str) -> list[str]:
    """Comma-separated terms over any number of lines; inner blanks are kept."""
    out = []
    for line in block.strip().splitlines():
        out += [w.strip() for w in line.split(",") if w.strip()]
    return out


def lines(block: str) -> list[str]:
    """One entry per line (for patterns, which contain commas)."""
    return [ln.strip() for ln in block.strip().splitlines() if ln.strip()]


def described(block: str) -> list[tuple[str, str, str]]:
    """``category: term, term=description`` lines as (term, category, description)."""
    out = []
    for line in block.strip().splitlines():
        category, _, rest = line.strip().partition(":")
        for item in rest.split(","):
            term, _, description = item.strip().partition("=")
            if term:
                out.append((term, category, description or term))
    return out


def fields(block: str, sep: str = "|") -> list[tuple[str, ...]]:
    """One record per line, fields parted by ``sep``."""
    return [tuple(p.strip() for p in ln.split(sep)) for ln in lines(block)]
