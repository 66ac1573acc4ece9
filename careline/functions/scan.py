"""Matches of many rules by one look at each character of a text.

A pattern is tried by the JVM at every place of a text, and every pattern for itself. Here the characters
of a text are an array, places where a rule can match are found by table look-ups on that array, and
patterns are tried at those places only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from careline.functions.core import nz

FOUND = "struct<spans:array<struct<i:int,start:int,end:int,text:string>>,seen:array<int>>"
SPANS = pa.struct([("i", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
#: White space as the JVM's Unicode classes have it; Python's adds four control characters.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHARS = 0x110000
#: Matches that a task holds as Python objects at once.
PART = 100_000


class Rule(NamedTuple):
    """A pattern that never matches empty text. Each match holds one of ``chars`` from ``lo`` to ``hi`` places after
    its start; with ``apart``, ``lo`` and ``hi`` are 0 and no match follows a character of that range."""

    pattern: str
    chars: str
    lo: int = 0
    hi: int = 0
    apart: str = ""


class Term(NamedTuple):
    """One of some literals, the longest first, and a pattern (for spans only) for what follows it."""

    heads: tuple[str, ...]
    tail: str = ""


def compiled(pattern: str) -> re.Pattern:
    """A pattern of the JVM with the same white space; the rules write it alone or inside a class."""
    return re.compile(re.sub(r"\[([^\]]*)\\s([^\]]*)\]", lambda m: f"[{m[1]}{SPACE}{m[2]}]", pattern).replace(
        "\\s", f"[{SPACE}]"))


def _table(chars: Iterable[str]) -> np.ndarray:
    table = np.zeros(CHARS, bool)
    table[[ord(c) for c in chars]] = True
    return table


DIGITS = "".join(c for c in map(chr, range(CHARS)) if c.isdecimal())


def _starts(keys: Iterable[str]) -> Callable[[np.ndarray], Iterator[tuple[int, list[int]]]]:
    """A function from characters to places where a key of two characters may start, then where one of a single
    character does."""
    first, second = (_table(k[n] for k in keys if len(k) == 2) for n in (0, 1))
    alone = _table(k for k in keys if len(k) == 1)

    def starts(codes: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        yield 2, np.flatnonzero(first[codes[:-1]] & second[codes[1:]]).tolist()
        yield 1, np.flatnonzero(alone[codes]).tolist()

    return starts


def finder(spans: Sequence[Rule | Term], seen: Sequence[Rule | Term | str]) -> Callable[[str], tuple[list, list]]:
    """A function from a text to its matches of ``spans``, by rule and start, those of a rule apart from each
    other, and the numbers of the rules of ``seen`` (strings: patterns) that match anywhere."""
    terms, literals, places, anywhere = {}, {}, {}, []
    for wanted, rules in ((True, spans), (False, seen)):
        for i, rule in enumerate(rules):
            if isinstance(rule, str):
                anywhere.append((i, compiled(rule).search))
            elif isinstance(rule, Term) and not wanted:
                for head in rule.heads:
                    literals.setdefault(head[:2], []).append((i, head))
            elif isinstance(rule, Term):
                tail = compiled(rule.tail).match if rule.tail else None
                for head in rule.heads:
                    terms.setdefault(head[:2], []).append((i, head, tail))
            else:
                places.setdefault(rule[1:], []).append((wanted, i, compiled(rule.pattern).match))
    tables = [(_table(chars), lo, hi, [ord(c) for c in apart], rules) for (chars, lo, hi, apart), rules in places.items()]
    term_starts, literal_starts = _starts(terms), _starts(literals)

    def find(text: str) -> tuple[list, list]:
        out, hits = [], {i for i, search in anywhere if search(text)}
        if not text:
            return out, sorted(hits)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

        for key in {text[p:p + n] for n, starts in literal_starts(codes) for p in starts}:
            hits.update(i for i, head in literals.get(key, ()) if len(head) == len(key) or head in text)
        ends: dict[int, int] = {}
        for p in sorted(p for _, starts in term_starts(codes) for p in starts):
            for key in {text[p:p + 2]: 0, text[p]: 0}:
                for i, head, tail in terms.get(key, ()):
                    if text.startswith(head, p) and p >= ends.get(i, 0):
                        end = p + len(head)
                        end = ends[i] = tail(text, end).end() if tail else end
                        out.append((i, p, end, text[p:end]))
        for table, lo, hi, apart, rules in tables:
            near = np.flatnonzero(table[codes])
            if not len(near):
                continue
            if apart:
                before = codes[near - 1]
                near = near[(near == 0) | (before < apart[0]) | (before > apart[1])]
            if hi:
                near = np.unique((near[:, None] - np.arange(lo, hi + 1)).ravel())
                near = near[near >= 0]
            starts = near.tolist()
            for wanted, i, match in rules:
                last = 0
                for p in starts:
                    if p >= last and (m := match(text, p)):
                        if not wanted:
                            hits.add(i)
                            break
                        last = m.end()
                        out.append((i, p, last, m.group()))
        out.sort()
        return out, sorted(hits)

    return find


def scan(text: Column | str, spans: Sequence[Rule | Term] = (), seen: Sequence[Rule | Term | str] = ()) -> Column:
    """Matches of rules in a text: ``spans`` with rule, start, end and text, ``seen`` with numbers of rules."""
    spans, seen = tuple(spans), tuple(seen)

    def part(rows: list, numbers: list, row_ends: list, number_ends: list) -> pa.Array:
        made = pa.StructArray.from_arrays([
            pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(SPANS), SPANS)], fields=list(SPANS))
        return pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(pa.array(row_ends, pa.int32()), made),
            pa.ListArray.from_arrays(pa.array(number_ends, pa.int32()), pa.array(numbers, pa.int32()))], ["spans", "seen"])

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        find = finder(spans, seen)
        for batch in batches:
            parts, rows, numbers, row_ends, number_ends = [], [], [], [0], [0]
            for text in batch:
                matches, hits = find(text.as_py())
                rows += matches
                numbers += hits
                row_ends.append(len(rows))
                number_ends.append(len(numbers))
                if len(rows) + len(numbers) >= PART:
                    parts.append(part(rows, numbers, row_ends, number_ends))
                    rows, numbers, row_ends, number_ends = [], [], [0], [0]
            yield pa.concat_arrays([*parts, part(rows, numbers, row_ends, number_ends)])

    return F.arrow_udf(found, FOUND)(F.make_valid_utf8(nz(text)))
