"""Spans of pattern and lexicon matches with exact code-point offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from careline.functions.core import (
    alternation, apply_sql, col, let, let_sql, literal, nz, part, part_sql, prefix_sums_sql, rx, strings,
)

SPAN = "array<struct<start:int,end:int,text:string>>"


#: Put around the matches of a pattern where the text itself does not hold it.
MARK = "\x01"


def pattern_spans(text: Column | str, pattern: str | Column) -> Column:
    """All non-overlapping matches of a pattern that never matches empty text.

    One pass marks the matches, and a cut at the marks gives them and the text between
    them; offsets follow from the lengths of both. ``end`` is exclusive.
    """
    t, p = nz(text), F.lit(rx(pattern)) if isinstance(pattern, str) else pattern
    match, start = "get(x_, 2 * i + 1)", "b_ + length(get(x_, 2 * i))"
    sums = prefix_sums_sql("(size(x_) div 2)", "length(get(x_, 2 * j_)) + length(get(x_, 2 * j_ + 1))")
    placed = (f"if(size(x_) < 2, cast(array() as {SPAN}), transform({sums}, (b_, i) -> named_struct("
              f"'start', {start}, 'end', {start} + length({match}), 'text', {match})))")
    # text before a match and the match in turn, and the text behind the last one
    twice = apply_sql(F.struct(F.regexp_extract_all(t, p, F.lit(0)).alias("m"), F.split(t, p, -1).alias("g")), "y_",
                      "concat(flatten(transform(y_.m, (m, i) -> array(get(y_.g, i), m))), array(''))")
    pieces = F.when(F.contains(t, F.lit(MARK)), twice).otherwise(
        F.split(F.regexp_replace(t, p, F.lit(f"{MARK}$0{MARK}")), MARK, -1))
    return apply_sql(pieces, "x_", placed)


def term_places(text: Column | str, terms: Sequence[str], more: int = 0) -> Column:
    """The places where a term may start, in text order, as start and head: the characters from there on, as many as the
    longest term and ``more`` have. The first place is the start of the text, also without a term.

    The text is cut before each position where some term starts; the pieces give the positions.
    """
    cut = "(?=" + alternation(terms) + ")"
    head = head_sql("x_", "i", max(len(x) for x in terms) + more)
    sums = prefix_sums_sql("size(x_)", "length(get(x_, j_))")
    return apply_sql(F.split(nz(text), cut, -1), "x_",
                     f"transform({sums}, (b_, i) -> named_struct('start', b_, 'head', {head}))")


def placed_terms(places: Column, terms: Sequence[tuple[str, int]], tail: str = "") -> Column:
    """The terms, given with numbers, that start at places (:func:`term_places`, also of more terms): i, start, end,
    text, by number and start. With ``tail``, a pattern, a match goes on as far as that reaches."""
    firsts: dict[str, list] = {}
    for term, i in terms:
        firsts.setdefault(term[0], []).append(f"named_struct('k', {literal(term)}, 'i', {i})")
    table = "map(" + ", ".join(f"{literal(c)}, array({', '.join(rows)})" for c, rows in firsts.items()) + ")"
    none = "slice(array(named_struct('k', '', 'i', 0)), 1, 0)"
    more = f" + length(regexp_extract(substring(p.head, length(r.k) + 1), {literal('^' + tail)}, 0))" if tail else ""
    one = let_sql(f"length(r.k){more}", "n_", "named_struct('i', r.i, 'start', p.start, 'end', p.start + n_, "
                  "'text', substring(p.head, 1, n_))")
    return apply_sql(places, "x_", (
        f"array_sort(flatten(transform(x_, p -> transform(filter(coalesce({table}[substring(p.head, 1, 1)], {none}), "
        f"r -> startswith(p.head, r.k)), r -> {one}))))"))


def term_spans(text: Column | str, terms: Sequence[str]) -> Column:
    """Every occurrence of every term, also inside each other, ordered by start; only at the places where
    some term starts the terms are compared."""
    heads = "flatten(transform(x_.p, p -> transform(filter(x_.terms, k -> startswith(p.head, k)), k -> named_struct("\
        "'start', p.start, 'end', p.start + length(k), 'text', k))))"
    return apply_sql(F.struct(term_places(text, terms).alias("p"), strings(terms).alias("terms")), "x_", heads)


def head_sql(pieces: str, i: str, n: int) -> str:
    """The first ``n`` characters of a text from its ``i``-th piece on, in SQL text."""
    joined = f"array_join({part_sql(pieces, i, n)}, '')"
    return f"substring(if(length(get({pieces}, {i})) >= {n}, get({pieces}, {i}), {joined}), 1, {n})"


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def counts_before(points: Column, marks: Column, at_mark: bool) -> Column:
    """For each mark the number of points before it (``at_mark``: or on it), in the order of the
    marks. Points are in ascending order; a mark halves them until its place is found, so few marks
    cost little among many points."""
    low = f"get(b_.p, (s_.a + s_.b) div 2) {'<=' if at_mark else '<'} m_"
    step = (f"if(s_.a >= s_.b, s_, if({low}, named_struct('a', cast((s_.a + s_.b) div 2 as int) + 1, 'b', s_.b), "
            "named_struct('a', s_.a, 'b', cast((s_.a + s_.b) div 2 as int))))")
    return apply_sql(F.struct(points.alias("p"), marks.alias("m")), "b_", (
        "transform(b_.m, m_ -> aggregate(sequence(0, length(bin(size(b_.p)))), "
        f"named_struct('a', 0, 'b', size(b_.p)), (s_, r_) -> {step}, s_ -> s_.a))"))


def clusters(spans: Column, gap: int = 0) -> Column:
    """Spans in groups that have nothing to do with each other, from left to right.

    A group ends where all spans so far have ended (``gap`` characters before the next start at
    least). With starts and ends each in order, the i-th span opens a group if the i earlier
    ends lie before it, so sorting is all that is needed. Inside a group the given order is kept. Rules that
    only look at overlapping spans cost the square of a group and not of a text.
    """
    def cut(b: Column) -> Column:
        s, e = b["s"], b["e"]
        heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (
            F.get(e, i - 1) + gap <= F.get(s, i)["a"]))
        return let(F.struct(s.alias("s"), heads.alias("h")), lambda c: F.transform(
            c["h"], lambda h, k: part(c["s"], h, F.coalesce(
                F.get(c["h"], k + 1), F.size(c["s"])) - h)))

    def given(group: Column) -> Column:
        return F.when(F.size(group) == 1, F.transform(group, lambda x: x["s"])).otherwise(F.transform(
            F.array_sort(F.transform(group, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))),
            lambda x: x["s"]))

    placed = F.array_sort(F.transform(spans, lambda s, i: F.struct(
        s["start"].alias("a"), i.alias("i"), s.alias("s"))))
    ends = F.array_sort(F.transform(spans, lambda s: s["end"]))
    found = let(F.struct(placed.alias("s"), ends.alias("e")), lambda b: F.when(
        F.size(b["s"]) > 0, cut(b)).otherwise(F.slice(F.array(b["s"]), 1, 0)))
    return F.transform(found, given)


def in_clusters(spans: Column, rule, gap: int = 0) -> Column:
    """What ``rule`` (group of spans to array) keeps of each group, from left to right."""
    return F.flatten(F.transform(clusters(spans, gap), rule))


def longest_non_overlapping(spans: Column | str) -> Column:
    """From the left, keep a span that starts after the last kept one ends; a strictly
    longer overlapping span takes the place of the last kept one."""

    def width(s: Column) -> Column:
        return s["end"] - s["start"]

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        return (
            F.when(F.size(kept) == 0, F.array(s))
            .when(s["start"] >= last["end"], F.concat(kept, F.array(s)))
            .when(width(s) > width(last),
                  F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(s)))
            .otherwise(kept)
        )

    def rule(group: Column) -> Column:
        ordered = F.array_sort(
            group,
            lambda a, b: F.coalesce(
                F.nullif(F.signum(a["start"] - b["start"]).cast("int"), F.lit(0)),
                F.signum(b["end"] - a["end"]).cast("int")),
        )
        return F.when(F.size(group) == 1, group).otherwise(
            let(ordered, lambda s: F.aggregate(s, F.slice(s, 1, 0), step)))

    return let(col(spans), lambda s: in_clusters(s, rule))


def add_uncovered(base: Column | str, extra: Column | str) -> Column:
    """Spans of ``base`` plus those of ``extra`` with an end inside none of them,
    ordered by start. As in the source rule, an extra span that contains a base span
    on both sides counts as apart."""
    def touches(x: Column, y: Column) -> Column:
        return ((x["start"] >= y["start"]) & (x["start"] < y["end"])) | (
            (x["end"] > y["start"]) & (x["end"] <= y["end"]))

    def marked(spans: Column, more: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(more).alias("more"), s.alias("s")))

    def rule(group: Column) -> Column:
        fresh = F.filter(group, lambda x: ~x["more"] | ~F.exists(
            group, lambda y: ~y["more"] & touches(x, y)))
        return by_start(F.transform(fresh, lambda x: x["s"]))

    return let(F.concat(marked(col(base), False), marked(col(extra), True)),
               lambda b: in_clusters(b, rule))


def greedy(spans: Column) -> Column:
    """Take spans in the given order unless they overlap one taken before."""
    return F.when(F.size(spans) == 1, spans).otherwise(F.aggregate(
        spans, F.slice(spans, 1, 0),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: overlaps(s, k)), kept
        ).otherwise(F.concat(kept, F.array(s)))))


def accept_in_order(spans: Column) -> Column:
    """Greedy choice (:func:`greedy`) of the spans of a whole text, from left to right by groups."""
    return let(spans, lambda all_: in_clusters(all_, greedy))


def by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda x, y: F.signum(x["start"] - y["start"]).cast("int"))


def mask_spans(text: Column | str, spans: Column) -> Column:
    """Replace non-overlapping spans (ordered by start) by their ``mask``.

    The kept pieces are cut out once and joined, so the text is not copied per span.
    """
    start = "if(i = 0, 0, get(x_.s, i - 1).end)"
    piece = (f"concat(if(i < size(x_.s), substring(x_.t, {start} + 1, get(x_.s, i).start - {start}), "
             f"substring(x_.t, {start} + 1)), coalesce(get(x_.s, i).mask, ''))")
    masked = f"array_join(transform(sequence(0, size(x_.s)), i -> {piece}), '')"
    return apply_sql(F.struct(nz(text).alias("t"), spans.alias("s")), "x_",
                     f"if(size(x_.s) = 0, x_.t, {masked})")
