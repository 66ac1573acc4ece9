"""Splitting of texts into sections, chunks, sentences and turns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from careline.functions.core import let, nz, part, rx, strings, strip
from careline.functions.text import clean_text, normalize_role
from careline.rules import dialogue


def _append(items: Column, item: Column) -> Column:
    return F.concat(items, F.array(item))


def _pack(parts: Column, limit: int, gap: int, keep_blank: bool) -> Column:
    """Greedy packing of parts, joined by a blank line, into pieces up to ``limit``.

    ``gap`` is what the joining line counts for. ``keep_blank`` keeps a piece that is
    only white space (trimmed to nothing), as the paragraph rule does.
    """

    def worth(c: Column) -> Column:
        return (c != "") if keep_blank else (strip(c) != "")

    def emit(done: Column, cur: Column) -> Column:
        return F.when(worth(cur), _append(done, strip(cur))).otherwise(done)

    def step(st: Column, part: Column) -> Column:
        full = F.length(st["cur"]) + F.length(part) + gap > limit
        grown = F.when(st["cur"] != "", F.concat(st["cur"], F.lit("\n\n"), part)).otherwise(part)
        return F.struct(
            F.when(full, emit(st["done"], st["cur"])).otherwise(st["done"]).alias("done"),
            F.when(full, part).otherwise(grown).alias("cur"))

    zero = F.struct(strings([]).alias("done"), F.lit("").alias("cur"))
    return F.aggregate(parts, zero, step, lambda st: emit(st["done"], st["cur"]))


def section_split(text: Column | str, long_section: int = 500) -> Column:
    """Sections between ``---`` lines, or at a blank line once a section is long.

    The fold over the lines only notes where sections begin and end; the texts are cut out once.
    """
    def step(st: Column, line: Column) -> Column:
        held = st["begin"] < line["i"]
        cut = line["rule"] | (line["blank"] & held & (st["chars"] - 1 > long_section))
        section = F.struct(st["begin"].alias("a"), line["i"].alias("b"))
        return F.struct(
            F.when(cut & held, _append(st["done"], section)).otherwise(st["done"]).alias("done"),
            F.when(cut, line["i"] + 1).otherwise(st["begin"]).alias("begin"),
            F.when(cut, F.lit(0)).otherwise(st["chars"] + line["n"] + 1).alias("chars"))

    def cut(lines: Column) -> Column:
        seen = F.transform(lines, lambda x, i: let(strip(x), lambda bare: F.struct(
            i.alias("i"), F.startswith(bare, F.lit("---")).alias("rule"), (bare == "").alias("blank"),
            F.length(x).alias("n"))))
        zero = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("done"),
                        F.lit(0).alias("begin"), F.lit(0).alias("chars"))
        spans = F.aggregate(seen, zero, step, lambda st: _append(
            st["done"], F.struct(st["begin"].alias("a"), F.size(lines).alias("b"))))
        return F.filter(F.transform(spans, lambda s: strip(F.array_join(
            part(lines, s["a"], s["b"] - s["a"]), "\n"))), lambda x: x != "")

    return let(F.split(nz(text), "\n", -1), cut)


def pack_paragraphs(sections: Column, limit: int = 1000) -> Column:
    """Sections over the limit are cut at blank lines and packed again."""
    return F.flatten(F.transform(sections, lambda s: F.when(
        F.length(s) > limit, _pack(F.split(s, "\n\n", -1), limit, 0, True)
    ).otherwise(F.array(s))))


def numbered_split_merge(text: Column | str, limit: int = 8000) -> Column:
    """Cut before numbered headings, cut what is too long at blank lines, merge what is
    short again up to the limit."""
    heads = F.split(nz(text), r"(?U)\n(?=\d+[\.\)]\s)", -1)
    small = F.flatten(F.transform(heads, lambda s: (
        F.when(F.length(s) > limit, _pack(F.split(s, "\n\n", -1), limit, 0, False))
        .when(strip(s) != "", F.array(strip(s))).otherwise(strings([])))))
    return _pack(small, limit, 2, False)


def markdown_sections(text: Column | str) -> Column:
    return F.filter(F.split(nz(text), "\n## ", -1), lambda s: strip(s) != "")


def fixed_windows(text: Column | str, size: int = 1000, overlap: int = 200) -> Column:
    """Windows of ``size`` characters, each starting ``size - overlap`` after the last."""
    step = size - overlap

    def cut(t: Column) -> Column:
        last = F.greatest(F.ceil((F.length(t) - overlap) / step).cast("int") - 1, F.lit(0))
        return F.when(t == "", strings([])).otherwise(F.transform(
            F.sequence(F.lit(0), last), lambda i: F.substring(t, i * step + 1, F.lit(size))))

    return let(nz(text), cut)


# Separators of the two call forms, widest first.
CORPUS_SEPARATORS = ["\n---\n", "\n\n", "\n", " "]
DEFAULT_SEPARATORS = ["\n\n", "\n", " ", ""]


def _cut(text: str, sep: str) -> list[str]:
    """Pieces of a text, each but the first starting with the separator."""
    if sep == "":
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in [head, *[sep + r for r in rest]] if p]


def _merge(pieces: Sequence[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size``; the next chunk keeps up to ``overlap``
    characters of the pieces before it."""
    out, window, length = [], [], 0
    for piece in pieces:
        if window and length + len(piece) > size:
            out.append("".join(window))
            while window and (length > overlap or length + len(piece) > size):
                length -= len(window.pop(0))
        window.append(piece)
        length += len(piece)
    if window:
        out.append("".join(window))
    return out


def split_recursively(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Cut at the widest separator present; what stays too long is cut at the next one."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    narrower, out, fitting = separators[at + 1:], [], []
    for piece in _cut(text, separators[at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        out += _merge(fitting, size, overlap)
        fitting = []
        out += split_recursively(piece, size, overlap, narrower) if narrower else [piece]
    out += _merge(fitting, size, overlap)
    return [c for c in (chunk.strip() for chunk in out) if c]


def recursive_chunk(
    size: int = 1000, overlap: int = 200, separators: Sequence[str] = tuple(CORPUS_SEPARATORS),
):
    """Arrow UDF: text → chunks. A state machine over separators has no built-in form."""
    seps = list(separators)

    @F.pandas_udf("array<string>")
    def chunk(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.fillna("").map(lambda t: split_recursively(t, size, overlap, seps))

    return chunk


def sentences(
    text: Column | str, flush: int = dialogue.FLUSH_CHARS, pattern: tuple[str, str] = dialogue.SENTENCE_END,
) -> Column:
    """Sentences in order. What follows the last sentence end is, if long, also cut at
    its last blank, so that no tail waits for a mark that never comes."""
    t = nz(text)
    parts = F.split(t, "(?U)(?<=" + pattern[0] + ")" + pattern[1], -1)
    ended = F.slice(parts, 1, F.size(parts) - 1)
    tail = F.element_at(parts, -1)
    # Up to but without the last blank: code points before it, or -1 without one.
    at = F.length(F.regexp_extract(tail, "(?s)^(.* )", 1)) - 1
    pieces = F.when((F.length(tail) >= flush) & (at >= flush // 2), F.array(
        F.substring(tail, F.lit(1), at), F.substring(tail, at + 1, F.length(tail)))
    ).otherwise(F.array(tail))
    return F.filter(F.transform(F.concat(ended, pieces), strip), lambda s: s != "")


# ---- transcripts ------------------------------------------------------------------

def transcript_sections(text: Column | str, topic: Column) -> Column:
    """(topic, text) sections by the first heading form that occurs in the text.

    Text before the first heading keeps the file's topic. A stretch that itself starts
    like a heading counts as one and carries no text.
    """
    t = nz(text)

    def build(heading: str, start: str, name) -> Column:
        parts = F.struct(
            F.regexp_extract_all(t, F.lit(rx(heading)), F.lit(0)).alias("h"),
            F.split(t, rx(heading), -1).alias("g"))

        def sections(p: Column) -> Column:
            return F.filter(F.transform(p["g"], lambda g, i: let(strip(g), lambda s: F.struct(
                F.when(i == 0, topic).otherwise(name(F.get(p["h"], i - 1))).alias("topic"),
                F.when((s == "") | s.rlike(rx("^" + start)), F.lit("")).otherwise(
                    F.concat(F.lit(" "), s)).alias("text")))), lambda x: x["text"] != "")

        return let(parts, sections)

    def without(chars: str):
        return lambda h: strip(F.translate(h, chars, ""))

    forms = [
        (dialogue.ANGLE_HEADING, "<[^>]+>", without("<>")),
        (dialogue.BRACKET_HEADING, "\\[(?:사례|상황)", without("[]")),
        (dialogue.CASE_HEADING, "사례\\s*\\d+",
         lambda h: strip(F.regexp_replace(h, "[:：]+$", ""))),
        ("(?i)" + dialogue.SYSTEM_HEADING, "(?i)System", lambda h: topic),
    ]
    out = F.when(F.lit(False), F.array().cast("array<struct<topic:string,text:string>>"))
    for heading, start, name in forms:
        out = out.when(t.rlike(rx(heading)), build(heading, start, name))
    return out.otherwise(F.array(F.struct(topic.alias("topic"), t.alias("text"))))


def extract_turns(text: Column | str, version: int = 2) -> Column:
    """(role, content) turns between role labels, in order."""
    label = "(?mi)" + rx(dialogue.ROLE_LABEL)
    t = nz(text)
    parts = F.struct(F.regexp_extract_all(t, F.lit(label), F.lit(1)).alias("r"),
                     F.split(t, label, -1).alias("g"))

    def message(raw: Column) -> Column:
        own = strip(F.regexp_replace(strip(raw), "(?s)(?:" + dialogue.SECTION_MARK + ").*", ""))
        return clean_text(own) if version == 2 else strip(F.regexp_replace(own, r"(?U)\s+", " "))

    def build(p: Column) -> Column:
        turns = F.transform(p["r"], lambda r, i: F.struct(
            normalize_role(r, version).alias("role"),
            message(F.get(p["g"], i + 1)).alias("content")))
        kept = F.filter(turns, lambda x: F.length(x["content"]) > 2)
        return F.filter(kept, lambda x: x["role"].isin("user", "assistant")) \
            if version == 2 else kept

    return let(parts, build)
