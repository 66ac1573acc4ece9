"""Keyword, entity and word-context expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from careline.functions.core import (
    alternation, apply_sql, col, let, literal, mapping, nz, part, rx, strings, structs, total,
)
from careline.functions.scan import Term, scan
from careline.functions.spans import SPAN, counts_before, pattern_spans
from careline.rules import medical

PRIORITY = {"pattern": 3, "dictionary": 2, "llm": 1}


# ---- keywords ---------------------------------------------------------------------

def any_keyword(text: Column, terms: Sequence[str]) -> Column:
    """True if any term is part of the text."""
    return nz(text).rlike(alternation(terms))


def found_terms(text: Column, terms: Sequence[str]) -> Column:
    """The distinct terms that are part of the text, in one pass over it.

    At each place the longest term that starts there is read; terms that are a beginning
    of it start there too and are added by look-up.
    """
    longest = sorted(set(terms), key=lambda t: (-len(t), t))
    seen = F.array_distinct(F.regexp_extract_all(
        nz(text), F.lit("(?=(" + alternation(longest) + "))"), F.lit(1)))
    heads = {t: [p for p in longest if t.startswith(p)] for t in longest}
    nested = {t: ps for t, ps in heads.items() if len(ps) > 1}
    if not nested:
        return seen
    table = mapping(nested.items())
    return F.array_distinct(F.flatten(F.transform(
        seen, lambda t: F.coalesce(table[t], F.array(t)))))


def keyword_hits(text: Column, terms: Sequence[str]) -> Column:
    """The distinct terms that are part of the text, in list order."""
    return F.array_intersect(strings(terms), found_terms(text, terms))


def keyword_count(text: Column, terms: Sequence[str]) -> Column:
    """Number of list entries that are part of the text; an entry listed twice counts
    twice."""
    twice = [t for i, t in enumerate(terms) if t in terms[:i]]
    distinct = F.size(found_terms(text, terms))
    return total([distinct, *[F.contains(nz(text), F.lit(t)).cast("int") for t in twice]])


def clinical_terms(text: Column) -> Column:
    return keyword_hits(text, medical.CLINICAL_TERMS)


def clinical_terms_scanned(text: Column | str) -> Column:
    """:func:`clinical_terms` by scan(); it cannot stand inside a lambda."""
    seen = scan(text, seen=[Term((t,)) for t in medical.CLINICAL_TERMS])["seen"]
    return F.transform(seen, lambda i: F.get(strings(medical.CLINICAL_TERMS), i))


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    return nz(text).rlike(rx("|".join(f"(?:{p})" for p in patterns)))


def is_health_related(
    text: Column | str, label: Column | str,
    terms: Sequence[str] = medical.HEALTH_KEYWORDS,
    labels: Sequence[str] = medical.HEALTH_LABELS,
) -> Column:
    """Term inside the entity, entity inside a term, or a label that counts by itself."""
    in_terms = let(F.lower(nz(text)), lambda t: F.exists(
        strings(terms), lambda k: F.contains(t, k) | F.contains(k, t)))
    return in_terms | col(label).isin(list(labels))


# ---- entities ---------------------------------------------------------------------

def _entity(text, lemma, category, tag, start, confidence: float, source: str) -> Column:
    return F.struct(
        text.alias("text"), lemma.alias("lemma"), category.alias("category"),
        tag.alias("pos_tag"), start.cast("int").alias("start"),
        (start + F.length(text)).cast("int").alias("end"),
        F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))


def _table(rows: Sequence[tuple[str, str, str]]) -> Column:
    return structs(["term", "category", "description"], rows)


def noun_matches(text: Column | str, nouns=medical.NOUNS) -> Column:
    """First occurrence of every noun that is part of the text (no tagger needed)."""
    def build(t: Column) -> Column:
        return let(found_terms(t, [n for n, _, _ in nouns]), lambda found: F.transform(
            F.filter(_table(nouns), lambda r: F.array_contains(found, r["term"])),
            lambda r: _entity(r["term"], r["term"], r["category"], F.lit("NNG"),
                              F.position(r["term"], t) - 1, 0.8, "fallback")))

    return let(F.lower(nz(text)), build)


def compound_matches(text: Column | str, patterns=medical.COMPOUNDS) -> Column:
    """First match of every compound pattern. Each pattern is a literal, so it is
    compiled once per task and not per row."""
    def one(p: str, category: str, lemma: str) -> str:
        p, start = literal(rx(p)), f"length(split(x_, {literal(rx(p))}, 2)[0])"
        found = f"regexp_extract(x_, {p}, 0)"
        return (
            f"if(x_ rlike {p}, named_struct('text', {found}, 'lemma', {literal(lemma)}, 'category', "
            f"{literal(category)}, 'pos_tag', 'COMPOUND', 'start', {start}, 'end', {start} + "
            f"length({found}), 'confidence', 0.95D, 'source', 'pattern'), null)")

    body = "array_compact(array(" + ", ".join(one(*r) for r in patterns) + "))"
    return apply_sql(nz(text), "x_", body)


def tagged_matches(text: Column | str, morphemes: Column | str) -> Column:
    """Dictionary look-up of tagged morphemes (array of morph and tag).

    Nouns keep their own form as lemma, verbs take the description. The position is
    the first occurrence in the text, or 0 where the stem is not written out.
    """
    return let(F.struct(nz(text).alias("t"), col(morphemes).alias("m")),
               lambda b: _tagged(b["t"], b["m"]))


def _tagged(t: Column, ms: Column) -> Column:
    def table(rows):
        """A literal, so that it is made once and not for every morpheme."""
        return F.expr("map(" + ", ".join(
            f"{literal(t)}, named_struct('category', {literal(c)}, 'description', {literal(d)})" for t, c, d in rows) + ")")

    def known(m: Column, rows) -> Column:
        """A set look-up; a map is searched from its start."""
        return m["morph"].isin([t for t, _, _ in rows])

    stopped = sorted(set(medical.MORPH_STOP_WORDS) - set(medical.MORPH_STOP_EXEMPT))
    nouns, verbs = table(medical.NOUNS), table(medical.VERBS)

    def at(m: Column) -> Column:
        return F.greatest(F.position(m["morph"], t) - 1, F.lit(0))

    noun = F.transform(
        F.filter(ms, lambda m: F.startswith(m["tag"], F.lit(medical.NOUN_TAG_PREFIX))
                 & known(m, medical.NOUNS)),
        lambda m: _entity(m["morph"], m["morph"], nouns[m["morph"]]["category"], m["tag"],
                          at(m), 1.0, "dictionary"))
    verb = F.transform(
        F.filter(ms, lambda m: m["tag"].isin(medical.VERB_TAGS)
                 & known(m, medical.VERBS) & ~m["morph"].isin(stopped)),
        lambda m: _entity(m["morph"], verbs[m["morph"]]["description"],
                          verbs[m["morph"]]["category"], m["tag"], at(m), 0.9, "dictionary"))
    return F.concat(noun, verb)


def dedup_entities(entities: Column) -> Column:
    """One entity per lemma and no overlap, the more specific source first.

    From the left; among equal starts the source with the higher priority comes first,
    then the given order. An overlapping entity only replaces the last kept one if its
    source ranks higher.
    """

    def priority(e: Column) -> Column:
        return F.when(e["source"] == "pattern", 3).when(e["source"] == "dictionary", 2).when(
            e["source"] == "llm", 1).otherwise(0)

    keyed = F.transform(entities, lambda e, i: F.struct(
        e["start"].alias("a"), (-priority(e)).alias("b"), i.alias("c"), e.alias("e")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["e"])

    def step(kept: Column, e: Column) -> Column:
        last = F.element_at(kept, -1)
        return (
            F.when(F.exists(kept, lambda k: k["lemma"] == e["lemma"]), kept)
            .when((F.size(kept) > 0) & (e["start"] < last["end"]),
                  F.when(priority(e) > priority(last),
                         F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(e)))
                  .otherwise(kept))
            .otherwise(F.concat(kept, F.array(e)))
        )

    return let(ordered, lambda es: F.aggregate(es, F.filter(es, lambda _: F.lit(False)), step))


def medical_entities(text: Column | str, morphemes: Column | str | None = None) -> Column:
    """Entities of a text; without tagged morphemes the noun look-up takes their place."""
    found = noun_matches(text) if morphemes is None else tagged_matches(text, morphemes)
    return dedup_entities(F.concat(found, compound_matches(text)))


def symptom_scan(text: Column | str) -> Column:
    """Symptom flags, alert level, advice and attention flag."""
    def found(t: Column) -> Column:
        return F.struct(
            F.array_compact(F.array(*[
                F.when(any_keyword(t, kws), F.lit(flag)) for flag, kws in medical.SYMPTOM_FLAGS]))
            .alias("f"),
            any_keyword(t, medical.ALERT_WORDS).alias("a"))

    return let(let(F.lower(nz(text)), found), lambda s: F.struct(
        s["f"].alias("symptoms"),
        F.when(s["a"], "critical").otherwise("normal").alias("alert_level"),
        F.array_compact(F.array(
            F.when(s["a"], medical.ALERT_ADVICE),
            *[F.when(F.array_contains(s["f"], flag), advice)
              for flag, advice in medical.SYMPTOM_ADVICE])).alias("recommendations"),
        ((F.size(s["f"]) > 2) | s["a"]).alias("needs_attention")))


def colloquial_terms(text: Column | str, rules=medical.COLLOQUIAL) -> Column:
    """Medical terms for colloquial wording, in rule order."""
    hits = ", ".join(f"if(x_ rlike {literal(rx(p))}, {literal(term)}, null)" for p, term in rules)
    return apply_sql(nz(text), "x_", f"array_distinct(array_compact(array({hits})))")


# ---- word context -----------------------------------------------------------------

def tokens(text: Column | str, pattern: str = medical.TOKEN_PATTERN) -> Column:
    return pattern_spans(text, pattern)


def word_context(
    text_tokens: Column, span: Column, before: Column, after: Column, n_before: int = 5,
    n_after: int = 5, min_words: int = 2, stop_words: Sequence[str] = medical.CONTEXT_STOP_WORDS,
) -> Column:
    """Words before and after a span; stop words go unless too few words would stay.

    ``before`` tokens end before the span, and ``after`` start before its end.
    """

    def thin(ws: Column) -> Column:
        return let(ws, lambda w: let(
            F.filter(w, lambda x: ~x.isin(list(stop_words))),
            lambda kept: F.when(F.size(kept) < min_words, w).otherwise(kept)))

    first = part(text_tokens, F.greatest(before - n_before, F.lit(0)), F.least(before, F.lit(n_before)))
    later = part(text_tokens, after, F.least(F.size(text_tokens) - after, F.lit(n_after)))
    words = F.struct(
        thin(F.transform(first, lambda k: k["text"])).alias("before"),
        thin(F.transform(later, lambda k: k["text"])).alias("after"))
    return let(words, lambda w: F.struct(
        span["text"].alias("target"), span["start"].alias("start"), span["end"].alias("end"),
        w["before"].alias("before_words"), w["after"].alias("after_words"),
        F.trim(F.concat(F.array_join(w["before"], " "), F.lit(" "), span["text"], F.lit(" "),
                        F.array_join(w["after"], " "))).alias("full_context")))


def word_contexts(text: Column | str, spans: Column, **options) -> Column:
    """Context of every span of a text; a text with spans is tokenized once, and the place of each span
    among the tokens is found by halving."""
    def placed(b: Column) -> Column:
        before = counts_before(F.transform(b["k"], lambda k: k["end"]), F.transform(b["s"], lambda s: s["start"]), True)
        after = counts_before(F.transform(b["k"], lambda k: k["start"]), F.transform(b["s"], lambda s: s["end"]), False)
        return let(F.struct(b["k"].alias("k"), b["s"].alias("s"), before.alias("b"), after.alias("a")),
                   lambda x: F.transform(x["s"], lambda s, i: word_context(
                       x["k"], s, F.get(x["b"], i), F.get(x["a"], i), **options)))

    def found(s: Column) -> Column:
        """A text without spans has no use for its tokens."""
        return F.struct(F.when(F.size(s) > 0, tokens(text)).otherwise(F.array().cast(SPAN)).alias("k"), s.alias("s"))

    return let(let(spans, found), placed)


def combined_context(text: Column | str, contexts: Column) -> Column:
    """Distinct words of all contexts by first position in the text, then by word."""
    words = F.array_distinct(F.flatten(F.transform(
        contexts,
        lambda c: F.concat(c["before_words"], F.array(c["target"]), c["after_words"]))))
    placed = let(nz(text), lambda t: F.transform(words, lambda w: F.struct(
        F.greatest(F.position(w, t) - 1, F.lit(0)).alias("p"), w.alias("w"))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def embedding_context(text: Column | str, contexts: Column) -> Column:
    """Distinct contexts in order, or the text itself where there is none."""
    joined = F.array_join(F.array_distinct(F.filter(
        F.transform(contexts, lambda c: c["full_context"]), lambda c: c != "")), " ")
    return F.when(nz(joined) == "", nz(text)).otherwise(joined)
