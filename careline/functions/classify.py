"""Intent, risk and guidance expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from careline.functions.core import (
    col, let, mapping, nz, rank_of, rx, strings, strip, structs, total,
)
from careline.functions.lexicon import (
    any_keyword, any_pattern, found_terms, keyword_count, keyword_hits,
)
from careline.functions.scan import Term
from careline.rules import intents as I
from careline.rules import medical, risk


@dataclass(frozen=True)
class IntentPack:
    """Word and pattern lists of the intent cascade; the default is the Korean pack."""

    leak: Sequence[str] = field(default_factory=lambda: I.LEAK_WORDS)
    emergency: Sequence[str] = field(default_factory=lambda: I.EMERGENCY_WORDS)
    end: Sequence[str] = field(default_factory=lambda: I.END_PATTERNS)
    general: Sequence[str] = field(default_factory=lambda: I.GENERAL_PATTERNS)
    followup: Sequence[str] = field(default_factory=lambda: I.FOLLOWUP_PATTERNS)
    health: Sequence[str] = field(default_factory=lambda: I.HEALTH_WORDS)
    medication: Sequence[str] = field(default_factory=lambda: I.MEDICATION_WORDS)
    lifestyle: Sequence[str] = field(default_factory=lambda: I.LIFESTYLE_WORDS)


def classify_intent(
    message: Column | str, recent_topic: Column, turn_count: Column,
    pack: IntentPack | None = None,
) -> Column:
    """(intent, confidence) by the first rule that holds."""
    pack, conf = pack or IntentPack(), I.CONFIDENCE
    bound = F.struct(
        strip(nz(message)).alias("m"), F.lower(strip(nz(message))).alias("l"),
        (turn_count > 0).alias("any"), ((turn_count > 0) & (nz(recent_topic) != "")).alias("ctx"))

    def result(intent: str, key: str) -> Column:
        return F.struct(F.lit(intent).alias("intent"), F.lit(conf[key]).alias("confidence"))

    def cascade(b: Column) -> Column:
        m, low = b["m"], b["l"]
        short = F.length(m) <= I.SHORT_CHARS
        health = keyword_count(low, pack.health)
        life = keyword_count(low, pack.lifestyle)
        return (
            F.when(any_keyword(low, pack.leak), result(I.BLOCKED, "leak"))
            .when(any_keyword(low, pack.emergency), result(I.EMERGENCY, "emergency"))
            .when(any_pattern(m, pack.end), result(I.END, "end"))
            .when(any_pattern(m, pack.general), result(I.GENERAL, "general"))
            .when(b["ctx"] & any_pattern(m, pack.followup), result(I.FOLLOWUP, "followup"))
            .when(b["ctx"] & short, result(I.FOLLOWUP, "followup_short"))
            .when(any_keyword(low, pack.health),
                  F.when(health >= 2, result(I.HEALTH, "health_many"))
                  .otherwise(result(I.HEALTH, "health_one")))
            .when(any_keyword(low, pack.medication), result(I.MEDICATION, "medication"))
            .when(any_keyword(low, pack.lifestyle),
                  F.when(life >= 2, result(I.LIFESTYLE, "lifestyle_many"))
                  .otherwise(result(I.LIFESTYLE, "lifestyle_one")))
            .when(short & b["any"], result(I.FOLLOWUP, "short"))
            .otherwise(result(I.GENERAL, "default"))
        )

    return let(bound, cascade)


def emergency_hits(message: Column | str, terms: Sequence[str] | None = None) -> Column:
    return keyword_hits(nz(message), terms or I.EMERGENCY_WORDS)


def emotional_risk(message: Column | str) -> Column:
    return any_keyword(nz(message), I.EMOTIONAL_RISK_WORDS)


def route(intent: Column | str) -> Column:
    c = col(intent)
    return (
        F.when(c == I.BLOCKED, "blocked").when(c == I.END, "end_conversation")
        .when(c == I.EMERGENCY, "emergency").when(c == I.GENERAL, "general")
        .otherwise("needs_retrieval")
    )


# ---- risk -------------------------------------------------------------------------

def level_shift(text: Column | str, raising=None, lowering=None) -> Column:
    """Whether the wording raises and whether it lowers a level."""
    t = nz(text)
    ups = total([t.rlike(rx(p)).cast("int") for p in raising or risk.RAISING])
    return F.struct((ups >= 2).alias("up"),
                    any_pattern(t, lowering or risk.LOWERING).alias("down"))


def adjust_level(base: Column, shift: Column) -> Column:
    """Rank of a base level after the shift; the highest level can only fall."""
    return (
        F.when(shift["up"] & (base < len(risk.LEVELS) - 1), base + 1)
        .when(shift["down"] & (base > 0), base - 1).otherwise(base)
    )


#: Keywords of the default categories, then raising and lowering patterns, for scan().
RISK_WORDS = sorted({k for c in risk.CATEGORIES for k in c["keywords"]})
RISK_SEEN = [*[Term((k,)) for k in RISK_WORDS], *risk.RAISING, *risk.LOWERING]


def risk_signals(
    text: Column | str, terms: Column | None = None, categories=None,
    raising=None, lowering=None, seen: Column | None = None,
) -> Column:
    """One signal per category with a keyword in the text or among the terms.

    ``terms`` are found health terms (lemmas); one counts if it holds a keyword or is
    part of one. ``seen`` (numbers of ``RISK_SEEN`` found in the text by scan()) saves the passes
    over the text, for the default tables.
    """
    categories = categories or risk.CATEGORIES
    terms = strings([]) if terms is None else terms

    every = [k for c in categories for k in c["keywords"]]

    def bound(t: Column) -> Column:
        if seen is None:
            found, shift = found_terms(F.lower(t), every), level_shift(t, raising, lowering)
        else:
            up, down = len(RISK_WORDS), len(RISK_WORDS) + len(risk.RAISING)
            found = F.transform(F.filter(seen, lambda i: i < up), lambda i: F.get(strings(RISK_WORDS), i))
            shift = F.struct((F.size(F.filter(seen, lambda i: (i >= up) & (i < down))) >= 2).alias("up"),
                             F.exists(seen, lambda i: i >= down).alias("down"))
        return F.struct(t.alias("text"), found.alias("found"), terms.alias("terms"), shift.alias("shift"))

    table = structs(
        ["category", "base", "keywords", "description", "recommendation"],
        [(c["category"], str(risk.LEVELS.index(c["level"])), c["keywords"], c["description"],
          c["recommendation"]) for c in categories])

    def one(b: Column, c: Column) -> Column:
        indirect = F.filter(b["terms"], lambda x: F.exists(
            c["keywords"], lambda k: F.contains(F.lower(x), k) | F.contains(k, F.lower(x))))
        hits = F.array_distinct(F.concat(F.array_intersect(c["keywords"], b["found"]), indirect))
        bound = F.struct(hits.alias("h"), adjust_level(c["base"].cast("int"), b["shift"]).alias("r"))
        return let(bound, lambda x: F.when(F.size(x["h"]) > 0, F.struct(
            c["category"].alias("category"),
            F.get(strings(risk.LEVELS), x["r"]).alias("level"), x["r"].alias("rank"),
            x["h"].alias("trigger_terms"),
            F.substring(b["text"], 1, risk.CONTEXT_CHARS).alias("context"),
            c["description"].alias("description"), c["recommendation"].alias("recommendation"))))

    return let(let(nz(text), bound), lambda b: F.array_compact(
        F.transform(table, lambda c: one(b, c))))


def overall_risk(signals: Column) -> Column:
    top = F.array_max(F.transform(signals, lambda s: s["rank"]))
    return F.get(strings(risk.LEVELS), F.coalesce(top, F.lit(0)))


def _display(signals: Column, key: str) -> Column:
    table = mapping((c["category"], c[key]) for c in risk.CATEGORIES)
    return F.transform(signals, lambda s: F.coalesce(table[s["category"]], s["category"]))


def risk_summary(signals: Column, overall: Column) -> Column:
    """Summary text; area names are sorted so that the text is repeatable."""
    level = F.get(strings(risk.LEVEL_NAMES), rank_of(overall, risk.LEVELS))
    areas = F.array_join(F.array_sort(F.array_distinct(_display(signals, "display"))), ", ")
    return F.when(F.size(signals) == 0, risk.SUMMARY_NONE).otherwise(F.concat(
        F.lit(risk.SUMMARY_LEVEL), level, F.lit("\n" + risk.SUMMARY_AREAS), areas, F.lit("\n"),
        F.when(overall == "critical", risk.SUMMARY_CRITICAL).otherwise("")))


def enhance_query(text: Column | str, terms: Column, signals: Column) -> Column:
    parts = F.concat(
        F.array(nz(text)),
        F.when(F.size(terms) > 0,
               F.array(F.array_join(F.slice(terms, 1, risk.QUERY_TERMS), " ")))
        .otherwise(strings([])),
        F.slice(_display(signals, "expansion"), 1, risk.QUERY_SIGNALS))
    return F.array_join(parts, " ")


def risk_report(text: Column | str, terms: Column) -> Column:
    """Overall level, terms, categories, summary and expanded query in one struct."""
    def build(b: Column) -> Column:
        s = b["s"]
        return let(overall_risk(s), lambda o: F.struct(
            o.alias("overall_risk"),
            F.slice(b["t"], 1, risk.REPORT_TERMS).alias("detected_health_terms"),
            F.transform(s, lambda x: F.struct(x["category"], x["level"], x["description"]))
            .alias("risk_categories"),
            risk_summary(s, o).alias("summary"),
            enhance_query(b["x"], b["t"], s).alias("enhanced_query")))

    return let(let(F.struct(nz(text).alias("x"), terms.alias("t")), lambda b: F.struct(
        b["x"].alias("x"), b["t"].alias("t"), risk_signals(b["x"], b["t"]).alias("s"))), build)


def default_report(text: Column | str) -> Column:
    """Report of a text that the gate keeps out of the full analysis."""
    empty = F.array().cast("array<struct<category:string,level:string,description:string>>")
    return F.struct(
        F.lit("low").alias("overall_risk"), strings([]).alias("detected_health_terms"),
        empty.alias("risk_categories"), F.lit("").alias("summary"),
        nz(text).alias("enhanced_query"))


def analysis_gate(text: Column | str) -> Column:
    return any_keyword(nz(col(text)), medical.GATE_WORDS)
