"""The turn pipeline: context, entities, risk, intent, route, flags and log rows.

Every stage is a projection except the context frame, so a table of turns costs one
exchange; the stream uses the same projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.functions import classify as C
from careline.functions import lexicon as L
from careline.functions import text as T
from careline.functions.core import let, nz, rank_of, strings
from careline.operators.turns import turn_context
from careline.rules import intents as I
from careline.rules import risk


def lemmas(entities: Column) -> Column:
    return F.array_distinct(F.transform(entities, lambda e: e["lemma"]))


def with_analysis(df: DataFrame, text: str = "text", morphemes: str | None = None) -> DataFrame:
    """Adds ``report`` (risk report) for texts behind the gate, a default one otherwise."""
    def full(t: Column) -> Column:
        return let(lemmas(L.medical_entities(t, morphemes)), lambda terms: C.risk_report(t, terms))

    return df.withColumn("report", F.when(
        C.analysis_gate(text), full(F.col(text))).otherwise(C.default_report(text)))


def with_intent(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds intent, confidence, route and emergency words; needs topic and turn count."""
    classed = df.withColumn("_c", C.classify_intent(text, F.col("recent_topic"),
                                                    F.col("turn_count")))
    return classed.select(
        *df.columns, F.col("_c.intent").alias("intent"),
        F.col("_c.confidence").alias("intent_confidence"),
        C.route("_c.intent").alias("route"),
        C.emergency_hits(text).alias("emergency_keywords"))


def with_guidance(df: DataFrame, text: str = "text") -> DataFrame:
    """Flags that steer the answer; ``may_refer`` is before the once-per-session rule."""
    health = F.col("intent").isin(I.GUIDED_INTENTS)
    rank = rank_of(F.col("report.overall_risk"), risk.LEVELS)
    calm = F.col("intent") != I.EMERGENCY
    return df.select(
        "*",
        ((F.col("turn_count") >= I.REFERRAL_TURN) & health & (rank >= 1)).alias("may_refer"),
        (F.col("repeated_question") & health).alias("note_repeated"),
        (F.col("topic_drifted") & health).alias("note_drift"),
        F.when(F.col("topic_drifted") & health, F.coalesce(
            F.element_at(F.col("previous_topics"), -1), F.lit("이전 주제"))).alias("drift_topic"),
        (rank >= 2).alias("note_high_risk"),
        F.when(rank >= 2, F.array_join(
            F.slice("report.detected_health_terms", 1, 5), ", ")).alias("risk_terms"),
        calm.alias("expert_guidance"),
        (calm & C.emotional_risk(text)).alias("note_emotional"))


def first_in_session(df: DataFrame, flag: str, session: str = "conv_id", turn: str = "turn",
                     name: str = "referral") -> DataFrame:
    """Keep a flag only at its first row of the session. The first rows are an aggregate,
    so a long session is not ordered in one task."""
    first = df.filter(F.col(flag)).groupBy(session).agg(F.min(turn).alias("_first"))
    return df.join(first, session, "left").withColumn(
        name, F.coalesce(F.col(flag) & (F.col(turn) == F.col("_first")), F.lit(False))
    ).drop("_first")


def analyse_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text", **options) -> DataFrame:
    """User turns with everything the service derives from them before it answers."""
    context = turn_context(turns, key, turn, role, text, **options)
    users = context.filter(F.col(role) == "user")
    return with_guidance(with_intent(with_analysis(users, text), text), text)


def emergency_alerts(analysed: DataFrame, profiles: DataFrame | None = None,
                     key: str = "conv_id", text: str = "text") -> DataFrame:
    """Alert rows of emergency turns with the contact of the profile."""
    rows = analysed.filter(F.col("route") == "emergency")
    if profiles is None:
        rows = rows.withColumn("emergency_contact", F.lit(""))
    else:
        rows = rows.join(profiles.select(key, "emergency_contact"), key, "left")
    return rows.select(
        key, *[c for c in ("turn",) if c in analysed.columns], F.lit("critical").alias("level"),
        F.col(text).alias("message"), F.col("emergency_keywords").alias("keywords"),
        nz("emergency_contact").alias("emergency_contact"),
        F.lit(True).alias("action_required"))


def log_rows(analysed: DataFrame, created_at: Column, response: Column | None = None,
             key: str = "conv_id", text: str = "text") -> DataFrame:
    """Rows of the analytic log, partitionable by local day."""
    return analysed.select(
        F.col(key).cast("string").alias("nickname"), F.col(text).alias("user_message"),
        (F.lit("") if response is None else response).alias("ai_message"), "intent",
        F.col("intent_confidence").cast("float").alias("intent_confidence"),
        F.col("report.overall_risk").alias("risk_level"),
        F.col("report.detected_health_terms").alias("detected_symptoms"),
        F.transform("report.risk_categories", lambda c: c["category"]).alias("risk_categories"),
        "repeated_question", "topic_drifted", created_at.alias("created_at"),
        F.to_date(T.kst(created_at)).alias("day"))


def assemble_context(analysed: DataFrame, profile_fields: dict[str, Column], known: Column,
                     docs: Column | None = None) -> Column:
    """Profile, history and documents of a turn as one context text."""
    none = strings([])
    return F.concat_ws(
        "\n\n", T.profile_text(profile_fields, known), T.history_text(F.col("history")),
        T.docs_text(none if docs is None else docs))
