"""Turn-sequence operators.

Input is one row per message with a conversation key, an order inside it (``turn``, any
integers, with or without gaps), a role and a text. No operator gathers a conversation in one task unless
its output row is that conversation: neighbours come from segmented frames, everything
else from keyed aggregates over bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careline.functions import segments as S
from careline.functions import text as T
from careline.functions.classify import analysis_gate
from careline.functions.core import let, nz
from careline.functions.lexicon import keyword_count
from careline.functions.pii import pseudonym
from careline.rules import dialogue, medical

HISTORY = 6
MESSAGES = "array<struct<role:string,content:string>>"


def number_turns(df: DataFrame, key: str = "conv_id", order: str = "turn", name: str = "pos",
                 size: int = S.SEGMENT_ROWS, ties: Sequence[str] = (), whole: bool | None = None) -> DataFrame:
    """Dense position of each row of a conversation along an integer order column; rows that share a number of it
    follow each other by ``ties``."""
    return S.dense_position(df, [key], [order, *ties], S.segment(order, size), name, whole)


def _framed(df: DataFrame, key: str, turn: str, role: str, text: str, size: int,
            exprs: dict, before: int = 0, after: int = 0) -> DataFrame:
    """Window columns along the turns of a conversation; turns that share a number go by role and text."""
    if S.one_segment(df, S.segment(turn, size)):
        return S.over_frame(df, [key], [turn, role, text], exprs, whole=True)
    numbered = number_turns(df, key, turn, "_pos", size, [role, text], False)
    return S.over_frame(numbered, [key], "_pos", exprs, before, after, size).drop("_pos")


# ---- conversations to clean dialogues ----------------------------------------------

def merge_same_role(df: DataFrame, key: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text", min_chars: int = 3,
                    size: int = S.SEGMENT_ROWS) -> DataFrame:
    """Drop short messages, then join neighbouring messages of one role.

    Result: key, turn (position of the merged message), role, text, n_messages.
    """
    whole = S.one_segment(df, S.segment(turn, size))
    kept = df.filter(F.length(nz(text)) >= min_chars).select(key, turn, role, text)
    numbered = number_turns(kept, key, turn, "pos", size, [role, text], whole)
    along = [turn, role, text] if whole else ["pos"]  # the same order, so that one sort serves all
    marked = S.over_frame(
        numbered, [key], along if whole else "pos",
        {"first": lambda w: ~F.coalesce(F.lag(role).over(w).eqNullSafe(F.col(role)), F.lit(False))
                            | (F.col("pos") == 0)},
        before=1, size=size, whole=whole)
    runs = S.running(marked, [key], along,
                     {"run": ("sum", F.col("first").cast("int"))}, S.segment("pos", size), whole)
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", text))), lambda m: m[text]), " ")
    return runs.groupBy(key, "run").agg(
        F.first(role).alias(role), joined.alias(text), F.count("*").alias("n_messages"),
    ).select(key, (F.col("run") - 1).alias(turn), role, text, "n_messages")


def trim_leading_non_user(df: DataFrame, key: str = "conv_id", turn: str = "turn",
                          role: str = "role") -> DataFrame:
    """Drop the rows of a conversation before its first user message."""
    starts = df.filter(F.col(role) == "user").groupBy(key).agg(F.min(turn).alias("_start"))
    return df.join(starts, key).filter(F.col(turn) >= F.col("_start")).drop("_start")


def conversation_stats(df: DataFrame, key: str = "conv_id", role: str = "role") -> DataFrame:
    return df.groupBy(key).agg(
        F.count("*").alias("n_turns"),
        F.count_if(F.col(role) == "user").alias("n_user"),
        F.count_if(F.col(role) == "assistant").alias("n_assistant"),
        F.count_if(F.col(role) == "system").alias("n_system"))


def valid_conversation(df: DataFrame, key: str = "conv_id", role: str = "role",
                       min_turns: int = 2) -> DataFrame:
    """Conversations with enough turns and with both sides."""
    stats = conversation_stats(df, key, role)
    return stats.filter((F.col("n_turns") >= min_turns) & (F.col("n_user") > 0)
                        & (F.col("n_assistant") > 0))


def clean_dialogues(df: DataFrame, key: str = "conv_id", turn: str = "turn",
                    role: str = "role", text: str = "text",
                    size: int = S.SEGMENT_ROWS) -> DataFrame:
    """Merged, user-first dialogues with both sides, positions counted from 0."""
    sides = df.filter(F.col(role).isin("user", "assistant"))
    merged = merge_same_role(sides, key, turn, role, text, size=size)
    bounds = merged.groupBy(key).agg(
        F.min(F.when(F.col(role) == "user", F.col(turn))).alias("_start"),
        F.max(F.when(F.col(role) == "assistant", F.col(turn))).alias("_last"))
    usable = bounds.filter("_start < _last")
    return merged.join(usable, key).filter(F.col(turn) >= F.col("_start")).select(
        key, (F.col(turn) - F.col("_start")).alias(turn), role, text)


# ---- pairs and windows -------------------------------------------------------------

def user_assistant_pairs(df: DataFrame, key: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text",
                         size: int = S.SEGMENT_ROWS) -> DataFrame:
    """Each user message with the assistant message right after it."""
    ahead = _framed(df.select(key, turn, role, text), key, turn, role, text, size, {
        "next_role": lambda w: F.lead(role).over(w),
        "assistant_text": lambda w: F.lead(text).over(w)}, after=1)
    return ahead.filter((F.col(role) == "user") & (F.col("next_role") == "assistant")).select(
        key, turn, F.col(text).alias("user_text"), "assistant_text")


def pair_by_even_index(df: DataFrame, key: str = "conv_id", turn: str = "turn",
                       role: str = "role", text: str = "text") -> DataFrame:
    """Pairs at positions (0, 1), (2, 3) … only; each pair is its own group."""
    return (
        df.groupBy(key, F.floor(F.col(turn) / 2).cast("long").alias("pair")).agg(
            F.max(F.when((F.pmod(F.col(turn), F.lit(2)) == 0) & (F.col(role) == "user"),
                         F.col(text))).alias("user_text"),
            F.max(F.when((F.pmod(F.col(turn), F.lit(2)) == 1) & (F.col(role) == "assistant"),
                         F.col(text))).alias("assistant_text"))
        .filter("user_text is not null and assistant_text is not null")
    )


def number_pairs(pairs: DataFrame, key: str = "conv_id", order: str = "pair",
                 size: int = S.SEGMENT_ROWS) -> DataFrame:
    """Pairs numbered densely as ``p``, with the number of pairs ``n`` of the key."""
    numbered = number_turns(pairs, key, order, "p", size)
    counts = pairs.groupBy(key).agg(F.count("*").alias("n"))
    return numbered.join(counts, key)


def sliding_pairs(numbered: DataFrame, width: int) -> DataFrame:
    """Every window of ``width`` pairs; a conversation with fewer is kept whole.

    Each pair is copied to the windows it belongs to, so a window is a bounded group
    whatever the length of the conversation. Adds ``start`` (window) and ``i`` (place).
    """
    p, n = F.col("p"), F.col("n")
    starts = F.sequence(F.greatest(p - (width - 1), F.lit(0)),
                        F.least(p, F.greatest(n - width, F.lit(0))))
    return numbered.withColumn("start", F.explode(starts)).withColumn("i", p - F.col("start"))


def augment_windows(numbered: DataFrame, width: int = 4) -> DataFrame:
    """The whole conversation (``start`` -1) and, from three pairs on, windows from every
    later pair that still hold two pairs."""
    p, n = F.col("p"), F.col("n")
    first = F.greatest(p - (width - 1), F.lit(1))
    last = F.least(p, n - 2)
    starts = F.when((n >= 3) & (first <= last), F.sequence(first, last)).otherwise(
        F.array().cast("array<bigint>"))
    return numbered.withColumn(
        "start", F.explode(F.concat(F.array(F.lit(-1).cast("bigint")), starts)),
    ).withColumn("i", F.when(F.col("start") < 0, p).otherwise(p - F.col("start")))


def overlap_chunks(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                   max_turns: int = 6) -> DataFrame:
    """Chunks of ``max_turns`` turns that overlap by two; only chunks that a user opens.

    Conversations within the bound stay whole (chunk start 0).
    """
    step, pos, n = max_turns - 2, F.col(turn), F.col("_n")
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    first = F.greatest(F.ceil((pos - (max_turns - 1)) / step), F.lit(0)).cast("bigint")
    starts = F.when(n <= max_turns, F.array(F.lit(0).cast("bigint"))).otherwise(F.transform(
        F.sequence(first, F.floor(pos / step).cast("bigint")), lambda k: k * step))
    spread = df.join(counts, key).withColumn("start", F.explode(starts))
    opened = F.max(F.when((pos == F.col("start")) & (F.col(role) == "user"), True))
    openers = spread.filter(pos == F.col("start")).groupBy(key, "start").agg(
        opened.alias("_open"), F.first("_n").alias("_len"))
    kept = openers.filter(F.coalesce("_open", F.lit(False)) | (F.col("_len") <= max_turns))
    return spread.drop("_n").join(kept.select(key, "start"), [key, "start"]).withColumn(
        "i", pos - F.col("start"))


def combine_singles(singles: DataFrame, topic: str = "topic", ident: str = "conv_id",
                    per_group: int = 3, seed: str = "42") -> DataFrame:
    """Pack single-pair conversations of one topic, ``per_group`` at a time.

    The order inside a topic is that of a seeded digest, so the packing is repeatable;
    a popular topic is numbered in digest ranges and never held by one task. A group
    left with a single conversation is dropped. Adds ``grp`` and ``i``.
    """
    head = F.get(F.split(F.get(F.split(nz(topic), "_"), F.lit(0)), " "), F.lit(0))
    keyed = singles.withColumn("topic_key", head).withColumn(
        "_h", F.md5(F.concat(F.col(ident).cast("string"), F.lit(seed))))
    ranked = S.dense_position(keyed, ["topic_key"], ["_h", ident], S.hash_segment("_h"), "_rn")
    grouped = ranked.withColumn("grp", F.floor(F.col("_rn") / per_group).cast("long")).withColumn(
        "i", F.pmod(F.col("_rn"), F.lit(per_group)))
    sizes = grouped.groupBy("topic_key", "grp").agg(F.count("*").alias("_n")).filter("_n >= 2")
    return grouped.join(sizes.select("topic_key", "grp"), ["topic_key", "grp"]).drop("_h", "_rn")


# ---- training samples --------------------------------------------------------------

def chat_sample(df: DataFrame, keys: Sequence[str], order: str, role: str = "role",
                text: str = "text", system: Column | str = dialogue.SYSTEM_PROMPT,
                min_chars: int = 3, version: int | None = 2) -> DataFrame:
    """One row per sample: the system message and then the cleaned messages in order.

    A sample is one output row, so its group is bounded by the sample itself; feed
    windows (:func:`sliding_pairs`) rather than whole conversations when these are long.
    """
    content = F.col(text) if version is None else T.clean_text(text, version)
    system_col = F.lit(system) if isinstance(system, str) else system
    kept = df.withColumn("_content", content).filter(F.length("_content") >= min_chars)
    return kept.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col(order).alias("o"), F.col(role).alias("role"),
            F.col("_content").alias("content")))).alias("_m"),
    ).select(*keys, F.concat(
        F.array(F.struct(F.lit("system").alias("role"), system_col.alias("content"))),
        F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                             m["content"].alias("content"))),
    ).alias("messages"))


def valid_sample(messages: Column) -> Column:
    def has(role: str) -> Column:
        return F.exists(messages, lambda m: m["role"] == role)
    return (F.size(messages) >= 3) & has("user") & has("assistant")


def pair_messages(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows of pairs as message rows (two per pair), ordered by ``o``."""
    both = F.array(
        F.struct((F.col("i") * 2).alias("o"), F.lit("user").alias("role"),
                 F.col("user_text").alias("text")),
        F.struct((F.col("i") * 2 + 1).alias("o"), F.lit("assistant").alias("role"),
                 F.col("assistant_text").alias("text")))
    return windows.select(*keys, F.inline(both))


def dialogue_to_chat(df: DataFrame) -> DataFrame:
    """Raw dialogues (id, patient_info, dialogue) as chat samples.

    Speakers outside the two known lists are dropped; the patient note is added to the
    system message.
    """
    system = F.concat(
        F.lit(dialogue.CARE_PROMPT),
        F.when(nz("patient_info") != "", F.concat(
            F.lit("\n\n" + dialogue.PATIENT_LABEL), F.col("patient_info"))).otherwise(""))
    turns = F.filter(F.transform("dialogue", lambda t: F.struct(
        T.speaker_role(t["speaker"]).alias("role"), nz(t["text"]).alias("content"))),
        lambda t: t["role"].isNotNull())
    return df.select("id", F.concat(
        F.array(F.struct(F.lit("system").alias("role"), system.alias("content"))), turns,
    ).alias("messages")).filter(F.size("messages") > 1)


def instruction_samples(pairs: DataFrame, patient_info: Column | None = None) -> DataFrame:
    """Pairs as (instruction, input, output)."""
    note = F.lit("") if patient_info is None else nz(patient_info)
    instruction = F.concat(F.lit(dialogue.INSTRUCTION), F.when(
        note != "", F.concat(F.lit("\n" + dialogue.PATIENT_LABEL), note)).otherwise(""))
    return pairs.select(
        *[c for c in pairs.columns if c not in ("user_text", "assistant_text")],
        instruction.alias("instruction"), F.col("user_text").alias("input"),
        F.col("assistant_text").alias("output"))


def train_valid_split(df: DataFrame, ident: str, ratio: float = 0.85,
                      seed: str = "42") -> DataFrame:
    """Exact split: the first ``int(n * ratio)`` rows in digest order are ``train``.

    The order runs over digest ranges that are counted first, so no task sorts the whole
    table. Split conversations, not windows, to keep windows of one together.
    """
    keyed = df.withColumn("_h", F.md5(F.concat(F.col(ident).cast("string"), F.lit(seed))))
    ranked = S.dense_position(keyed, [], ["_h", ident], S.hash_segment("_h"), "_rn")
    cut = df.agg(F.floor(F.count("*") * F.lit(ratio)).alias("_cut"))
    return ranked.join(F.broadcast(cut)).select(
        *df.columns, F.when(F.col("_rn") < F.col("_cut"), "train").otherwise("valid")
        .alias("split"))


# ---- context of a turn -------------------------------------------------------------

def turn_context(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", history: int = HISTORY,
                 size: int = S.SEGMENT_ROWS) -> DataFrame:
    """Adds what a turn knows of the messages before it; one exchange serves all of it, and another one or two
    number the messages if some conversation is longer than a segment.

    ``history`` (array of role and text, oldest first), ``turn_count`` (user messages in
    it), ``recent_topic``, ``previous_topics`` (newest first), ``repeated_question`` and
    ``topic_drifted``. Topic, stems and word hits are computed once per message, before
    the frame, and not again for every turn that looks back at it.
    """
    user = F.col(role) == "user"
    one = S.one_segment(df, S.segment(turn, size))
    numbered = df if one else number_turns(df, key, turn, "_pos", size, [role, text], False)
    featured = numbered.withColumn("_m", F.struct(
        F.col(role).alias("role"), F.col(text).alias("text"),
        F.when(user, T.extract_topic(text)).alias("topic"),
        F.when(user, T.content_stems(text)).alias("stems"),
        F.when(user, keyword_count(F.col(text), medical.GATE_WORDS)).alias("hits")))
    framed = S.over_frame(
        featured, [key], [turn, role, text] if one else "_pos",
        {"_h": lambda w: F.collect_list("_m").over(w.rowsBetween(-history, -1))},
        before=history, size=size, whole=one)
    users = F.filter("_h", lambda m: m["role"] == "user")
    with_users = framed.withColumn("_u", users)
    topics = F.filter(F.transform(F.reverse("_u"), lambda m: m["topic"]), lambda t: t != "")
    return with_users.select(
        *df.columns,
        F.transform("_h", lambda m: F.struct(m["role"], m["text"])).alias("history"),
        F.size("_u").alias("turn_count"),
        F.coalesce(F.get(topics, F.lit(0)), F.lit("")).alias("recent_topic"),
        F.array_distinct(topics).alias("previous_topics"),
        repeated_question(F.col(text), F.transform("_u", lambda m: m["stems"]))
        .alias("repeated_question"),
        topic_drifted(F.col(text), F.coalesce(F.get(topics, F.lit(0)), F.lit("")),
                      F.filter(F.slice("_h", F.greatest(F.size("_h") - 4, F.lit(0)) + 1, 4),
                               lambda m: m["role"] == "user")).alias("topic_drifted"))


def repeated_question(text: Column, earlier_stems: Column, stems: Column | None = None,
                      gate: Column | None = None, min_shared: int = 3,
                      ratio: float = 0.7) -> Column:
    """A gated question that shares enough stems with an earlier one (overlap of the
    smaller set)."""
    gate = analysis_gate(text) if gate is None else gate

    def same(mine: Column, other: Column) -> Column:
        return let(F.struct(F.least(F.size(mine), F.size(other)).alias("n"),
                            F.size(F.array_intersect(mine, other)).alias("s")),
                   lambda x: (x["n"] >= min_shared) & (x["s"] >= min_shared)
                   & (x["s"] / x["n"] >= ratio))

    return gate & let(T.content_stems(text) if stems is None else stems, lambda mine:
                      F.exists(earlier_stems, lambda other: same(mine, other)))


def topic_drifted(text: Column, recent_topic: Column, recent_users: Column,
                  min_hits: int = 2, min_chars: int = 15) -> Column:
    """A longer message without a health word after a clearly health-related one."""
    peak = F.coalesce(F.array_max(F.transform(recent_users, lambda m: m["hits"])), F.lit(0))
    return ((recent_topic != "") & (peak >= min_hits) & ~analysis_gate(text)
            & (F.length(text) > min_chars))


def recent_turns(df: DataFrame, key: str = "conv_id", turn: str = "turn",
                 n: int = 3) -> DataFrame:
    """Last ``2 n`` messages of each conversation. The row limit is pushed below the
    exchange, so a long conversation sends only its candidates."""
    w = Window.partitionBy(key).orderBy(F.col(turn).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 2 * n).drop("_rn")


def with_rewrites(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text", history: int = HISTORY,
                  size: int = S.SEGMENT_ROWS) -> DataFrame:
    """User turns with the question rewritten from the last user message before them."""
    framed = _framed(
        df.select(key, turn, role, text), key, turn, role, text, size,
        {"last_user": lambda w: F.last(
            F.when((F.col(role) == "user") & (F.col(text) != ""), F.col(text)), True
        ).over(w.rowsBetween(-history, -1))},
        before=history)
    return framed.filter(F.col(role) == "user").withColumn(
        "rewritten", T.rewrite_followup(text, "last_user", T.extract_topic("last_user")))


# ---- summaries ---------------------------------------------------------------------

def due_summaries(df: DataFrame, summaries: DataFrame, key: str = "conv_id",
                  threshold: int = 10, keep_last: int = 5) -> DataFrame:
    """Per key: pairs so far, pairs already summarised, whether a summary is due, and the
    half-open message range it would cover."""
    counts = df.groupBy(key).agg(F.floor(F.count("*") / 2).cast("long").alias("pairs"))
    joined = counts.join(summaries.select(key, "summarized_count"), key, "left")
    done = F.coalesce("summarized_count", F.lit(0)).cast("long")
    return joined.select(
        key, "pairs", done.alias("summarized_count"),
        (F.col("pairs") - done >= threshold).alias("due"),
        (done * 2).alias("from_message"),
        (F.greatest(done, F.col("pairs") - keep_last) * 2).alias("to_message"))


def turns_to_summarize(df: DataFrame, bounds: DataFrame, key: str = "conv_id",
                       turn: str = "turn") -> DataFrame:
    """Messages inside the range of their key."""
    return df.join(bounds.select(key, "from_message", "to_message"), key).filter(
        (F.col(turn) >= F.col("from_message")) & (F.col(turn) < F.col("to_message"))
    ).drop("from_message", "to_message")


def prompt_and_expected(df: DataFrame, key: str = "conv_id", turn: str = "turn",
                        role: str = "role", text: str = "text") -> DataFrame:
    """First assistant text (expected) and last user text (input) of a conversation."""
    first = F.min_by(text, F.when(F.col(role) == "assistant", F.col(turn)))
    last = F.max_by(text, F.when(F.col(role) == "user", F.col(turn)))
    return df.groupBy(key).agg(last.alias("input"), first.alias("expected")).filter(
        "input is not null and expected is not null and input <> '' and expected <> ''")


def session_pseudonyms(names: DataFrame, session: str = "conv_id", turn: str = "turn",
                       offset: str = "start", name: str = "name",
                       size: int = S.SEGMENT_ROWS) -> DataFrame:
    """Label of every name of a session, in order of first appearance.

    Names are reduced to their first place before anything is ordered, and the order is
    numbered by segments of turns.
    """
    first = names.groupBy(session, name).agg(
        F.min(F.struct(F.col(turn).alias("t"), F.col(offset).alias("o"))).alias("_f"),
        F.count("*").alias("n_mentions"))
    placed = first.select(session, name, "n_mentions", F.col("_f.t").alias("first_turn"),
                          F.col("_f.o").alias("first_offset"))
    numbered = S.dense_position(placed, [session], ["first_turn", "first_offset", name],
                                S.segment("first_turn", size), "number")
    return numbered.withColumn("label", pseudonym(F.col("number") + 1))


