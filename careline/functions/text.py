"""Cleaning, truncation, formatting and word-level text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from careline.functions.core import alternation, any_of, col, let, nz, rx, strings, strip
from careline.rules import care, dialogue, intents, medical, pii

KST = "Asia/Seoul"


# ---- cleaning -------------------------------------------------------------------

def clean_text(c: Column | str, version: int = 2) -> Column:
    """Drop stray letters, squeeze white space, drop placeholders and markers."""
    out = F.regexp_replace(nz(c), dialogue.STRAY_LETTERS, "")
    out = strip(F.regexp_replace(out, r"(?U)\s+", " "))
    holders = dialogue.PLACEHOLDERS_V1 if version == 1 else dialogue.PLACEHOLDERS_V2
    for pattern in [*holders, dialogue.MARKERS]:
        out = F.regexp_replace(out, pattern, "")
    return strip(out)


def normalize_role(c: Column | str, version: int = 2) -> Column:
    role = F.lower(strip(nz(c)))
    if version == 2:
        role = strip(F.regexp_replace(role, r"\([^)]*\)", ""))

    def has(words: Sequence[str]) -> Column:
        return any_of([F.contains(role, F.lit(w)) for w in words])

    return (
        F.when(has(dialogue.USER_ROLES), "user")
        .when(has(dialogue.ASSISTANT_ROLES), "assistant")
        .when(F.contains(role, F.lit("system")), "system")
        .otherwise(role)
    )


def speaker_role(
    c: Column | str,
    users: Sequence[str] = dialogue.USER_SPEAKERS,
    assistants: Sequence[str] = dialogue.ASSISTANT_SPEAKERS,
) -> Column:
    """Role of an exactly named speaker; null for anyone else."""
    return F.when(col(c).isin(list(users)), "user").when(
        col(c).isin(list(assistants)), "assistant")


def truncate_chars(c: Column | str, n: int) -> Column:
    return F.substring(nz(c), 1, n)


def truncate_at_sentence(c: Column | str, limit: int = dialogue.SPOKEN_CHARS) -> Column:
    text = strip(nz(c))
    head = F.substring(text, 1, limit)
    upto = F.regexp_extract(head, r"(?s)^(.*[.?!…\n])", 1)
    return (
        F.when(F.length(text) <= limit, text)
        .when(F.length(upto) - 1 >= limit // 2, upto)
        .otherwise(head)
    )


def collapse_repeats(c: Column | str) -> Column:
    """Fold immediate repetitions of words, short phrases and letters."""
    words = F.filter(F.split(nz(c), r"(?U)\s+"), lambda w: w != "")
    kept = let(words, lambda ws: F.filter(
        ws, lambda w, i: (i == 0) | (w != F.get(ws, i - 1))))
    out = F.array_join(kept, " ")
    out = F.regexp_replace(out, r"(?d)(.{2,10}?)\1{2,}", "$1")
    return strip(F.regexp_replace(out, r"(?d)(.)\1{3,}", "$1"))


def strip_model_artifacts(c: Column | str) -> Column:
    text = nz(c)
    closing = F.lit("</think>")
    out = F.when(
        F.contains(text, closing),
        F.substring(text, F.locate("</think>", text) + len("</think>"), F.length(text)),
    ).otherwise(text)
    for pattern, replacement in dialogue.ARTIFACTS:
        out = F.regexp_replace(out, rx(pattern), replacement)
    out = strip(out)
    for pattern in dialogue.LEADING_ARTIFACTS:
        out = F.regexp_replace(out, rx(pattern), "")
    return strip(out)


def anonymize_basic(c: Column | str) -> Column:
    out = nz(c)
    for pattern, tag in pii.BASIC:
        out = F.regexp_replace(out, rx(pattern), tag)
    return out


def bracket_to_paren(c: Column | str) -> Column:
    return F.regexp_replace(strip_quotes(c), r"\[([^\]]+)\]", "($1)")


def strip_quotes(c: Column | str) -> Column:
    return F.regexp_replace(strip(nz(c)), '^"+|"+\\z', "")


def scrub_newlines(c: Column | str, newline: str = "\r") -> Column:
    return strip(F.translate(nz(c), newline, " "))


def script_filter(c: Column | str, pattern: str = medical.HANGUL_CLASS) -> Column:
    """Only the lines that hold a character of the script."""
    return F.array_join(
        F.filter(F.split(nz(c), "\n", -1), lambda line: line.rlike(pattern)), "\n")


# ---- chat templates and context ---------------------------------------------------

def render_chat(messages: Column | str, style: str = "chatml") -> Column:
    """Messages (array of role and content) as one training string."""

    def one(m: Column) -> Column:
        role, content = m["role"], m["content"]
        if style == "chatml":
            body = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content,
                            F.lit("<|im_end|>\n"))
            return F.when(role.isin("system", "user", "assistant"), body).otherwise("")
        think = F.when(role == "assistant", "<think>\n</think>").otherwise("")
        return F.concat(F.lit("[|"), role, F.lit("|]"), think, content, F.lit("[|endofturn|]\n"))

    return F.array_join(F.transform(col(messages), one), "")


def profile_text(fields: dict[str, Column], known: Column) -> Column:
    """Non-empty profile fields as ``- name: value`` lines."""
    lines = F.array_compact(F.array(*[
        F.when((v.cast("string") != "") & ~v.cast("string").isin("0", "false"),
               F.concat(F.lit(f"- {k}: "), v.cast("string")))
        for k, v in fields.items()
    ]))
    return (
        F.when(~known, dialogue.CTX_NO_PROFILE)
        .when(F.size(lines) == 0, dialogue.CTX_BASIC_PROFILE)
        .otherwise(F.array_join(lines, "\n"))
    )


def history_text(history: Column, last: int = 6, chars: int = 200) -> Column:
    """Last messages (array of role and text, oldest first) as ``speaker: text`` lines."""
    recent = F.slice(history, F.greatest(F.size(history) - last, F.lit(0)) + 1, last)
    lines = F.transform(recent, lambda m: F.concat(
        F.when(m["role"] == "user", dialogue.CTX_USER).otherwise(dialogue.CTX_AI),
        F.lit(": "), F.substring(m["text"], 1, chars)))
    return F.when(F.coalesce(F.size(history), F.lit(0)) <= 0, dialogue.CTX_NO_HISTORY).otherwise(
        F.array_join(lines, "\n"))


def docs_text(docs: Column, first: int = 3) -> Column:
    lines = F.transform(F.slice(docs, 1, first), lambda d, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("] "), d))
    return F.when(F.coalesce(F.size(docs), F.lit(0)) <= 0, dialogue.CTX_NO_DOCS).otherwise(
        F.array_join(lines, "\n\n"))


# ---- time -------------------------------------------------------------------------

def kst(ts: Column | str) -> Column:
    """UTC timestamp as local time of the service."""
    return F.from_utc_timestamp(col(ts), KST)


def format_kst(ts: Column | str) -> Column:
    local = kst(ts)
    hour = F.hour(local)
    shown = F.when(hour == 0, 12).when(hour > 12, hour - 12).otherwise(hour)
    return F.format_string(
        "%s년 %s월 %s일 %s %d시 %s분",
        F.date_format(local, "yyyy"), F.date_format(local, "MM"), F.date_format(local, "dd"),
        F.when(hour < 12, "오전").otherwise("오후"), shown, F.date_format(local, "mm"))


def kst_clock(ts: Column | str) -> Column:
    return F.date_format(kst(ts), "HH:mm")


def day_part(hour: Column) -> Column:
    out = F.when(F.lit(False), "")
    for start, end, name in care.DAY_PARTS:
        out = out.when((hour >= start) & (hour < end), name)
    return out.otherwise(care.DAY_PART_ELSE)


def suggestions(hour: Column) -> Column:
    out = F.when(F.lit(False), strings([]))
    for start, end, texts in care.SUGGESTIONS[:-1]:
        out = out.when((hour >= start) & (hour < end), strings(texts))
    return out.otherwise(strings(care.SUGGESTIONS[-1][2]))


# ---- topics, stems, follow-ups ----------------------------------------------------

def extract_topic(
    c: Column | str,
    nouns: Sequence[str] = medical.TOPIC_NOUNS,
    verbs: Sequence[str] = medical.TOPIC_VERBS,
) -> Column:
    text = nz(c)
    found = F.array_distinct(F.concat(
        F.regexp_extract_all(text, F.lit("(" + alternation(nouns) + ")"), F.lit(1)),
        F.regexp_extract_all(text, F.lit("(" + alternation(verbs) + ")"), F.lit(1))))
    return let(found, lambda f: F.when(F.size(f) > 0, F.array_join(f, " ")).otherwise(
        strip(F.substring(text, 1, 20))))


def content_stems(
    c: Column | str,
    word_pattern: str = medical.STEM_WORD_PATTERN,
    stop_words: Sequence[str] = medical.STEM_STOP_WORDS,
    suffixes: Sequence[str] = medical.STEM_SUFFIXES,
) -> Column:
    """Distinct word stems with content, in order of appearance."""
    ending = "(" + "|".join(suffixes) + ")$"
    seen = F.regexp_extract_all(nz(c), F.lit(word_pattern), F.lit(0))
    kept = F.array_except(F.array_distinct(seen), strings(stop_words))
    stems = F.transform(kept, lambda w: F.regexp_replace(w, ending, ""))
    return F.array_distinct(F.filter(stems, lambda s: F.length(s) >= 2))


def rewrite_followup(
    message: Column | str, last_user: Column | str, topic: Column | str,
) -> Column:
    """Expand a follow-up question with the previous user message or topic."""
    msg, prev = strip(nz(message)), nz(last_user)

    def rest(pattern: str, default: str = "") -> Column:
        tail = F.regexp_extract(msg, rx(pattern), 2)
        return F.when(tail == "", default).otherwise(tail)

    about = F.when(nz(topic) != "", nz(topic)).otherwise(prev)
    return (
        F.when(prev == "", msg)
        .when(msg.rlike(intents.REWRITE_HOW), F.concat(prev, F.lit(" "), msg))
        .when(msg.rlike(rx(intents.REWRITE_SO)), F.concat(
            prev, F.lit(intents.REWRITE_ABOUT),
            rest(intents.REWRITE_SO, intents.REWRITE_SO_DEFAULT)))
        .when(msg.rlike(rx(intents.REWRITE_MORE)), F.concat(
            prev, F.lit(intents.REWRITE_ON),
            rest(intents.REWRITE_MORE, intents.REWRITE_MORE_DEFAULT)))
        .when(msg.rlike(rx(intents.REWRITE_YES)), F.concat(
            prev, F.lit(intents.REWRITE_MORE_TELL)))
        .when(msg.rlike(rx(intents.REWRITE_THAT)), strip(F.concat(
            about, F.lit(" "), rest(intents.REWRITE_THAT))))
        .when((F.length(msg) <= intents.SHORT_CHARS) & ~msg.rlike(intents.REWRITE_GREETING),
              F.concat(prev, F.lit(" "), msg))
        .otherwise(msg)
    )


def mood_text(mood: Column, energy: Column, notes: Column) -> Column:
    base = F.concat(F.lit("기분: "), mood, F.lit(", 에너지: "), energy.cast("string"), F.lit("/10"))
    return F.when(nz(notes) != "", F.concat(base, F.lit(", 메모: "), notes)).otherwise(base)


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))
