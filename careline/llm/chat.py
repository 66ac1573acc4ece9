"""Chat formatting from an event log.

A log has rows (conversation, message, seq, kind, text): ``start`` opens a message with its
role, ``delta`` appends a streamed piece, ``edit`` replaces what is there, ``regenerate``
starts the text anew. A message's text is what was appended since its last start, edit or
regenerate, in order of seq.

The template writes a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings in
roles and texts get a backslash behind their first character, and every backslash is doubled
before, so a text can neither open nor close a turn and reading back is exact.

Replaying numbers turns by their place in a range-partitioned sort, and folding groups by message,
so both spread a busy conversation over tasks. Rendered turns are rows: a conversation's turns are
sorted in one task, and one turn after the other passes through Python with the running place
(``rendered``) or the running digests (``read_back``), so memory does not grow with a conversation.
Only ``render`` puts a conversation into one row, for those that fit into one.

Defined cases: null texts and roles are empty; a message without a start has an empty role;
events without seq come first; equal seq are ordered by kind and text; other columns play no
part; an empty log gives no rows. Messages follow their number; a null number comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from careline.llm.common import filled, widened

START, END = "<|im_start|>", "<|im_end|>"
# fixed values: strings that templates in use give a meaning
CONTROLS = [START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>"]
LEARNT = "assistant"
#: Characters of a streamed piece when finished messages are replayed as events.
PIECE = 48
#: Characters of a text by which turns are dealt out before they are sorted by the whole text.
PREFIX = 64

EVENTS = "conv_id, message, seq, kind, role, text"


def _pattern() -> str:
    """First character of a control string that the rest follows."""
    rest: dict[str, list[str]] = {}
    for c in CONTROLS:
        rest.setdefault(c[0], []).append(rf"\Q{c[1:]}\E")
    return "|".join(rf"\Q{first}\E(?=" + "|".join(r) + ")" for first, r in rest.items())


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_pattern()})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def replayed(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
             role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """Finished turns as the log of their making: a start, a first attempt that is given up,
    then the text in streamed pieces. Message numbers rise by (turn, role, text), with gaps; rows that
    share a turn number are messages of their own.

    Ranges of (conversation, turn, role, first characters) are sorted one by one, so a conversation of
    any size is spread over tasks, also if its turns share one number."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"),
                        filled(role_col).alias("role"), filled(text_col).alias("text"))
    ranges = rows.repartitionByRange("conv_id", "_turn", "role", F.substring("text", 1, PREFIX))
    rows = ranges.sortWithinPartitions("conv_id", "_turn", "role", "text").select(
        "conv_id", F.monotonically_increasing_id().alias("message"), "role", "text")
    event = "struct<seq:int,kind:string,text:string>"
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    pieces = F.transform(
        F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(cut),
        lambda t, i: F.struct((i + 3).alias("seq"), F.lit("delta").alias("kind"), t.alias("text")))
    opening = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("start").alias("kind"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.substring("text", 1, 8).alias("text")),
        F.struct(F.lit(2).alias("seq"), F.lit("regenerate").alias("kind"), F.lit("").alias("text")))
    events = F.concat(opening.cast(f"array<{event}>"), pieces.cast(f"array<{event}>"))
    return rows.select("conv_id", "message", "role", F.explode(events).alias("e")).select(
        "conv_id", "message", "e.seq", "e.kind",
        F.when(F.col("e.kind") == "start", F.col("role")).alias("role"), "e.text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the final messages of a log."""
    resets = F.col("kind").isin("start", "edit", "regenerate")
    seq = F.coalesce("seq", F.lit(-1))
    one = F.struct(seq.alias("seq"), "kind", filled("text").alias("text"))
    return (
        events.groupBy("conv_id", "message")
        .agg(F.max("role").alias("role"), F.max(F.when(resets, seq)).alias("reset"),
             F.sort_array(F.collect_list(one)).alias("log"))
        .select("conv_id", "message", filled("role").alias("role"), F.array_join(F.transform(
            F.filter("log", lambda e: F.col("reset").isNull() | (e["seq"] >= F.col("reset"))),
            lambda e: e["text"]), "").alias("text")))


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, message, at, turn, start, chars, learnt: one row per turn, with its formatted text, the
    place of its first character in the conversation, and the span of its text there. Joined along
    ``at`` the turns are the formatted conversation; they come in this order, whole conversations to
    a task."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    rows = messages.select(
        "conv_id", "message", F.concat(F.lit(START), role, F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"), (F.col("role") == LEARNT).alias("learnt"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "message", "head", "body").select(
        "conv_id", "message", F.concat("head", "body", F.lit(END + "\n")).alias("turn"),
        F.length("head").cast("bigint").alias("n_head"), F.length("body").cast("bigint").alias("chars"), "learnt")
    tail = len(END) + 1
    schema = StructType([*rows.schema.fields[:3], *StructType.fromDDL(
        "at bigint, start bigint, chars bigint, learnt boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, end = None, 0
        for batch in batches:
            places, starts = [], []
            heads, bodies = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for conv, n_head, n in zip(batch.column(0).to_pylist(), heads, bodies):
                if last is None or conv != last[0]:
                    last, end = (conv,), 0
                places.append(end)
                starts.append(end + n_head)
                end += n_head + n + tail
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(places, pa.int64()), pa.array(starts, pa.int64()), *batch.columns[4:]],
                names=schema.names)

    return rows.mapInArrow(run, schema)


def read_back(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: ``rendered`` turns,
    parsed and unescaped, digested in their order: each role and text with a line end behind it, and
    the learnt texts."""
    one = parse(F.col("turn"))[0]
    rows = turns.select("conv_id", F.length("turn").cast("bigint").alias("n"), F.concat(
        one["role"], F.lit("\n"), one["text"], F.lit("\n")).alias("back"), F.when(F.col("learnt"), unescape(F.substring(
            "turn", F.col("start") - F.col("at") + 1, F.col("chars")))).alias("loss"))
    schema = widened(turns.select("conv_id"), "n_turns bigint, turns_sha256 string, loss_chars bigint, "
                     "loss_sha256 string, formatted_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        last, done = None, []
        for batch in batches:
            for conv, n, back, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None or conv != last[0]:
                    if last is not None:
                        done.append((*last, n_turns, whole.hexdigest(), loss_chars, learnt.hexdigest(), chars))
                    last, n_turns, loss_chars, chars = (conv,), 0, 0, 0
                    whole, learnt = hashlib.sha256(), hashlib.sha256()
                n_turns, chars = n_turns + 1, chars + n
                whole.update(back.encode())
                if loss is not None:
                    loss_chars += len(loss)
                    learnt.update(loss.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), arrow.types)], schema=arrow)
                done = []
        if last is not None:
            done = [(*last, n_turns, whole.hexdigest(), loss_chars, learnt.hexdigest(), chars)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*done), arrow.types)], schema=arrow)

    return rows.mapInArrow(run, schema)


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: one text per conversation, and the spans (first character and
    number of characters) that a model learns: texts of the assistant. For conversations that fit into
    a row (2 GB); ``rendered`` has no such limit."""
    turn = F.struct("at", "turn", F.col("start").cast("int").alias("start"),
                    F.col("chars").cast("int").alias("chars"), "learnt")
    listed = rendered(messages).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return listed.select(
        "conv_id", F.array_join("turns.turn", "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learnt"]),
                    lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars"))).alias("loss"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text: array of (role, text), unescaped."""
    raw = F.filter(F.split(formatted, rf"\Q{START}\E"), lambda t, i: i > 0)
    role, body = r"(?s)^((?:[^\\\n]|\\.)*)\n", rf"(?s)^(?:[^\\\n]|\\.)*\n(.*)\Q{END}\E\n$"
    return F.transform(raw, lambda t: F.struct(
        unescape(F.regexp_extract(t, role, 1)).alias("role"),
        unescape(F.regexp_extract(t, body, 1)).alias("text")))


def learnt_text(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss spans of ``render``, joined; each span is looked up from the
    start, so ``read_back`` is the way for conversations of many turns."""
    return F.array_join(F.transform(
        loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["chars"]))), "")
