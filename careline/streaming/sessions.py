"""Stateful stream operators with a batch twin each.

A conversation is a key. Its rows may come in any order, in any batch: they wait in a ``MapState`` by time bucket,
and a timer at the end of each bucket releases them once the watermark has passed it, so the state store does the
ordering, and a worker holds one bucket of one conversation. What an operator remembers between rows is typed state
of its own: a ``ListState`` of the last messages, a ``ValueState`` of a flag or of counters, a ``MapState`` of the names.

A session ends when a conversation has been silent for ``keep`` (none: it never does). This is event time
as well: a later row finds everything forgotten, however rows are cut into batches, and a timer clears the state of a
conversation that no row comes to again. Rows behind the watermark are dropped, as in any stream.

Text features are worked out in the stream's projections, so state holds small values; texts pass through the state
of ``session_context`` only if they are wanted. State needs the RocksDB store (``rocksdb_state``), whose
size is that of a disk; it is kept below the checkpoint folder, so a lost executor loses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from careline.functions import text as T
from careline.functions.lexicon import keyword_count
from careline.operators.turns import HISTORY
from careline.rules import medical

CONTEXT = (
    "conv_id bigint, turn bigint, role string, text string, turn_count int, "
    "recent_topic string, previous_topics array<string>, repeated_question boolean, "
    "topic_drifted boolean"
)
REFERRALS = "conv_id bigint, turn bigint, referral boolean"
NAMES = "conv_id bigint, turn bigint, start int, name string, label string"
SUMMARIES = "conv_id bigint, pairs bigint, from_message bigint, to_message bigint"
#: Rows of so much event time are released together.
BUCKET_MS = 60_000
#: How far rows may lag behind the newest one.
LATE = "10 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def with_features(turns: DataFrame, texts: bool = True) -> DataFrame:
    """What the context state needs of a message; the text itself only passes through, if wanted."""
    hits = keyword_count(F.col("text"), medical.GATE_WORDS)
    found = turns.select(
        "at", "conv_id", "turn", "role", "text",
        F.coalesce(F.length("text") > 15, F.lit(False)).alias("wordy"), T.extract_topic("text").alias("topic"),
        T.content_stems("text").alias("stems"), hits.alias("hits"))
    return found if texts else found.withColumn("text", F.lit(None).cast("string"))


def _shares(mine: set, other: set) -> bool:
    smaller, shared = min(len(mine), len(other)), len(mine & other)
    return smaller >= 3 and shared >= 3 and shared / smaller >= 0.7


class InOrder(StatefulProcessor):
    """Passes the rows of a key to ``step`` in the order of ``at_ms`` and ``order``, bucket by bucket."""

    fields: list[str] = []  # columns of a waiting row, as DDL
    order: list[str] = ["turn"]
    output: str = ""

    def __init__(self, bucket_ms: int = BUCKET_MS, keep_ms: int | None = None):
        self.bucket_ms, self.keep_ms = 2 * max(1, bucket_ms // 2), keep_ms
        self.names = ["at_ms", *(f.split()[0] for f in self.fields)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = ",".join(f.replace(" ", ":", 1) for f in ["at_ms bigint", *self.fields])
        self.waiting = handle.getMapState("waiting", "bucket bigint", f"rows array<struct<{row}>>")
        self.until = handle.getValueState("until", "at_ms bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Open the operator's own state."""
        raise NotImplementedError

    def step(self, key: int, rows: list[dict]) -> list[tuple]:
        """Output of some rows, in order; what is to be remembered goes to the operator's state."""
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            values = frame[self.names].astype(object).where(frame[self.names].notna(), None)
            for bucket, part in values.groupby(frame["at_ms"] // self.bucket_ms):
                at, more = (int(bucket),), [tuple(map(_plain, r)) for r in part.itertuples(index=False, name=None)]
                old = self.waiting.getValue(at) if self.waiting.containsKey(at) else None
                if old is None:
                    self.handle.registerTimer((at[0] + 1) * self.bucket_ms)
                self.waiting.updateValue(at, ([tuple(r) for r in old[0]] + more if old else more,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if now % 2:  # ends of sessions are odd, those of buckets are even
            if self.until.exists() and self.until.get()[0] == now:
                self.forget()
                self.until.clear()
            return
        at = (now // self.bucket_ms - 1,)
        if not self.waiting.containsKey(at):
            return
        rows = [dict(zip(self.names, r)) for r in self.waiting.getValue(at)[0]]
        self.waiting.removeKey(at)
        rows.sort(key=lambda r: (r["at_ms"], *((r[c] is None, r[c]) for c in self.order)))
        conv = None if key[0] is None else int(key[0])
        out, first, until = [], 0, self.until.get()[0] if self.until.exists() else None
        for i, row in enumerate(rows):
            if until is not None and row["at_ms"] > until:  # silence: what came before is another session
                out += self.step(conv, rows[first:i])
                self.forget()
                first = i
            until = None if self.keep_ms is None else (row["at_ms"] + self.keep_ms) | 1
        out += self.step(conv, rows[first:])
        if until is not None:
            if self.until.exists():
                self.handle.deleteTimer(self.until.get()[0])
            self.until.update((until,))
            self.handle.registerTimer(until)
        if out:
            yield pd.DataFrame(out, columns=[f.split()[0] for f in self.output.split(", ")])

    def close(self) -> None:
        pass


def _plain(value):
    """A value of a pandas row as state takes it."""
    if value is None or isinstance(value, (str, bool, int)):
        return value
    if hasattr(value, "tolist"):  # numpy scalars and arrays
        return value.tolist()
    return value if isinstance(value, list) else int(value)


class Context(InOrder):
    """The last messages: a list of HISTORY."""

    fields = ["turn bigint", "role string", "text string", "wordy boolean", "topic string", "stems array<string>", "hits int"]
    output = CONTEXT

    def open(self, handle):
        self.past = handle.getListState("past", "role string, topic string, stems array<string>, hits int")

    def forget(self):
        self.past.clear()

    def step(self, key, rows):
        past, out = list(self.past.get()) if self.past.exists() else [], []
        for r in rows:
            users = [p for p in past if p[0] == "user"]
            topics = [p[1] for p in reversed(users) if p[1]]
            mine = set(r["stems"] or ())
            peak = max([p[3] for p in past[-4:] if p[0] == "user"], default=0)
            recent, gated = (topics[0] if topics else ""), r["hits"] > 0
            out.append((
                key, r["turn"], r["role"], r["text"], len(users), recent, list(dict.fromkeys(topics)),
                bool(gated and any(_shares(mine, set(p[2])) for p in users)),
                bool(recent and peak >= 2 and not gated and r["wordy"])))
            past = [*past, (r["role"], r["topic"], r["stems"] or [], r["hits"])][-HISTORY:]
        if rows:
            self.past.put([tuple(p) for p in past])
        return out


class Once(InOrder):
    """One flag."""

    fields = ["turn bigint", "flag boolean"]
    output = REFERRALS

    def open(self, handle):
        self.given = handle.getValueState("given", "given boolean")

    def forget(self):
        self.given.clear()

    def step(self, key, rows):
        given, out = self.given.exists(), []
        for r in rows:
            out.append((key, r["turn"], bool(r["flag"]) and not given))
            if r["flag"] and not given:
                given = True
                self.given.update((True,))
        return out


class Names(InOrder):
    """A number for each name; only the names of a bucket are looked up."""

    fields = ["turn bigint", "start int", "name string"]
    order = ["turn", "start", "name"]
    output = NAMES

    def open(self, handle):
        self.numbers = handle.getMapState("numbers", "name string", "number int")
        self.count = handle.getValueState("count", "n int")

    def forget(self):
        self.numbers.clear()
        self.count.clear()

    def step(self, key, rows):
        n, known, out = self.count.get()[0] if self.count.exists() else 0, {}, []
        before = n
        for r in rows:
            name = r["name"]
            if name not in known:
                if self.numbers.containsKey((name,)):
                    known[name] = self.numbers.getValue((name,))[0]
                else:
                    known[name], n = n, n + 1
                    self.numbers.updateValue((name,), (known[name],))
            out.append((key, r["turn"], r["start"], name, f"[사용자{chr(65 + known[name] % 26)}]"))
        if n > before:
            self.count.update((n,))
        return out


class Summaries(InOrder):
    """Two counters: messages, and pairs that are summarised."""

    fields = ["turn bigint"]
    output = SUMMARIES

    def __init__(self, threshold: int, keep_last: int, **options):
        super().__init__(**options)
        self.threshold, self.keep_last = threshold, keep_last

    def open(self, handle):
        self.seen = handle.getValueState("seen", "messages bigint, done bigint")

    def forget(self):
        self.seen.clear()

    def step(self, key, rows):
        messages, done = self.seen.get() if self.seen.exists() else (0, 0)
        out = []
        for _ in rows:  # message by message, so that the batches do not matter
            messages += 1
            pairs = messages // 2
            if pairs - done >= self.threshold:
                until = max(done, pairs - self.keep_last)
                out.append((key, pairs, done * 2, until * 2))
                done = until
        if rows:
            self.seen.update((messages, done))
        return out


def _stateful(df: DataFrame, processor: InOrder, late: str) -> DataFrame:
    """``df`` has ``at``, the time of a row (after 1970, where watermarks begin); rows without one count as the first of all."""
    at = F.coalesce("at", F.timestamp_seconds(F.lit(1)))
    timed = df.withColumn("at", at).withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    # keys travel through pandas, where a column of numbers with a null turns into floats
    return timed.withColumn("_key", F.col("conv_id").cast("string")).groupBy("_key").transformWithStateInPandas(
        processor, processor.output, outputMode="Append", timeMode="EventTime")


def session_context(turns: DataFrame, late: str = LATE, texts: bool = True, **options) -> DataFrame:
    """(at, conv_id, turn, role, text) → each turn with its context, kept per session (twin: ``turn_context``). Without
    ``texts`` they stay out of the state, and the column is null. ``options``: ``bucket_ms`` and ``keep_ms``."""
    return _stateful(with_features(turns, texts), Context(**options), late)


def once_per_session(flags: DataFrame, late: str = LATE, **options) -> DataFrame:
    """(at, conv_id, turn, flag) → (conv_id, turn, referral), set once per session."""
    return _stateful(flags.select("at", "conv_id", "turn", "flag"), Once(**options), late)


def session_names(names: DataFrame, late: str = LATE, **options) -> DataFrame:
    """(at, conv_id, turn, start, name) → the same with a label that is stable within a session."""
    return _stateful(names.select("at", "conv_id", "turn", "start", "name"), Names(**options), late)


def summary_triggers(turns: DataFrame, threshold: int = 10, keep_last: int = 5, late: str = LATE, **options) -> DataFrame:
    """(at, conv_id, turn) → the range to summarise each time enough new pairs have come in: a row at each message
    that completes ``threshold`` pairs since the last row."""
    return _stateful(turns.select("at", "conv_id", "turn"), Summaries(threshold, keep_last, **options), late)
