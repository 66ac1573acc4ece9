"""Stream jobs: analysis, alerts, sinks, reminders and activity windows."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from careline.operators.care import due_medications, minute_of_day
from careline.plans.pipeline import emergency_alerts, with_analysis, with_guidance, with_intent
from careline.streaming.sessions import rocksdb_state, session_context

log = logging.getLogger(__name__)

def turn_stream(turns: DataFrame, **options) -> DataFrame:
    """Each user message with analysis, intent and flags, as soon as the watermark has passed it. ``turns`` has ``at``;
    ``options`` as of ``session_context``."""
    users = session_context(turns, **options).filter(F.col("role") == "user")
    return with_guidance(with_intent(with_analysis(users)))


def alert_stream(analysed: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Emergency alerts joined to a static profile table."""
    return emergency_alerts(analysed, profiles)


def dual_sink(analysed: DataFrame, history_path: str, logs_path: str, checkpoint: str,
              log_row: Callable[[DataFrame], DataFrame],
              history_row: Callable[[DataFrame], DataFrame], **trigger) -> StreamingQuery:
    """Write each batch to two places that do not depend on each other.

    A batch owns one folder per sink and replaces it, so a repeated batch leaves no
    double rows. If one sink fails the other is still written, and the error is raised
    afterwards so that the batch is tried again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        failures = []
        for path, shape in ((history_path, history_row), (logs_path, log_row)):
            try:
                shape(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            except Exception as e:  # the other sink must still get its rows
                log.exception("sink %s failed in batch %d", path, batch_id)
                failures.append(e)
        batch.unpersist()
        if failures:
            raise failures[0]

    return analysed.writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def append_turn_rows(batch: DataFrame, response: str = "response") -> DataFrame:
    """The two message rows (human, then ai) of each turn."""
    return batch.select(
        F.col("conv_id").cast("string").alias("session_id"), "turn",
        F.posexplode(F.array(
            F.struct(F.lit("human").alias("type"),
                     F.struct(F.col("text").alias("content")).alias("data")),
            F.struct(F.lit("ai").alias("type"),
                     F.struct(F.coalesce(F.col(response), F.lit("")).alias("content"))
                     .alias("data")))).alias("part", "m"),
    ).select("session_id", "turn", "part", F.to_json("m").alias("message"))


def reminder_checks(ticks: DataFrame, meds: DataFrame, path: str, checkpoint: str,
                    every: str | None = None) -> StreamingQuery:
    """Due medications at each tick (nickname, ts), checked every few minutes."""
    def check(batch: DataFrame, batch_id: int) -> None:
        now = batch.withColumn("now_min", minute_of_day(F.col("ts")))
        due_medications(now, meds).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return ticks.writeStream.foreachBatch(check).option(
        "checkpointLocation", checkpoint).trigger(**trigger).start()


def activity_windows(events: DataFrame, at: str = "ts", kind: str = "event_type",
                     width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Activity counts per local day (or other width), closed by the watermark. This is
    the streaming form of the daily roll-up; late rows up to ``late`` still count."""
    return (
        events.withWatermark(at, late)
        .groupBy(F.window(at, width, startTime="15 hours" if width == "1 day" else None), kind)
        .agg(F.count("*").alias("n"), F.max(at).alias("last_time"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind,
                "n", "last_time")
    )


def activity_sessions(events: DataFrame, gaps: dict[str, str], gap: str = "30 minutes", at: str = "ts",
                      kind: str = "event_type", user: str = "user_id", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: events that come before all earlier ones of the session have run out.

    An event keeps its session open for the gap of its kind (``gaps``, else ``gap``), so a session ends with the
    latest of these ends, and an event at that very moment still belongs to it. Spark merges the windows
    of events in state, whatever their order; a session is written once the watermark has passed its end, and rows
    that lag behind the newest one by more than ``late`` are dropped. An event without a time takes no part.
    """
    width = F.lit(gap)
    for name, own in gaps.items():
        width = F.when(F.col(kind) == name, F.lit(own)).otherwise(width)
    return (
        events.filter(F.col(at).isNotNull()).withWatermark(at, late)
        .groupBy(F.session_window(at, width).alias("session"), user)
        .agg(F.count("*").alias("n"), F.min(at).alias("first_time"), F.max(at).alias("last_time"),
             *[F.count_if(F.col(kind) == name).alias(f"n_{name}") for name in gaps])
        .select(user, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n",
                *[f"n_{name}" for name in gaps], "first_time", "last_time")
    )


def run_to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available, into a parquet folder, and read that folder. State is kept in RocksDB."""
    with rocksdb_state(df.sparkSession):
        query = (
            df.writeStream.format("parquet").outputMode(mode).option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
