"""Stream jobs run over what is available, with the same SQL as their batch twins.

Each call writes to a new folder below the cluster's checkpoint folder (or a temporary
one where none is set, as in tests) and returns what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careline.plans.korean import KO, korean_turns
from careline.plans.queries_detect import _INTENT
from careline.plans.queries_turns import _CONTEXT
from careline.plans.registry import query
from careline.sources.scratch import work_folder
from careline.sources.tables import table
from careline.streaming import sessions, streams


def stream_of(spark: SparkSession, d: str, name: str, **options) -> DataFrame:
    """A table as a stream. A table is one file or a folder of part files; the glob finds both, and no other."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).options(**options).parquet(f"{d}/{{{name}.parquet}}")


def _run(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    folder = work_folder(spark)
    return streams.run_to_files(df, f"{folder}/out", f"{folder}/state", mode)


def closed(spark: SparkSession, rows: DataFrame, at: str = "at") -> DataFrame:
    """The stream with a last row far ahead in time and else null, so that the watermark passes all real rows; that
    row itself stays in state. It is of the same batch, or a later one, as the whole table is."""
    folder = work_folder(spark)
    end = F.lit("2250-01-01 00:00:00").cast("timestamp")
    spark.range(1).select(*[(end if f.name == at else F.lit(None).cast(f.dataType)).alias(f.name)
                            for f in rows.schema.fields]).write.parquet(f"{folder}/end")
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(f"{folder}/end"))


def timed(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Turns of a table that has no times, with the turn number as seconds of a clock, and an end."""
    start = F.lit("2000-01-01 00:00:00").cast("timestamp")
    return closed(spark, turns.withColumn("at", F.timestamp_seconds(F.unix_seconds(start) + F.col("turn"))))


def _turns(spark, d):
    return korean_turns(stream_of(spark, d, "conversations"))


@query("stream_session_context", f"""WITH {_CONTEXT}
SELECT conv_id, turn, turn_count, recent_topic, repeated_question, topic_drifted FROM ctx WHERE role = 'user'""")
def stream_session_context(spark, d):
    return _run(spark, sessions.session_context(timed(spark, _turns(spark, d)), texts=False)).filter("role = 'user'").select(
        "conv_id", "turn", "turn_count", "recent_topic", "repeated_question", "topic_drifted")


@query("stream_turn_log", f"WITH {_INTENT} SELECT conv_id, turn, intent, intent_confidence, route FROM iv")
def stream_turn_log(spark, d):
    analysed = streams.turn_stream(timed(spark, _turns(spark, d)))
    return _run(spark, analysed.select("conv_id", "turn", "intent", "intent_confidence", "route"))


@query("stream_alerts", f"""WITH {_INTENT} SELECT conv_id, turn, 'critical' AS level, coalesce(c_name, '') AS emergency_contact
FROM iv LEFT JOIN customer ON conv_id = c_custkey AND c_nationkey < 20 WHERE intent = 'emergency'""")
def stream_alerts(spark, d):
    profiles = table(spark, d, "customer").filter("c_nationkey < 20").select(
        F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("emergency_contact"))
    alerts = streams.alert_stream(streams.turn_stream(timed(spark, _turns(spark, d))), profiles)
    return _run(spark, alerts).select("conv_id", "turn", "level", "emergency_contact")


@query("stream_once_per_session", """
SELECT conv_id, turn, coalesce(role = 'user' AND length(text) > 150 AND turn = (SELECT min(turn) FROM conversations c
  WHERE c.conv_id = o.conv_id AND role = 'user' AND length(text) > 150), false) AS referral FROM conversations o""")
def stream_once_per_session(spark, d):
    flags = stream_of(spark, d, "conversations").select(
        "conv_id", "turn", F.expr("role = 'user' AND length(text) > 150").alias("flag"))
    return _run(spark, sessions.once_per_session(timed(spark, flags)))


@query("stream_session_names", """
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+', 0)) AS name,
   generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]+', 0), 1) - 1 AS start FROM conversations),
f AS (SELECT conv_id, name, min((turn, start)) AS first FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first, name) - 1 AS number FROM f)
SELECT conv_id, turn, start::INT AS start, name, '[사용자' || chr((65 + number % 26)::INT) || ']' AS label FROM w JOIN r USING (conv_id, name)""")
def stream_session_names(spark, d):
    names = stream_of(spark, d, "conversations").select("conv_id", "turn", F.posexplode(
        F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("start", "name"))
    return _run(spark, sessions.session_names(timed(spark, names)))


@query("stream_summary_triggers", """
SELECT conv_id, p AS pairs, greatest(p - 2, 0) * 2 AS from_message, (p - 1) * 2 AS to_message
FROM (SELECT conv_id, unnest(range(2, count(*) // 2 + 1)) AS p FROM conversations GROUP BY conv_id)""")
def stream_summary_triggers(spark, d):
    return _run(spark, sessions.summary_triggers(timed(spark, stream_of(spark, d, "conversations").select("conv_id", "turn")), 2, 1))


@query("stream_dual_sink", f"""WITH {KO},
u AS (SELECT * FROM ko WHERE role = 'user')
SELECT 'history' AS sink, conv_id::VARCHAR AS session_id, turn, 0 AS part, 'human' AS type, coalesce(text, '') AS content FROM u
UNION ALL SELECT 'history', conv_id::VARCHAR, turn, 1, 'ai', 'reply to turn ' || turn FROM u UNION ALL SELECT 'logs', conv_id::VARCHAR, turn, 0, 'log', text FROM u""")
def stream_dual_sink(spark, d):
    folder = work_folder(spark)
    users = _turns(spark, d).filter("role = 'user'").withColumn(
        "response", F.concat(F.lit("reply to turn "), F.col("turn").cast("string")))
    streams.dual_sink(
        users, f"{folder}/history", f"{folder}/logs", f"{folder}/state",
        log_row=lambda b: b.select("conv_id", "turn", F.col("text").alias("user_message")),
        history_row=streams.append_turn_rows).awaitTermination()

    history = spark.read.parquet(f"{folder}/history").select(
        F.lit("history").alias("sink"), "session_id", "turn", "part", F.get_json_object("message", "$.type").alias("type"),
        F.coalesce(F.get_json_object("message", "$.data.content"), F.lit("")).alias("content"))
    logs = spark.read.parquet(f"{folder}/logs").select(
        F.lit("logs").alias("sink"), F.col("conv_id").cast("string").alias("session_id"), "turn", F.lit(0).alias("part"),
        F.lit("log").alias("type"), F.col("user_message").alias("content"))
    return history.unionByName(logs)


@query("stream_due_medications", """
WITH w AS (SELECT event_id, user_id, (hour(ts) * 60 + minute(ts))::INT AS now_min FROM events),
t AS (SELECT DISTINCT user_id, (user_id * 37) % 1440 AS m FROM events)
SELECT event_id, m::INT AS scheduled_min FROM w JOIN t USING (user_id) WHERE ((m - now_min + 5 + 1440) % 1440) - 5 <= 30""")
def stream_due_medications(spark, d):
    folder = work_folder(spark)
    users = table(spark, d, "events").select(F.col("user_id").alias("nickname")).distinct()
    m = (F.col("nickname") * 37) % 1440
    meds = users.select("nickname", F.lit("med").alias("name"), F.lit(True).alias("is_active"),
                        F.array(F.format_string("%02d:%02d", F.floor(m / 60), m % 60)).alias("times"))
    ticks = stream_of(spark, d, "events").select("event_id", F.col("user_id").alias("nickname"), "ts")
    streams.reminder_checks(ticks, meds, f"{folder}/due", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/due").select("event_id", "scheduled_min")


@query("stream_activity_windows", """
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n
FROM events GROUP BY ALL""")
def stream_activity_windows(spark, d):
    events = stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = streams.activity_windows(closed(spark, events.select("ts", "event_type"), "ts"))
    return _run(spark, counts).select(
        F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


#: Kinds of events after which a user is taken to be gone sooner or later than after others.
GAPS = {"error": "20 minutes", "view": "2 hours", "purchase": "6 hours", "signup": "12 hours"}
GAP = "45 minutes"
_GAPS = " ".join(f"WHEN '{k}' THEN INTERVAL '{v}'" for k, v in GAPS.items())


@query("stream_activity_sessions", f"""
WITH e AS (SELECT user_id, ts, event_type, ts + CASE event_type {_GAPS} ELSE INTERVAL '{GAP}' END AS open_until FROM events WHERE ts IS NOT NULL),
o AS (SELECT *, max(open_until) OVER (PARTITION BY user_id ORDER BY ts, open_until, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, open_until, event_type ROWS UNBOUNDED PRECEDING) AS number FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(open_until), '%Y-%m-%d %H:%M:%S.%f') AS "end",
  strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_time, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_purchase,
  count(*) FILTER (event_type = 'error') AS n_error FROM s GROUP BY user_id, number""")
def stream_activity_sessions(spark, d):
    events = stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts", "event_type")
    found = _run(spark, streams.activity_sessions(closed(spark, events, "ts"), GAPS, GAP))
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("start", "end", "last_time")]
    return found.select("user_id", *shown, "n", "n_purchase", "n_error")
