"""Readers and decoders of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careline.functions.core import nz
from careline.functions.text import kst, scrub_newlines

MESSAGE = "struct<type:string,data:struct<content:string>>"
# Columns of the exports.
HISTORY_FIELDS = ["id", "nickname", "role", "content"]
LOG_FIELDS = [
    "id", "nickname", "created_at_kst", "intent", "intent_confidence", "risk_level",
    "detected_symptoms", "risk_categories", "repeated_question", "topic_drifted",
    "user_message", "ai_message",
]
LOG_SCHEMA = (
    "id bigint, nickname string, user_message string, ai_message string, intent string, "
    "intent_confidence float, risk_level string, detected_symptoms array<string>, "
    "risk_categories array<string>, repeated_question boolean, topic_drifted boolean, "
    "created_at timestamp"
)


TEXT_TABLES = ("documents", "pages", "conversations")
#: A text table of at most so many bytes is dealt out over the cores when it is read.
DEALT_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the splits that the session's file settings give.

    A small text table is often one row group and so one task; as its operators cost far more
    than an exchange of that bounded size, it is dealt out. Larger ones never are. The size comes
    from the plan's statistics; no file names are listed.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES and int(str(
            df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= DEALT_BYTES:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def decode_chat_history(raw: DataFrame, nickname: str | None = None, newline: str = "\r",
                        ordered: bool = False) -> DataFrame:
    """JSON messages as role and text. A message that is no JSON gives empty fields.

    The user filter sits on the scan. ``ordered`` adds the order by id for an export.
    """
    rows = raw if nickname is None else raw.filter(F.col("session_id") == nickname)
    msg = F.from_json("message", MESSAGE, {"mode": "PERMISSIVE"})
    kind = nz(F.col("_m.type"))
    out = rows.withColumn("_m", msg).select(
        "id", F.col("session_id").alias("nickname"),
        F.when(kind == "human", "user").when(kind == "ai", "assistant").otherwise(kind)
        .alias("role"),
        scrub_newlines(F.col("_m.data.content"), newline).alias("content"))
    return out.orderBy("id") if ordered else out


def read_conversation_logs(logs: DataFrame, nickname: str | None = None, newline: str = "\r",
                           ordered: bool = False) -> DataFrame:
    """Log rows with defaults for nulls and the local time as text."""
    rows = logs if nickname is None else logs.filter(F.col("nickname") == nickname)
    if ordered:
        rows = rows.orderBy("created_at", "id")

    def listed(c: str) -> Column:
        return F.coalesce(F.to_json(c), F.lit("[]")).alias(c)

    return rows.select(
        "id", "nickname",
        nz(F.date_format(kst("created_at"), "yyyy-MM-dd HH:mm:ss")).alias("created_at_kst"),
        nz("intent").alias("intent"), "intent_confidence", nz("risk_level").alias("risk_level"),
        listed("detected_symptoms"), listed("risk_categories"), "repeated_question",
        "topic_drifted", scrub_newlines("user_message", newline).alias("user_message"),
        scrub_newlines("ai_message", newline).alias("ai_message"))


def latest_rows(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """Last ``limit`` rows of an order, oldest first, with total and shown counts.

    The top rows are found per task and merged; the count is a separate aggregate.
    """
    last = df.orderBy(*[F.col(c).desc() for c in order]).limit(limit)
    counts = df.agg(F.count("*").alias("total")).select(
        "total", F.least("total", F.lit(limit)).alias("shown"))
    return last.join(F.broadcast(counts)).orderBy(*order)


def attach_metadata(docs: Column, metas: Column) -> Column:
    """Documents and metadata zipped by place; missing metadata is an empty map."""
    return F.transform(docs, lambda d, i: F.struct(
        d.alias("text"),
        F.coalesce(F.get(metas, i), F.create_map().cast("map<string,string>")).alias("metadata")))
