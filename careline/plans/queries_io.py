"""Sinks and sources: what is written to a new folder and read again."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from careline.operators import upserts as U
from careline.plans.registry import query
from careline.sources import files
from careline.sources.scratch import work_folder
from careline.sources.tables import table


@query("jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    path = f"{work_folder(spark, 'io')}/turns"
    files.write_jsonl(turns, path)
    return files.read_jsonl(spark, path, turns.schema)


@query("dialogue_files", """
WITH t AS (SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id::VARCHAR AS id, i, role AS speaker, text FROM t""")
def dialogue_files(spark, d):
    """Conversations as raw dialogues, even ones under the older names of the fields."""
    turn = F.struct(F.col("turn").alias("n"), "role", "text")
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("all"))
    old = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    new = F.transform("all", lambda t: F.struct(t["role"].alias("speaker"), t["text"].alias("text")))
    even = F.col("conv_id") % 2 == 0
    path = f"{work_folder(spark, 'io')}/dialogues"
    files.write_jsonl(lists.select(F.col("conv_id").cast("string").alias("id"), F.when(even, old).alias("turns"),
                                   F.when(~even, new).alias("dialogue")), path)
    return files.read_dialogues(spark, path).select("id", F.posexplode("dialogue").alias("i", "t")).select(
        "id", F.col("i").cast("bigint").alias("i"), "t.speaker", "t.text")


@query("csv_export", """
SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type, props, NULL::VARCHAR AS note FROM events""")
def csv_export(spark, d):
    """All events as CSV, with a column that they do not have, read again with their header."""
    columns = ["event_id", "user_id", "event_type", "props", "note"]
    path = files.export_csv(table(spark, d, "events"), work_folder(spark, "io"), "events", columns, now=datetime(2024, 6, 1))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert back.columns[0].lstrip("\ufeff") == columns[0], back.columns
    return back.toDF(*columns).withColumn("note", F.when(F.col("note") != "", F.col("note")))


@query("refreshed_corpus", "SELECT doc_id, lang, text FROM documents WHERE lang IN ('de', 'fr')")
def refreshed_corpus(spark, d):
    """One language stored, replaced by another, and a third one added."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    path = f"{work_folder(spark, 'io')}/corpus"
    for lang, replace in (("en", True), ("de", True), ("fr", False)):
        files.refresh_corpus(docs.filter(F.col("lang") == lang), path, replace)
    return spark.read.parquet(path)


@query("eval_report", """
SELECT 'trial' AS part, o_orderpriority AS name, o_orderkey AS n FROM orders
UNION ALL SELECT 'summary', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def eval_report(spark, d):
    trials = table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("n"))
    path = f"{work_folder(spark, 'io')}/report"
    files.write_eval_report(trials.groupBy("name").agg(F.count("*").alias("n")), trials, path)
    schema = "name string, n bigint"
    return files.read_jsonl(spark, f"{path}/trials", schema).select(F.lit("trial").alias("part"), "name", "n").unionByName(
        files.read_jsonl(spark, f"{path}/summary", schema).select(F.lit("summary").alias("part"), "name", "n"))


@query("added_columns", "SELECT c_custkey, c_name, NULL::VARCHAR AS note, NULL::BIGINT AS visits FROM customer")
def added_columns(spark, d):
    """A table of an older schema as one of the newer."""
    newer = StructType.fromDDL("c_custkey bigint, c_name string, note string, visits bigint")
    old = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name")
    return U.ensure_columns(old, newer)
