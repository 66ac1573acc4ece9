"""Shapes of physical plans, and streams over several batches."""

import re

import pytest
from compare import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from careline.operators import turns as O
from careline.sources.tables import decode_chat_history, table
from careline.streaming import sessions, streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_cross_product(spark, name):
    if name.startswith("stream_"):
        pytest.skip("runs a stream")
    assert "CartesianProduct" not in plan(entry.queries()[name](spark, SMALL))


def test_one_exchange_for_the_whole_context(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    p = plan(O.turn_context(turns))
    assert p.count("Exchange") == 1 and p.count("Scan parquet") == 1
    sparse = turns.withColumn("turn", F.col("turn") * 10**9)  # more than a segment: numbered first
    assert plan(O.turn_context(sparse)).count("Exchange hashpartitioning") > 1


#: Scans of a table and exchanges, at most; the smallest tables are dealt out by one exchange more.
SHAPES = {"turn_pairs": (1, 2), "turn_context": (1, 2), "merged_event_runs": (1, 2), "intent_cascade": (1, 2), "analysed_turns": (1, 2),
          "rewritten_followups": (1, 2), "clean_dialogues": (2, 5), "line_dialogues": (1, 4), "vector_gap_match": (3, 3)}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_scans_and_exchanges(spark, name):
    p = plan(entry.queries()[name](spark, SMALL))
    scans, exchanges = p.count("FileScan parquet"), len(re.findall(r"Exchange (?:hash|range|RoundRobin|SinglePartition)", p))
    assert scans <= SHAPES[name][0] and exchanges <= SHAPES[name][1], (scans, exchanges)


def test_row_limits_go_below_the_exchange(spark):
    turns = spark.read.parquet(f"{SMALL}/conversations.parquet")
    p = plan(O.recent_turns(turns, n=2))
    assert p.count("WindowGroupLimit") == 2 and "Partial" in p


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    raw = spark.createDataFrame([(1, "u", "{}", "wide")], "id long, session_id string, message string, other string")
    raw.write.parquet(str(tmp_path / "h"))
    p = plan(decode_chat_history(spark.read.parquet(str(tmp_path / "h")), "u"))
    assert "EqualTo(session_id,u)" in p and "other" not in p


def test_only_small_tables_are_dealt_out(spark, monkeypatch):
    assert "RoundRobin" in plan(table(spark, SMALL, "conversations"))
    assert "Exchange" not in plan(table(spark, SMALL, "orders"))
    monkeypatch.setattr("careline.sources.tables.DEALT_BYTES", 1000)
    assert "Exchange" not in plan(table(spark, SMALL, "conversations"))


def test_session_state_lives_across_batches(spark, tmp_path):
    turns = table(spark, SMALL, "conversations").cache()
    timed = turns.selectExpr("timestamp_seconds(1000000 + turn) AS at", "*")
    end = spark.range(1).selectExpr("timestamp'2250-01-01' AS at", *[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in turns.schema])
    source, steps = str(tmp_path / "in"), [timed.filter("turn < 2"), timed.filter("turn >= 2").unionByName(end)]
    for step in steps:
        step.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(timed.schema).parquet(source)
        out = streams.run_to_files(sessions.session_context(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    columns = ["conv_id", "turn", "turn_count", "recent_topic", "previous_topics", "repeated_question", "topic_drifted"]
    want, have = O.turn_context(turns).select(columns), out.select(columns)
    assert want.exceptAll(have).count() == 0 and have.count() == turns.count()


def test_dual_sink_writes_the_other_sink_on_failure(spark, tmp_path):
    turns = spark.readStream.schema(table(spark, SMALL, "conversations").schema).option(
        "pathGlobFilter", "conversations.parquet").parquet(SMALL)

    def broken(batch):
        raise RuntimeError("no history")

    q = streams.dual_sink(turns, str(tmp_path / "h"), str(tmp_path / "l"), str(tmp_path / "s"),
                          log_row=lambda b: b, history_row=broken)
    with pytest.raises(Exception, match="no history"):
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "l")).count() == table(spark, SMALL, "conversations").count()
    fixed = streams.dual_sink(turns, str(tmp_path / "h"), str(tmp_path / "l"), str(tmp_path / "s"),
                              log_row=lambda b: b, history_row=lambda b: b.select(F.col("turn")))
    fixed.awaitTermination()
    n = table(spark, SMALL, "conversations").count()
    assert spark.read.parquet(str(tmp_path / "l")).count() == n == spark.read.parquet(str(tmp_path / "h")).count()
