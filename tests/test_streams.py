"""Streams over folder tables and several batches; snapshots."""

import time
import uuid

import pytest
from compare import compare, connect
from compare import SMALL

import __spark_entry__ as entry
from careline.operators import turns as O
from careline.operators import upserts as U
from careline.sources import files
from careline.streaming import sessions, streams

STREAMS = sorted(n for n in entry.queries() if n.startswith("stream_"))


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The small tables as folders of part files."""
    root = tmp_path_factory.mktemp("folders")
    for name in ("conversations", "customer", "events"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(str(root / f"{name}.parquet"))
    return str(root)


@pytest.mark.parametrize("name", STREAMS)
def test_folder_tables_give_the_same_rows(spark, folders, name):
    assert compare(spark, connect(SMALL), entry.queries()[name], entry.oracle_sql()[name], folders) is None


def parts_of(spark, path, *parts):
    """Files that a stream reads one after another, and then a row far ahead in time."""
    schema = parts[0].schema
    at = next(f.name for f in schema if f.dataType.simpleString() == "timestamp")
    end = spark.range(1).selectExpr(*[f"timestamp'2250-01-01 00:00:00' AS {f.name}" if f.name == at
                                      else f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in schema])
    for part in (*parts, end):
        part.select(schema.names).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(0.02)  # files are read by time


def streamed(spark, path, schema, build, files=1):
    """The rows of a stream over the files of a folder, so many files a batch, and the folder of its state."""
    run = f"{path}/run-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
    return streams.run_to_files(build(stream), f"{run}/out", f"{run}/state"), f"{run}/state"


def state_rows(spark, checkpoint, name, **options):
    return spark.read.format("statestore").options(stateVarName=name, **options).load(checkpoint)


def clock(rows, order="turn"):
    return rows.selectExpr(f"timestamp_seconds(1000000 + {order}) AS at", "*")


@pytest.mark.parametrize("files", [1, 5])
@pytest.mark.parametrize("by", ["turn DIV 10", "turn % 4"])
def test_summaries_do_not_depend_on_batches(spark, tmp_path, files, by):
    """Rows in order, and rows that come a batch later than their successors but inside the lag of the watermark."""
    turns = clock(spark.range(40).selectExpr("1L AS conv_id", "id AS turn"))
    parts_of(spark, tmp_path, *[turns.filter(f"{by} = {i}") for i in range(4)])
    out, _ = streamed(spark, tmp_path, turns.schema, lambda df: sessions.summary_triggers(df, 10, 5, late="1 minute", bucket_ms=3000), files)
    assert sorted((r.pairs, r.from_message, r.to_message) for r in out.collect()) == [(10, 0, 10), (15, 10, 20), (20, 20, 30)]


@pytest.mark.parametrize("files", [1, 9])
def test_context_equals_its_batch_twin(spark, tmp_path, files):
    words = ["무릎 통증 약", "또 아파요", "어제 병원에 가서 무릎 통증 약을 받아 왔는데 밤에 잠이 안 와요", "네", "날씨가 참 좋네요 오늘은 산책을 다녀올까 합니다", "혈압 약"]
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", words[(c * 5 + t * t) % 6]) for c in range(4) for t in range(60)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(tuple(r) for r in O.turn_context(turns).select(
        "conv_id", "turn", "text", "turn_count", "recent_topic", "repeated_question", "topic_drifted").collect())
    timed = clock(turns)
    parts_of(spark, tmp_path, *[timed.filter(f"turn DIV 8 = {i}") for i in (1, 0, 3, 2, 5, 4, 7, 6)])
    out, state = streamed(spark, tmp_path, timed.schema, lambda df: sessions.session_context(df, late="1 minute", bucket_ms=5000), files)
    assert sorted(tuple(r) for r in out.select("conv_id", "turn", "text", "turn_count", "recent_topic", "repeated_question", "topic_drifted").collect()) == want
    kept = state_rows(spark, state, "past").groupBy("key").count().collect()
    assert {r["count"] for r in kept} == {sessions.HISTORY}  # state of a conversation is bounded
    assert state_rows(spark, state, "waiting").filter("key._key IS NOT NULL").count() == 0


@pytest.mark.parametrize("files", [1, 7])
def test_silence_ends_a_session(spark, tmp_path, files):
    rows = [(1, 0, True), (1, 30, True), (1, 90, False), (1, 151, True), (1, 152, True), (2, 0, False), (2, 61, False), (2, 140, True), (2, 10_000, True), (3, 20_000, False)]
    flags = clock(spark.createDataFrame(rows, "conv_id long, turn long, flag boolean"))
    parts_of(spark, tmp_path, *[flags.filter(f"turn BETWEEN {a} AND {b}") for a, b in ((0, 40), (41, 100), (101, 151), (152, 152), (153, 10_000), (10_001, 20_000))])
    out, state = streamed(spark, tmp_path, flags.schema, lambda df: sessions.once_per_session(df, late="1 second", bucket_ms=2000, keep_ms=60_000), files)
    assert sorted((r.conv_id, r.turn) for r in out.filter("referral").collect()) == [(1, 0), (1, 151), (2, 140), (2, 10_000)]
    assert out.count() == len(rows)
    if files == 1:  # timers have cleared what no row came to again; the last session ends with a batch to come
        assert state_rows(spark, state, "given").count() == 0
        assert [r.key._key for r in state_rows(spark, state, "until").collect()] == ["3"]


def test_names_expire_with_their_session(spark, tmp_path):
    rows = [(1, 0, 0, "Ann"), (1, 0, 9, "Bo"), (1, 5, 0, "Ann"), (1, 300, 0, "Bo"), (1, 301, 0, "Ann"), (2, 0, 0, "Bo"), (2, None, 1, "Cy"), (3, 9000, 0, "Di"), (4, 9900, 0, "Ed")]
    names = clock(spark.createDataFrame(rows, "conv_id long, turn long, start int, name string"))
    parts_of(spark, tmp_path, names.filter("turn < 100 OR turn IS NULL"), *[names.filter(f"conv_id = {c} AND turn > 100") for c in (1, 3, 4)])
    build = (lambda keep: lambda df: sessions.session_names(df, late="10 seconds", bucket_ms=1000, keep_ms=keep))
    for keep in (None, 60_000):
        out, state = streamed(spark, tmp_path, names.schema, build(keep))
        found = {(r.conv_id, r.turn, r.name): r.label[-2] for r in out.collect()}
        assert found[1, 0, "Ann"] == "A" and found[1, 0, "Bo"] == "B" and found[1, 5, "Ann"] == "A"
        assert found[1, 300, "Bo"] + found[1, 301, "Ann"] == ("BA" if keep is None else "AB")
        # a row without a time is the first of all, so of a session of its own
        assert (found[2, None, "Cy"], found[2, 0, "Bo"]) == (("A", "B") if keep is None else ("A", "A")) and len(found) == len(rows)
        kept = {r.user_map_key.name if "user_map_key" in r else r for r in state_rows(spark, state, "numbers", flattenCollectionTypes=True).collect()}
        assert kept == ({"Ann", "Bo", "Cy", "Di", "Ed"} if keep is None else {"Ed"})


def test_null_texts_do_not_stop_a_stream(spark, tmp_path):
    rows = clock(spark.createDataFrame([(1, 0, "user", "무릎 통증 약"), (1, 1, "assistant", "네"), (1, 2, "user", None), (None, 3, None, None)],
                                       "conv_id long, turn long, role string, text string"))
    parts_of(spark, tmp_path, rows)
    out, _ = streamed(spark, tmp_path, rows.schema, lambda df: sessions.session_context(df))
    assert out.count() == 4


def slow_sessions(rows, gaps, gap):
    """user, start, end, rows of sessions, one event at a time."""
    out = {}
    for user, at, kind in sorted(rows):
        until = at + gaps.get(kind, gap)
        mine = out.setdefault(user, [])
        if mine and at <= mine[-1][1]:
            mine[-1][1:] = [max(mine[-1][1], until), mine[-1][2] + 1]
        else:
            mine.append([at, until, 1])
    return sorted((u, *s) for u, mine in out.items() for s in mine)


@pytest.mark.parametrize("files", [1, 2, 5])
def test_session_windows_with_a_gap_per_kind(spark, tmp_path, files):
    rows = [(u, 24_000 + (u * 977 + i * i * 31) % 20_000 + (i // 9) * 400, "abc"[(i + u) % 3]) for u in range(5) for i in range(60)]
    rows += [(9, 24_000 + t, k) for t, k in ((100, "a"), (160, "a"), (219, "a"), (279, "b"), (280, "a"), (879, "c"), (909, "c"), (940, "c"))]
    rows += [(-1, 24_005, "a"), (-1, 24_050, "other")]
    gaps = {"a": 60, "b": 600}
    events = spark.createDataFrame(rows, "user_id long, s long, event_type string").selectExpr("user_id", "timestamp_seconds(s) AS ts", "event_type")
    parts_of(spark, tmp_path, *[events.filter(f"unix_seconds(ts) DIV 6000 = {i}") for i in range(4, 9)])
    out, _ = streamed(spark, tmp_path, events.schema, lambda df: streams.activity_sessions(
        df, {k: f"{v} seconds" for k, v in gaps.items()}, "30 seconds",
        late="1 hour"), files)
    got = sorted(out.selectExpr("user_id", "unix_seconds(start)", "unix_seconds(end)", "n").collect())
    assert [tuple(r) for r in got] == slow_sessions(rows, gaps, 30)


def test_late_rows_of_session_windows(spark, tmp_path):
    """A row behind the watermark is dropped; one that only comes after its successors joins two sessions to one."""
    def events(*at):
        return spark.createDataFrame([(1, t, "a") for t in at], "user_id long, s long, event_type string").selectExpr(
            "user_id", "timestamp_seconds(s) AS ts", "event_type")

    parts_of(spark, tmp_path, events(100_000, 100_100), events(100_050), events(200_000), events(201_000), events(100_120, 199_990))
    schema = events(1).schema
    out, _ = streamed(spark, tmp_path, schema, lambda df: streams.activity_sessions(df, {"a": "60 seconds"}, late="1 hour"))
    assert sorted((r.n, r.n_a) for r in out.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_gaps_in_turn_numbers_lose_nothing(spark):
    rows = spark.createDataFrame([(1, 65_500, "user", "무릎 통증"), (1, 65_600, "assistant", "네"), (1, 140_000, "user", "또 아파요"),
                                  (1, 10**12, "assistant", "병원")], "conv_id long, turn long, role string, text string")
    assert sorted(r.turn for r in O.user_assistant_pairs(rows).collect()) == [65_500, 140_000]
    assert {r.turn: r.turn_count for r in O.turn_context(rows).collect()} == {65_500: 0, 65_600: 1, 140_000: 1, 10**12: 2}
    assert {r.turn: r.last_user for r in O.with_rewrites(rows).collect()} == {65_500: None, 140_000: "무릎 통증"}


def test_upsert_write_read(spark, tmp_path):
    from pyspark.sql import functions as F

    schema = "nickname string, summary string, summarized_count int"
    old = spark.createDataFrame([("a", "x", 1)], schema).withColumn("created_at", F.lit("t")).withColumn("updated_at", F.lit("t"))
    new = spark.createDataFrame([("a", "y", 2), ("a", "z", 3), ("b", "n", 1), ("b", "n", 1), (None, "q", 9)], schema)
    root = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        files.read_snapshot(spark, root)
    files.write_snapshot(U.upsert_summaries(old, new, F.lit("now")), root, "001")
    (tmp_path / "s" / "version=002").mkdir()
    (tmp_path / "s" / "version=002" / "part-0.parquet").write_bytes(b"half")  # a lost job
    rows = {r.nickname: (r.summary, r.summarized_count) for r in files.read_snapshot(spark, root).collect()}
    assert rows == {"a": ("z", 3), "b": ("n", 1)}
    again = U.upsert_summaries(files.read_snapshot(spark, root), new.filter("nickname = 'b'"), F.lit("later"))
    files.write_snapshot(again, root, "002")
    assert files.snapshot_versions(spark, root) == ["001", "002"] and files.read_snapshot(spark, root).count() == 2
    with pytest.raises(FileExistsError):
        files.write_snapshot(again, root, "002")


def test_a_conversation_with_many_rows(spark, tmp_path):
    n = 5_000
    rows = clock(spark.range(n).selectExpr("CAST(1 AS BIGINT) AS conv_id", "(id * 7919) % 100003 AS turn", "(id * 7919) % 100003 > 50000 AS flag"))
    parts_of(spark, tmp_path, rows)
    out, _ = streamed(spark, tmp_path, rows.schema, lambda df: sessions.once_per_session(df))
    first = rows.filter("flag").agg({"turn": "min"}).first()[0]
    assert out.count() == n and [r.turn for r in out.filter("referral").collect()] == [first]
