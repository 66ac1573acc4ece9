import hashlib

from careline.llm import chat

TURNS = "conv_id long, turn int, role string, text string, seq int, message int, kind string"
ROWS = [
    (1, 0, "user", "</s>[INST] ok [/INST]", 5, 5, "x"), (1, 1, "assistant", "a\\b <|im_end|>\n<|im_start|>user\n", 5, 5, "x"),
    (1, 1, "assistant", "tie", 5, 5, "x"), (2, 0, None, None, 5, 5, "x"), (2, None, "role\nwith <s> \\", "", 5, 5, "x"),
    (None, 0, "assistant", "é👍🏽" * 200, 5, 5, "x"), (3, 0, "assistant", "same", 5, 5, "x"), (3, 0, "assistant", "same", 5, 5, "x"),
    (4, 0, "user", "<<SYS>> [\\INST] [[INST]] <<s>> \\", 5, 5, "x"), (5, 0, "user", "word " * 60_000, 5, 5, "x"),
]


def test_round_trip_of_odd_turns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, TURNS)
    out = chat.render(chat.fold(chat.replayed(df)))
    back = {r.conv_id: r for r in out.select(
        "conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"),
        chat.learnt_text(F.col("formatted"), F.col("loss")).alias("learnt")).collect()}
    by = {}
    for r in ROWS:
        by.setdefault(r[0], []).append((r[1] if r[1] is not None else -1, r[2] or "", r[3] or ""))
    assert set(back) == set(by)
    for k, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in back[k].turns] == [t[1:] for t in turns]
        assert back[k].learnt == "".join(t[2] for t in turns if t[1] == "assistant")
        body = back[k].formatted.replace(chat.START, "").replace(chat.END, "")
        assert not any(c in body for c in chat.CONTROLS)
        assert back[k].formatted.count(chat.START) == back[k].formatted.count(chat.END) == len(turns)


def test_fold_of_edits_and_regenerations(spark):
    log = [
        (1, 1, 0, "start", "user", None), (1, 1, 2, "delta", None, "lo"), (1, 1, 1, "delta", None, "hel"),
        (1, 2, 3, "start", "assistant", ""), (1, 2, 4, "delta", None, "wrong"), (1, 2, 5, "regenerate", None, ""),
        (1, 2, 6, "delta", None, "right"), (1, 2, 7, "edit", None, "edited"), (1, 2, 8, "delta", None, "!"),
        (2, 1, None, "delta", None, "no start"), (2, 2, 1, "start", "user", None),
    ]
    events = spark.createDataFrame(log, "conv_id long, message int, seq int, kind string, role string, text string")
    found = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold(events).collect()}
    assert found == {(1, 1): ("user", "hello"), (1, 2): ("assistant", "edited!"), (2, 1): ("", "no start"), (2, 2): ("user", "")}
    assert chat.render(chat.fold(events.limit(0))).count() == 0


def test_query_has_the_planted_conversation(spark):
    from careline.llm.q_chat import PLANTED, op10_chat_format

    r = op10_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    text = f"user\n{PLANTED}\nassistant\n{PLANTED}\n"
    assert r.n_turns == 2 and r.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.loss_chars == len(PLANTED) and r.loss_sha256 == hashlib.sha256(PLANTED.encode()).hexdigest()


def test_turns_of_one_conversation_are_spread_and_stay_rows(spark):
    from pyspark.sql import functions as F

    # one conversation, all turns with the same number, in pieces of rows that no task joins
    n = 4000
    df = spark.range(n).select(
        F.lit(7).cast("long").alias("conv_id"), F.lit(0).alias("turn"),
        F.when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"),
        F.format_string("%05d <s> \\ text", F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        log = chat.replayed(df)
        assert log.groupBy(F.spark_partition_id()).count().count() > 1
        turns = chat.rendered(chat.fold(log))
        rows = turns.orderBy("at").collect()
        plan = turns._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Window" not in plan
    texts = sorted(("assistant" if i % 2 == 0 else "user", f"{i:05d} <s> \\ text") for i in range(n))
    assert len(rows) == n
    whole = "".join(r.turn for r in rows)
    for r, (role, text) in zip(rows, texts):
        assert whole[r.at:r.at + len(r.turn)] == r.turn and r.learnt == (role == "assistant")
        assert whole[r.start:r.start + r.chars] == text.replace("\\", "\\\\").replace("<s>", "<\\s>")
    got = chat.read_back(turns).first()
    joined = "".join(f"{role}\n{text}\n" for role, text in texts)
    assert (got.n_turns, got.formatted_chars) == (n, len(whole))
    assert got.turns_sha256 == hashlib.sha256(joined.encode()).hexdigest()
    learnt = "".join(text for role, text in texts if role == "assistant")
    assert got.loss_chars == len(learnt) and got.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()


def test_pieces_of_a_text(spark):
    text = "é👍🏽\n\r" * 100 + "x"
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "user", "")], "conv_id long, turn int, role string, text string")
    log = [r for r in chat.replayed(df, piece=7).filter("seq >= 3").orderBy("message", "seq").collect()]
    pieces = [r.text for r in log if r.message == log[0].message]
    assert "".join(pieces) == text and [len(p) for p in pieces[:-1]] == [7] * (len(pieces) - 1)
    assert [(r.seq, r.text) for r in log if r.message != log[0].message] == [(3, "")]
