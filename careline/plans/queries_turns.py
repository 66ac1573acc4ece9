"""Queries of turn-sequence operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from careline.functions import text as T
from careline.operators import reports as R
from careline.operators import turns as O
from careline.plans.korean import KO, korean_turns
from careline.plans.queries_text import sql_stems, sql_topic
from careline.plans.registry import WS, q, query, sql_any, sql_count, sql_replace, sql_strip
from careline.rules import dialogue, medical
from careline.sources.tables import table


def _turns(spark, d):
    return table(spark, d, "conversations")


# Same-role neighbours never occur in the table, so speakers are also merged by event type.

@query("merged_turns", """
WITH k AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations
           WHERE length(text) >= 3),
g AS (SELECT *, sum((p IS NULL OR p <> role)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM k)
SELECT conv_id, (run - 1)::BIGINT AS turn, any_value(role) AS role,
  string_agg(text, ' ' ORDER BY turn) AS text, count(*) AS n_messages FROM g GROUP BY conv_id, run""")
def merged_turns(spark, d):
    return O.merge_same_role(_turns(spark, d))


def _event_turns(spark, d):
    """Events as turns of a user: kind as role, id as text; order by time."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"),
        F.when(F.col("event_type").isin("click", "view"), "user").otherwise("assistant").alias("role"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("event_id")).alias("text"))


_EVENT_TURNS = """et AS (SELECT user_id AS conv_id, event_id AS turn,
  CASE WHEN event_type IN ('click', 'view') THEN 'user' ELSE 'assistant' END AS role,
  event_type || ' ' || event_id::VARCHAR AS text FROM events)"""
_EVENT_RUNS = f"""WITH {_EVENT_TURNS},
k AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM et),
g AS (SELECT *, sum((p IS NULL OR p <> role)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM k),
m AS (SELECT conv_id, run, any_value(role) AS role, string_agg(text, ' ' ORDER BY turn) AS text,
      count(*) AS n_messages FROM g GROUP BY conv_id, run)"""


@query("merged_event_runs", f"""{_EVENT_RUNS}
SELECT conv_id, (run - 1)::BIGINT AS turn, role, text, n_messages FROM m""")
def merged_event_runs(spark, d):
    return O.merge_same_role(_event_turns(spark, d))


@query("clean_dialogues", f"""{_EVENT_RUNS},
b AS (SELECT conv_id, min(run) FILTER (role = 'user') AS s, max(run) FILTER (role = 'assistant') AS e
      FROM m GROUP BY conv_id)
SELECT conv_id, (run - s)::BIGINT AS turn, role, text FROM m JOIN b USING (conv_id) WHERE s < e AND run >= s""")
def clean_dialogues(spark, d):
    return O.clean_dialogues(_event_turns(spark, d))


@query("user_first_turns", """
SELECT c.conv_id, turn, role FROM conversations c JOIN (SELECT conv_id, min(turn) AS s
  FROM conversations WHERE role = 'user' GROUP BY conv_id) USING (conv_id) WHERE turn >= s""")
def user_first_turns(spark, d):
    return O.trim_leading_non_user(_turns(spark, d).select("conv_id", "turn", "role"))


@query("valid_conversations", """
SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user,
  count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system
FROM conversations GROUP BY conv_id HAVING count(*) >= 3 AND n_user > 0 AND n_assistant > 0""")
def valid_conversations(spark, d):
    return O.valid_conversation(_turns(spark, d), min_turns=3)


_NEXT = """n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS assistant_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query("turn_pairs", f"""WITH {_NEXT} SELECT conv_id, turn, text AS user_text, assistant_text FROM n
WHERE role = 'user' AND nr = 'assistant'""")
def turn_pairs(spark, d):
    return O.user_assistant_pairs(_turns(spark, d))


SPARSE = 40_000


def _sparse(df):
    """Turns numbered with gaps, as by ids that all conversations share."""
    return df.withColumn("turn", F.col("turn") * SPARSE)


@query("turn_pairs_sparse", f"""WITH {_NEXT} SELECT conv_id, turn * {SPARSE} AS turn, text AS user_text, assistant_text
FROM n WHERE role = 'user' AND nr = 'assistant'""")
def turn_pairs_sparse(spark, d):
    return O.user_assistant_pairs(_sparse(_turns(spark, d)))


@query("instruction_samples", f"""WITH {_NEXT}
SELECT conv_id, turn, {q(dialogue.INSTRUCTION)} AS instruction, text AS input, assistant_text AS output
FROM n WHERE role = 'user' AND nr = 'assistant'""")
def instruction_samples(spark, d):
    return O.instruction_samples(O.user_assistant_pairs(_turns(spark, d)))


_PAIRS = """pr AS (SELECT u.conv_id, u.turn // 2 AS pair, u.text AS user_text, a.text AS assistant_text
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.turn % 2 = 0 AND u.role = 'user' AND a.role = 'assistant'),
np AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pair) - 1 AS p,
       count(*) OVER (PARTITION BY conv_id) AS n FROM pr)"""


@query("even_pairs", f"WITH {_PAIRS} SELECT conv_id, pair, user_text, assistant_text FROM pr")
def even_pairs(spark, d):
    return O.pair_by_even_index(_turns(spark, d))


def _numbered(spark, d):
    return O.number_pairs(O.pair_by_even_index(_turns(spark, d)))


@query("sliding_pair_windows", f"""WITH {_PAIRS},
w AS (SELECT *, unnest(range(greatest(p - 1, 0), least(p, greatest(n - 2, 0)) + 1)) AS start FROM np)
SELECT conv_id, start, p - start AS i, n, user_text, assistant_text FROM w""")
def sliding_pair_windows(spark, d):
    return O.sliding_pairs(_numbered(spark, d), 2).select(
        "conv_id", "start", "i", "n", "user_text", "assistant_text")


@query("augmented_windows", f"""WITH {_PAIRS},
s AS (SELECT conv_id, -1 AS start, p AS i, user_text FROM np
  UNION ALL SELECT conv_id, start, p - start AS i, user_text FROM (
    SELECT *, unnest(range(greatest(p - 1, 1), least(p, n - 2) + 1)) AS start FROM np WHERE n >= 3))
SELECT conv_id, start::BIGINT AS start, i, user_text FROM s""")
def augmented_windows(spark, d):
    return O.augment_windows(_numbered(spark, d), 2).select("conv_id", "start", "i", "user_text")


@query("overlap_chunks", """
WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
s AS (SELECT *, CASE WHEN n <= 4 THEN 0 ELSE unnest(range(0, n, 2)) END AS start FROM c),
k AS (SELECT *, turn - start AS i FROM s WHERE n <= 4 OR (turn >= start AND turn < start + 4)),
o AS (SELECT DISTINCT conv_id, start FROM k WHERE n <= 4 OR (i = 0 AND role = 'user'))
SELECT DISTINCT conv_id, start::BIGINT AS start, i, role, text FROM k JOIN o USING (conv_id, start)""")
def overlap_chunks(spark, d):
    return O.overlap_chunks(_turns(spark, d), max_turns=4).select(
        "conv_id", "start", "i", "role", "text")


@query("combined_singles", f"""WITH {_PAIRS},
t AS (SELECT conv_id, ['잠 이야기', '약_복용', '식사'][conv_id % 3 + 1] AS topic FROM np WHERE n = 1),
h AS (SELECT *, split_part(split_part(topic, '_', 1), ' ', 1) AS topic_key, md5(conv_id::VARCHAR || '42') AS h FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_key ORDER BY h, conv_id) - 1 AS rn FROM h),
g AS (SELECT *, rn // 3 AS grp, rn % 3 AS i, count(*) OVER (PARTITION BY topic_key, rn // 3) AS m FROM r)
SELECT topic_key, grp, i, conv_id, topic_key || '_합성' AS topic FROM g WHERE m >= 2""")
def combined_singles(spark, d):
    topic = F.get(F.array(F.lit("잠 이야기"), F.lit("약_복용"), F.lit("식사")), F.expr("int(conv_id % 3)"))
    singles = _numbered(spark, d).filter("n = 1").select("conv_id", topic.alias("topic"))
    return O.combine_singles(singles).select(
        "topic_key", "grp", "i", "conv_id",
        F.concat("topic_key", F.lit(dialogue.COMBINED_SUFFIX)).alias("topic"))


def _sql_clean(text: str) -> str:
    squeezed = sql_replace(text, [(dialogue.STRAY_LETTERS, ""), (WS + "+", " ")])
    return sql_strip(sql_replace(sql_strip(squeezed), [
        (p, "") for p in [*dialogue.PLACEHOLDERS_V2, dialogue.MARKERS]]))


_SAMPLES = f"""WITH m AS (SELECT conv_id, turn, role, {_sql_clean('text')} AS c FROM conversations WHERE role <> 'system'),
k AS (SELECT * FROM m WHERE length(c) >= 3),
s AS (SELECT conv_id, count(*) AS n, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a,
  string_agg('<|im_start|>' || role || chr(10) || c || '<|im_end|>' || chr(10), '' ORDER BY turn) AS ml,
  string_agg('[|' || role || '|]' || CASE WHEN role = 'assistant' THEN '<think>' || chr(10) || '</think>' ELSE '' END
    || c || '[|endofturn|]' || chr(10), '' ORDER BY turn) AS ex, sum(length(c)) AS chars FROM k GROUP BY conv_id)"""


def _samples(spark, d):
    said = _turns(spark, d).filter("role <> 'system'")
    return O.chat_sample(said, ["conv_id"], "turn").filter(O.valid_sample(F.col("messages")))


@query("chat_samples", f"""{_SAMPLES}
SELECT conv_id, (n + 1)::INT AS n_messages,
  '<|im_start|>system' || chr(10) || {q(dialogue.SYSTEM_PROMPT)} || '<|im_end|>' || chr(10) || ml AS chatml,
  '[|system|]' || {q(dialogue.SYSTEM_PROMPT)} || '[|endofturn|]' || chr(10) || ex AS marked FROM s WHERE u AND a""")
def chat_samples(spark, d):
    return _samples(spark, d).select(
        "conv_id", F.size("messages").alias("n_messages"),
        T.render_chat("messages").alias("chatml"), T.render_chat("messages", "marked").alias("marked"))


@query("dataset_stats", f"""{_SAMPLES}
SELECT n::INT AS n_turns, count(*) AS n_samples,
  (sum(chars + {len(dialogue.SYSTEM_PROMPT)}) * 2.5)::DOUBLE AS est_tokens FROM s WHERE u AND a GROUP BY n""")
def dataset_stats(spark, d):
    return R.dataset_stats(_samples(spark, d))


@query("file_stats", """
WITH c AS (SELECT conv_id % 5 AS file, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT file, count(*) AS total, count(*) FILTER (n > 2) AS multi, count(*) FILTER (n = 2) AS single FROM c GROUP BY file""")
def file_stats(spark, d):
    convs = O.conversation_stats(_turns(spark, d)).withColumn("file", F.expr("conv_id % 5"))
    return R.file_stats(convs, "file")


@query("dialogue_samples", f"""
WITH g AS (SELECT conv_id, count(*) FILTER (role <> 'system') AS n,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (role <> 'system') AS said FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS id, (n + 1)::INT AS n_messages, {q(dialogue.CARE_PROMPT)} || chr(10) || chr(10)
  || {q(dialogue.PATIENT_LABEL)} || conv_id::VARCHAR AS system, said FROM g WHERE n > 0""")
def dialogue_samples(spark, d):
    speaker = F.expr("CASE role WHEN 'user' THEN '환자' WHEN 'assistant' THEN 'AI' ELSE '진행자' END")
    raw = _turns(spark, d).groupBy(F.col("conv_id").cast("string").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", speaker.alias("speaker"), "text"))).alias("dialogue")
    ).withColumn("patient_info", F.col("id"))
    said = F.transform(F.slice("messages", 2, F.size("messages")),
                       lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return O.dialogue_to_chat(raw).select(
        "id", F.size("messages").alias("n_messages"),
        F.get("messages", F.lit(0))["content"].alias("system"), F.array_join(said, "\n").alias("said"))


@query("train_valid_split", """
WITH c AS (SELECT DISTINCT conv_id FROM conversations),
r AS (SELECT conv_id, row_number() OVER (ORDER BY md5(conv_id::VARCHAR || '42'), conv_id) - 1 AS rn, count(*) OVER () AS n FROM c)
SELECT conv_id, CASE WHEN rn < floor(n * 0.85::DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM r""")
def train_valid_split(spark, d):
    return O.train_valid_split(_turns(spark, d).select("conv_id").distinct(), "conv_id")


@query("recent_turns", """
SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""")
def recent_turns(spark, d):
    return O.recent_turns(_turns(spark, d), n=2)


_CONTEXT = f"""{KO},
f AS (SELECT *, CASE WHEN role = 'user' THEN {sql_topic('text')} END AS topic,
   CASE WHEN role = 'user' THEN {sql_count('text', medical.GATE_WORDS)} END AS hits FROM ko),
h AS (SELECT *, count(*) FILTER (role = 'user') OVER w AS turn_count,
   list(topic) FILTER (role = 'user' AND topic <> '') OVER w AS topics,
   coalesce(max(hits) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS peak
   FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
stems AS (SELECT conv_id, turn, {sql_stems('text')} AS stems FROM ko WHERE role = 'user'),
rep AS (SELECT a.conv_id, a.turn FROM stems a JOIN stems b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 6
   WHERE least(len(a.stems), len(b.stems)) >= 3 AND len(list_intersect(a.stems, b.stems)) >= 3
     AND len(list_intersect(a.stems, b.stems)) / least(len(a.stems), len(b.stems)) >= 0.7 GROUP BY ALL),
ctx AS (SELECT h.conv_id, h.turn, role, text, turn_count::INT AS turn_count, coalesce(topics[-1], '') AS recent_topic,
   coalesce(list_reverse(topics), []) AS newest,
   {sql_any('text', medical.GATE_WORDS)} AND rep.turn IS NOT NULL AS repeated_question,
   len(coalesce(topics, [])) > 0 AND peak >= 2 AND NOT {sql_any('text', medical.GATE_WORDS)} AND length(text) > 15 AS topic_drifted
   FROM h LEFT JOIN rep ON h.conv_id = rep.conv_id AND h.turn = rep.turn)"""


@query("turn_context", f"""WITH {_CONTEXT}
SELECT conv_id, turn, turn_count, recent_topic, repeated_question, topic_drifted,
  array_to_string(list_filter(newest, lambda x, i: list_position(newest, x) = i), '|') AS previous_topics
FROM ctx WHERE role = 'user'""")
def turn_context(spark, d):
    return O.turn_context(korean_turns(_turns(spark, d))).filter("role = 'user'").select(
        "conv_id", "turn", "turn_count", "recent_topic", "repeated_question", "topic_drifted",
        F.array_join("previous_topics", "|").alias("previous_topics"))


@query("turn_context_sparse", f"""WITH {_CONTEXT}
SELECT conv_id, turn * {SPARSE} AS turn, turn_count, recent_topic, repeated_question, topic_drifted FROM ctx WHERE role = 'user'""")
def turn_context_sparse(spark, d):
    return O.turn_context(_sparse(korean_turns(_turns(spark, d)))).filter("role = 'user'").select(
        "conv_id", "turn", "turn_count", "recent_topic", "repeated_question", "topic_drifted")


_SUMMARIES = """s AS (SELECT conv_id, conv_id % 3 AS summarized_count FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id),
b AS (SELECT conv_id, count(*) // 2 AS pairs FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, pairs, coalesce(summarized_count, 0)::BIGINT AS summarized_count FROM b LEFT JOIN s USING (conv_id)),
v AS (SELECT *, pairs - summarized_count >= 2 AS due, summarized_count * 2 AS from_message,
   greatest(summarized_count, pairs - 1) * 2 AS to_message FROM u)"""


def _due(spark, d):
    done = _turns(spark, d).filter("conv_id % 2 = 0").select(
        "conv_id", F.expr("conv_id % 3").alias("summarized_count")).distinct()
    return O.due_summaries(_turns(spark, d), done, threshold=2, keep_last=1)


@query("due_summaries", f"WITH {_SUMMARIES} SELECT conv_id, pairs, summarized_count, due, from_message, to_message FROM v")
def due_summaries(spark, d):
    return _due(spark, d)


@query("turns_to_summarize", f"""WITH {_SUMMARIES}
SELECT c.conv_id, turn, role, text FROM conversations c JOIN v USING (conv_id) WHERE turn >= from_message AND turn < to_message""")
def turns_to_summarize(spark, d):
    return O.turns_to_summarize(_turns(spark, d), _due(spark, d))


@query("symptom_history", """
WITH u AS (SELECT user_id AS nickname, CASE WHEN event_type IN ('error', 'signup') THEN 0 ELSE 1 END AS part, ts, event_id FROM events)
SELECT nickname, event_id FROM u QUALIFY row_number() OVER (PARTITION BY nickname ORDER BY part DESC, ts DESC, event_id DESC) <= 50""")
def symptom_history(spark, d):
    from careline.operators.care import symptom_history as history

    rows = table(spark, d, "events").select(
        F.col("user_id").alias("nickname"), F.col("ts").alias("timestamp"), "event_id", "event_type")
    flagged = rows.filter(F.col("event_type").isin("error", "signup"))
    moods = rows.filter(~F.col("event_type").isin("error", "signup"))
    return history(flagged, moods).select("nickname", "event_id")


@query("prompts_and_expected", """
SELECT conv_id, arg_max(text, turn) FILTER (role = 'user') AS input, arg_min(text, turn) FILTER (role = 'assistant') AS expected
FROM conversations GROUP BY conv_id HAVING input IS NOT NULL AND expected IS NOT NULL""")
def prompts_and_expected(spark, d):
    return O.prompt_and_expected(_turns(spark, d))


# Capitalised words stand for names.
_NAME = "[A-Z][a-z]+"


@query("session_pseudonyms", f"""
WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, {q(_NAME)}, 0)) AS name,
   generate_subscripts(regexp_extract_all(text, {q(_NAME)}, 0), 1) - 1 AS start FROM conversations),
f AS (SELECT conv_id, name, count(*) AS n_mentions, min((turn, start)) AS first FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first, name) - 1 AS number FROM f)
SELECT conv_id, name, n_mentions, number, '[사용자' || chr((65 + number % 26)::INT) || ']' AS label FROM r""")
def session_pseudonyms(spark, d):
    names = _turns(spark, d).select("conv_id", "turn", F.posexplode(
        F.regexp_extract_all("text", F.lit(_NAME), F.lit(0))).alias("start", "name"))
    return O.session_pseudonyms(names).select("conv_id", "name", "n_mentions", "number", "label")
