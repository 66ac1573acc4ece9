"""Queries of cleaning, splitting and formatting operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from careline.functions import chunks as C
from careline.functions import text as T
from careline.functions.core import strings
from careline.operators import care as care_ops
from careline.operators import transcripts as TR
from careline.plans.korean import KO, korean_turns
from careline.plans.registry import WS, arr, q, query, sql_any, sql_replace, sql_strip
from careline.rules import care, dialogue, intents, medical
from careline.sources import tables as S

table = S.table


# ---- cleaning ----------------------------------------------------------------------

def _sql_clean(text: str, holders) -> str:
    squeezed = sql_replace(text, [(dialogue.STRAY_LETTERS, ""), (WS + "+", " ")])
    return sql_strip(sql_replace(sql_strip(squeezed), [(p, "") for p in [*holders,
                                                                         dialogue.MARKERS]]))


# Placeholders are put into the text by replacing marks that the table holds.
_NOISY = "concat(replace(text, '. ', '[검색 중] '), ' [약 종류 x] ㅋㅋ ??')"


@query("clean_documents", f"""
SELECT doc_id, {_sql_clean(_NOISY, dialogue.PLACEHOLDERS_V1)} AS clean_v1,
       {_sql_clean(_NOISY, dialogue.PLACEHOLDERS_V2)} AS clean_v2 FROM documents""")
def clean_documents(spark, d):
    noisy = F.concat(F.replace("text", F.lit(". "), F.lit("[검색 중] ")), F.lit(" [약 종류 x] ㅋㅋ ??"))
    return table(spark, d, "documents").select(
        "doc_id", T.clean_text(noisy, 1).alias("clean_v1"), T.clean_text(noisy, 2).alias("clean_v2"))


_ROLE = """CASE WHEN turn % 3 = 0 THEN '  ' || upper(role) || ' (밝은 톤)' WHEN turn % 3 = 1
THEN '건강관리사(' || role || ')' ELSE role || '-이용자' END"""


def _sql_role(raw: str, version: int) -> str:
    role = f"lower(trim({raw}))"
    if version == 2:
        role = f"trim(regexp_replace({role}, '\\([^)]*\\)', '', 'g'))"
    return (f"CASE WHEN {sql_any(role, dialogue.USER_ROLES)} THEN 'user' "
            f"WHEN {sql_any(role, dialogue.ASSISTANT_ROLES)} THEN 'assistant' "
            f"WHEN contains({role}, 'system') THEN 'system' ELSE {role} END")


@query("normalized_roles", f"""
SELECT conv_id, turn, {_sql_role(_ROLE, 1)} AS role_v1, {_sql_role(_ROLE, 2)} AS role_v2
FROM conversations""")
def normalized_roles(spark, d):
    raw = F.expr(_ROLE)
    return table(spark, d, "conversations").select(
        "conv_id", "turn", T.normalize_role(raw, 1).alias("role_v1"),
        T.normalize_role(raw, 2).alias("role_v2"))


@query("speaker_roles", """
WITH s AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN (CASE WHEN turn % 2 = 0 THEN '환자'
  ELSE 'patient' END) WHEN 'assistant' THEN 'AI' ELSE 'narrator' END AS speaker FROM conversations)
SELECT conv_id, turn, speaker, CASE WHEN speaker = 'AI' THEN 'assistant' ELSE 'user' END AS role
FROM s WHERE speaker <> 'narrator'""")
def speaker_roles(spark, d):
    speaker = F.expr("""CASE role WHEN 'user' THEN (CASE WHEN turn % 2 = 0 THEN '환자'
        ELSE 'patient' END) WHEN 'assistant' THEN 'AI' ELSE 'narrator' END""")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", speaker.alias("speaker"), T.speaker_role(speaker).alias("role")
    ).filter("role is not null")


@query("truncated_documents", f"""
WITH t AS (SELECT doc_id, {sql_strip('text')} AS s, substr(text, 1, 300) AS head_300
           FROM documents),
h AS (SELECT *, substr(s, 1, 240) AS head,
      regexp_extract(substr(s, 1, 240), '(?s)^(.*[.?!…\\n])', 1) AS upto FROM t)
SELECT doc_id, head_300, CASE WHEN length(s) <= 240 THEN s
  WHEN length(upto) - 1 >= 120 THEN upto ELSE head END AS spoken FROM h""")
def truncated_documents(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.truncate_chars("text", 300).alias("head_300"),
        T.truncate_at_sentence("text").alias("spoken"))


@query("collapsed_repeats")
def collapsed_repeats(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.collapse_repeats("text").alias("collapsed"))


_MODEL = """'<think>plan ' || role || '</think>: ' || text || '<|im_end|> <NAME>(' || role || ') <NAME> 후속 질문: end
user'"""


def _sql_artifacts() -> str:
    out = "substr(m, instr(m, '</think>') + 8)"
    for pattern, new in dialogue.ARTIFACTS:
        out = f"regexp_replace({out}, {q(pattern)}, {q(new.replace('$', chr(92)))}, 'g')"
    out = sql_strip(out)
    for pattern in dialogue.LEADING_ARTIFACTS:
        out = f"regexp_replace({out}, {q(pattern)}, '', 'g')"
    return sql_strip(out)


@query("model_artifacts", f"""
WITH raw AS (SELECT conv_id, turn, {_MODEL} AS m FROM conversations)
SELECT conv_id, turn, {_sql_artifacts()} AS answer FROM raw""")
def model_artifacts(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", T.strip_model_artifacts(F.expr(_MODEL)).alias("answer"))


_CONTACT = "text || ' 010-1234-' || lpad(cast(doc_id % 10000 as varchar(9)), 4, '0') || ' 900101-1234567'"
_WORD = r"[\p{L}\p{M}\p{N}_"


@query("anonymized_documents", f"""
SELECT doc_id, {sql_replace(_CONTACT, [
    ("01[0-9]-[0-9]{3,4}-[0-9]{4}", "[전화번호]"), ("[0-9]{6}-[0-9]{7}", "[주민번호]"),
    (_WORD + r".-]+@" + _WORD + r".-]+\.[\p{L}\p{M}\p{N}_]+", "[이메일]")])} AS shared
FROM documents""")
def anonymized_documents(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.anonymize_basic(F.expr(_CONTACT.replace("varchar(9)", "string"))).alias("shared"))


_QUOTED = "'\"' || replace(text, ', ', ' [') || '] end\"'"


@query("scrubbed_documents", f"""
SELECT doc_id, regexp_replace(regexp_replace({sql_strip(_QUOTED)}, '^"+|"+$', '', 'g'),
         '\\[([^\\]]+)\\]', '(\\1)', 'g') AS parens,
       {sql_strip("translate(text, chr(10), ' ')")} AS one_line FROM documents""")
def scrubbed_documents(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.bracket_to_paren(F.expr(_QUOTED)).alias("parens"),
        T.scrub_newlines("text", "\n").alias("one_line"))


@query("min_length_filter", """
SELECT role, count(*) AS n, count(*) FILTER (length(text) >= 50) AS n_long,
       count(*) FILTER (length(text) > 2) AS n_said FROM conversations
WHERE length(text) >= 3 GROUP BY role""")
def min_length_filter(spark, d):
    n = F.length("text")
    return table(spark, d, "conversations").filter(n >= 3).groupBy("role").agg(
        F.count("*").alias("n"), F.count_if(n >= 50).alias("n_long"), F.count_if(n > 2).alias("n_said"))


@query("script_lines", """
SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)),
  lambda x: regexp_matches(x, '[äöüß]')), chr(10)) AS german_lines FROM documents""")
def script_lines(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.script_filter("text", "[äöüß]").alias("german_lines"))


# ---- time --------------------------------------------------------------------------

def _sql_case(rows, default: str) -> str:
    whens = " ".join(f"WHEN h >= {a} AND h < {b} THEN {q(v)}" for a, b, v in rows)
    return f"CASE {whens} ELSE {q(default)} END"


@query("kst_times", f"""
WITH e AS (SELECT event_id, ts + INTERVAL 9 HOUR AS k FROM events),
h AS (SELECT *, hour(k) AS h FROM e)
SELECT event_id, strftime(k, '%Y년 %m월 %d일 ') || CASE WHEN h < 12 THEN '오전' ELSE '오후' END || ' '
    || (CASE WHEN h = 0 THEN 12 WHEN h > 12 THEN h - 12 ELSE h END)::VARCHAR || '시 '
    || strftime(k, '%M') || '분' AS spoken,
  strftime(k, '%H:%M') AS clock,
  {_sql_case(care.DAY_PARTS, care.DAY_PART_ELSE)} AS day_part,
  {_sql_case([(a, b, "/".join(t)) for a, b, t in care.SUGGESTIONS[:-1]],
             "/".join(care.SUGGESTIONS[-1][2]))} AS suggested FROM h""")
def kst_times(spark, d):
    hour = F.hour(T.kst("ts"))
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        "event_id", T.format_kst("ts").alias("spoken"), T.kst_clock("ts").alias("clock"),
        T.day_part(hour).alias("day_part"), F.array_join(T.suggestions(hour), "/").alias("suggested"))


@query("mood_log", """
SELECT event_id, 'mood_record' AS type, event_type AS mood,
  greatest(least(floor(value)::INT, 10), 1) AS energy_level,
  '기분: ' || event_type || ', 에너지: ' || floor(value)::INT::VARCHAR || '/10'
    || CASE WHEN event_type = 'error' THEN ', 메모: ' || props ELSE '' END AS text FROM events""")
def mood_log(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("nickname"), F.col("event_type").alias("mood"),
        F.floor("value").cast("int").alias("energy_level"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("notes"),
        F.col("ts").alias("timestamp"))
    return care_ops.mood_log(rows).select(
        F.col("nickname").alias("event_id"), "type", "mood", "energy_level", "text")


# ---- topics and stems ----------------------------------------------------------------

def _alt(terms) -> str:
    return "(" + "|".join(terms) + ")"


def sql_topic(text: str) -> str:
    found = (f"list_concat(regexp_extract_all({text}, {q(_alt(medical.TOPIC_NOUNS))}, 1), "
             f"regexp_extract_all({text}, {q(_alt(medical.TOPIC_VERBS))}, 1))")
    distinct = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"
    return (f"CASE WHEN len({found}) > 0 THEN array_to_string({distinct}, ' ') "
            f"ELSE {sql_strip(f'substr({text}, 1, 20)')} END")


def sql_stems(text: str) -> str:
    """Distinct stems in order of first appearance."""
    ending = "(" + "|".join(medical.STEM_SUFFIXES) + ")$"
    seen = (f"list_filter(regexp_extract_all({text}, '[가-힣]{{2,}}', 0), "
            f"lambda x: NOT list_contains({arr(medical.STEM_STOP_WORDS)}, x))")
    stems = (f"list_filter(list_transform({seen}, lambda x: regexp_replace(x, {q(ending)}, '')), "
             f"lambda x: length(x) >= 2)")
    return f"list_filter({stems}, lambda x, i: list_position({stems}, x) = i)"


@query("turn_topics", f"""
WITH {KO} SELECT conv_id, turn, {sql_topic('text')} AS topic,
  array_to_string({sql_stems('text')}, ' ') AS stems FROM ko WHERE role = 'user'""")
def turn_topics(spark, d):
    return korean_turns(table(spark, d, "conversations")).filter("role = 'user'").select(
        "conv_id", "turn", T.extract_topic("text").alias("topic"),
        F.array_join(T.content_stems("text"), " ").alias("stems"))


def _sql_rewrite() -> str:
    def rest(p, default=""):
        tail = f"regexp_extract(m, {q(p)}, 2)"
        return f"CASE WHEN {tail} = '' THEN {q(default)} ELSE {tail} END"

    I = intents
    return f"""CASE WHEN prev = '' THEN m
  WHEN regexp_matches(m, {q(I.REWRITE_HOW)}) THEN prev || ' ' || m
  WHEN regexp_matches(m, {q(I.REWRITE_SO)}) THEN prev || {q(I.REWRITE_ABOUT)} || {rest(I.REWRITE_SO, I.REWRITE_SO_DEFAULT)}
  WHEN regexp_matches(m, {q(I.REWRITE_MORE)}) THEN prev || {q(I.REWRITE_ON)} || {rest(I.REWRITE_MORE, I.REWRITE_MORE_DEFAULT)}
  WHEN regexp_matches(m, {q(I.REWRITE_YES)}) THEN prev || {q(I.REWRITE_MORE_TELL)}
  WHEN regexp_matches(m, {q(I.REWRITE_THAT)}) THEN {sql_strip(f"(CASE WHEN topic <> '' THEN topic ELSE prev END) || ' ' || {rest(I.REWRITE_THAT)}")}
  WHEN length(m) <= 10 AND NOT regexp_matches(m, {q(I.REWRITE_GREETING)}) THEN prev || ' ' || m
  ELSE m END"""


@query("rewritten_followups", f"""
WITH {KO}, w AS (SELECT conv_id, turn, role, {sql_strip('text')} AS m,
  coalesce(last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '') AS prev FROM ko),
t AS (SELECT *, {sql_topic('prev')} AS topic FROM w)
SELECT conv_id, turn, {_sql_rewrite()} AS rewritten FROM t WHERE role = 'user'""")
def rewritten_followups(spark, d):
    from careline.operators.turns import with_rewrites

    return with_rewrites(korean_turns(table(spark, d, "conversations"))).select(
        "conv_id", "turn", "rewritten")


# ---- sources -------------------------------------------------------------------------

@query("decoded_history", f"""
SELECT conv_id * 100 + turn AS id, conv_id::VARCHAR AS nickname,
  CASE WHEN turn % 7 = 6 THEN '' ELSE role END AS role,
  CASE WHEN turn % 7 = 6 THEN '' ELSE {sql_strip("translate(text, chr(10), ' ')")} END AS content
FROM conversations""")
def decoded_history(spark, d):
    kind = F.expr("CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' ELSE role END")
    message = F.when(F.expr("turn % 7 = 6"), F.lit("{broken")).otherwise(F.to_json(F.struct(
        kind.alias("type"), F.struct(F.col("text").alias("content")).alias("data"))))
    raw = table(spark, d, "conversations").select(
        F.expr("conv_id * 100 + turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"),
        message.alias("message"))
    return S.decode_chat_history(raw, newline="\n")


@query("conversation_logs", """
SELECT event_id AS id, user_id::VARCHAR AS nickname,
  strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') AS created_at_kst,
  CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS intent,
  CASE WHEN value > 10 THEN '["' || event_type || '"]' ELSE '[]' END AS detected_symptoms,
  props AS user_message FROM events""")
def conversation_logs(spark, d):
    logs = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("nickname"),
        F.concat(F.lit(" "), "props", F.lit("\r")).alias("user_message"), F.lit(None).cast("string").alias("ai_message"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("intent"),
        F.col("value").cast("float").alias("intent_confidence"), F.lit(None).cast("string").alias("risk_level"),
        F.when(F.col("value") > 10, F.array("event_type")).alias("detected_symptoms"),
        F.lit(None).cast("array<string>").alias("risk_categories"),
        F.lit(False).alias("repeated_question"), F.lit(False).alias("topic_drifted"),
        F.col("ts").cast("timestamp").alias("created_at"))
    return S.read_conversation_logs(logs).select(
        "id", "nickname", "created_at_kst", "intent", "detected_symptoms", "user_message")


@query("latest_rows", """
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type,
  (SELECT count(*) FROM events) AS total, 1000::BIGINT AS shown
FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)""")
def latest_rows(spark, d):
    out = S.latest_rows(table(spark, d, "events"), ["ts", "event_id"], 1000)
    return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_type",
                      "total", F.col("shown").cast("bigint").alias("shown"))


@query("added_documents", """
WITH p AS (SELECT page_id, url, string_split(html, '<p>') AS parts FROM pages),
e AS (SELECT page_id, url, unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS place FROM p)
SELECT page_id, place, text, CASE WHEN place = 0 THEN url END AS source,
  (place > 0)::INT = 0 AS has_metadata FROM e""")
def added_documents(spark, d):
    docs = F.split("html", "<p>", -1)
    metas = F.array(F.create_map(F.lit("source"), F.col("url")))
    return table(spark, d, "pages").select(
        "page_id", F.posexplode(S.attach_metadata(docs, metas)).alias("place", "x")).select(
        "page_id", F.col("place").cast("bigint").alias("place"), "x.text",
        F.try_element_at("x.metadata", F.lit("source")).alias("source"),
        (F.size("x.metadata") > 0).alias("has_metadata"))


# ---- chunks --------------------------------------------------------------------------

@query("doc_chunks", """
WITH n AS (SELECT doc_id, source, text, greatest(ceil((length(text) - 200) / 800.0)::INT - 1, 0) AS last
           FROM documents WHERE text <> ''),
c AS (SELECT doc_id, last, unnest(range(0, last + 1)) AS i, text FROM n),
s AS (SELECT doc_id, last, i, substr(text, i * 800 + 1, 1000) AS text FROM c)
SELECT doc_id::VARCHAR || '_' || i::VARCHAR AS chunk_id, doc_id::VARCHAR AS source,
  i::INT AS chunk_index, (last + 1)::INT AS total_chunks, 'healthcare_docs' AS category, text
FROM s WHERE regexp_replace(text, '^[\\s]+', '') <> ''""")
def doc_chunks(spark, d):
    return TR.explode_chunks(
        table(spark, d, "documents"), C.fixed_windows("text"), "doc_id").drop("file_path")


@query("recursive_chunks")
def recursive_chunks(spark, d):
    return TR.explode_chunks(
        table(spark, d, "documents"), C.recursive_chunk()("text"), "doc_id", prefix="hd_")


def _sql_pack(parts: str, limit: int, gap: int, keep_blank: bool) -> str:
    """Parts joined by blank lines into pieces up to a limit, one after another."""
    def emitted(cur: str, done: str) -> str:
        worth = f"{cur} <> ''" if keep_blank else f"{sql_strip(cur)} <> ''"
        return f"CASE WHEN {worth} THEN list_append({done}, {sql_strip(cur)}) ELSE {done} END"

    packed = f"""list_reduce(list_transform({parts}, lambda p: {{'cur': p, 'done': []::VARCHAR[]}}), lambda a, x:
      CASE WHEN length(a.cur) + length(x.cur) + {gap} > {limit} THEN {{'cur': x.cur, 'done': {emitted('a.cur', 'a.done')}}}
      ELSE {{'cur': CASE WHEN a.cur <> '' THEN a.cur || chr(10) || chr(10) || x.cur ELSE x.cur END, 'done': a.done}} END,
      {{'cur': '', 'done': []::VARCHAR[]}})"""
    return f"list_transform([{packed}], lambda r: {emitted('r.cur', 'r.done')})[1]"


def _sql_chunks(chunks: str) -> str:
    """Rows of ``explode_chunks`` from (doc_id, chunks)."""
    return f"""x AS (SELECT doc_id::VARCHAR AS source, len(chunks)::INT AS total_chunks, unnest(chunks) AS text,
  (generate_subscripts(chunks, 1) - 1)::INT AS chunk_index FROM {chunks})
SELECT source || '_' || chunk_index::VARCHAR AS chunk_id, text, source, NULL::VARCHAR AS file_path, chunk_index, total_chunks,
  'healthcare_docs' AS category FROM x WHERE {sql_strip('text')} <> ''"""


# Lines one after another: a rule, or a blank line behind more than 500 characters, ends a section.
@query("document_sections", f"""
WITH l AS (SELECT doc_id, string_split(replace(coalesce(text, ''), '.' || chr(10), '.' || chr(10) || chr(10)), chr(10)) AS lines FROM documents),
f AS (SELECT doc_id, list_reduce(list_transform(lines, lambda w: {{'cur': w, 'n': 0, 'done': []::VARCHAR[]}}), lambda a, x:
  CASE WHEN starts_with({sql_strip('x.cur')}, '---') OR ({sql_strip('x.cur')} = '' AND a.n > 0 AND length(a.cur) > 500)
    THEN {{'cur': '', 'n': 0, 'done': CASE WHEN a.n > 0 THEN list_append(a.done, a.cur) ELSE a.done END}}
    ELSE {{'cur': CASE WHEN a.n > 0 THEN a.cur || chr(10) || x.cur ELSE x.cur END, 'n': a.n + 1, 'done': a.done}} END,
  {{'cur': '', 'n': 0, 'done': []::VARCHAR[]}}) AS r FROM l),
s AS (SELECT doc_id, list_filter(list_transform(list_append(r.done, r.cur), lambda t: {sql_strip('t')}), lambda t: t <> '') AS sections FROM f),
p AS (SELECT doc_id, flatten(list_transform(sections, lambda t: CASE WHEN length(t) > 1000
  THEN {_sql_pack("string_split(t, chr(10) || chr(10))", 1000, 0, True)} ELSE [t] END)) AS chunks FROM s), {_sql_chunks('p')}""")
def document_sections(spark, d):
    return TR.explode_chunks(table(spark, d, "documents"), C.pack_paragraphs(
        C.section_split(F.replace("text", F.lit(".\n"), F.lit(".\n\n")))), "doc_id")


# Every line but the first is a numbered heading, so lines are what is merged.
@query("numbered_sections", f"""
WITH l AS (SELECT doc_id, string_split(replace(coalesce(text, ''), chr(10), chr(10) || '1. '), chr(10)) AS lines FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(lines, lambda w: {sql_strip('w')}), lambda w: w <> '') AS lines FROM l),
p AS (SELECT doc_id, {_sql_pack('lines', 8000, 2, False)} AS chunks FROM s), {_sql_chunks('p')} AND length(text) >= 50""")
def numbered_sections(spark, d):
    numbered = F.regexp_replace("text", "\n", "\n1. ")
    return TR.explode_chunks(
        table(spark, d, "documents"), C.numbered_split_merge(numbered), "doc_id").filter(
        F.length("text") >= 50)


@query("markdown_sections", """
WITH s AS (SELECT page_id, unnest(string_split(replace(html, '<p>', chr(10) || '## '), chr(10) || '## ')) AS text FROM pages)
SELECT page_id, text FROM s WHERE trim(text) <> ''""")
def markdown_sections(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(
        C.markdown_sections(F.replace("html", F.lit("<p>"), F.lit("\n## ")))).alias("text"))


_MARK = "chr(1)"


@query("sentences", f"""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?…])({WS}|$)', '\\1' || {_MARK} || '\\2', 'g'),
             '([0-9][.!?…])' || {_MARK}, '\\1', 'g') AS t FROM documents),
p AS (SELECT doc_id, string_split(t, {_MARK}) AS parts FROM m),
s AS (SELECT doc_id, parts[-1] AS tail, parts[1:-2] AS ended FROM p),
k AS (SELECT *, length(regexp_extract(tail, '(?s)^(.* )', 1)) - 1 AS cut_at FROM s),
a AS (SELECT doc_id, list_concat(ended, CASE WHEN length(tail) >= 80 AND cut_at >= 40
    THEN [substr(tail, 1, cut_at), substr(tail, cut_at + 1)] ELSE [tail] END) AS parts FROM k),
e AS (SELECT doc_id, {sql_strip('unnest(parts)')} AS sentence FROM a)
SELECT doc_id, sentence, count(*) AS n FROM e WHERE sentence <> '' GROUP BY ALL""")
def sentences(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.explode(C.sentences("text")).alias("sentence")).groupBy(
        "doc_id", "sentence").agg(F.count("*").alias("n"))


# Lines of a document as lines of a transcript: speaker by digest.
_LABELS = ["System 페르소나: ", "User: ", "Assistant: ", "고령자 : ", "Agent：", "note "]


def _labelled() -> F.Column:
    labels = strings(_LABELS)
    return F.array_join(F.transform(F.split("text", "\n", -1), lambda w: F.concat(
        F.get(labels, F.pmod(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"), F.lit(len(_LABELS)))),
        F.lit('"'), w, F.lit('" [ok]'))), "\n")


@query("line_dialogues", f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS w FROM l),
k AS (SELECT *, ('0x' || substr(md5(w), 1, 4))::INT % {len(_LABELS)} AS s FROM e),
r AS (SELECT *, {sql_strip("({})[s + 1] || '\"' || w || '\" [ok]'".format(arr(_LABELS)))} AS line FROM k),
x AS (SELECT *, regexp_extract(line, '^(User|고령자|이용자){WS}*[:：]{WS}*(.+)', 2) AS u,
  regexp_extract(line, '^(Assistant|Agent|상담사){WS}*[:：]{WS}*(.+)', 2) AS a FROM r),
y AS (SELECT doc_id, i, s, CASE WHEN s = 0 THEN NULL WHEN u <> '' THEN 'user' WHEN a <> '' THEN 'assistant' END AS role,
  CASE WHEN u <> '' THEN regexp_replace({sql_strip('u')}, '^"+|"+$', '', 'g')
   ELSE regexp_replace(regexp_replace({sql_strip('a')}, '^"+|"+$', '', 'g'), '\\[([^\\]]+)\\]', '(\\1)', 'g') END AS text FROM x),
z AS (SELECT *, sum((s = 0)::INT) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS conversation FROM y)
SELECT doc_id, conversation, conversation > 0 AS has_system, role, text,
  row_number() OVER (PARTITION BY doc_id, conversation ORDER BY i) - 1 AS turn
FROM z WHERE role IS NOT NULL AND text <> ''""")
def line_dialogues(spark, d):
    files = table(spark, d, "documents").select("doc_id", _labelled().alias("content"))
    return TR.line_dialogues(files, "doc_id", "content")


@query("transcript_turns")
def transcript_turns(spark, d):
    files = table(spark, d, "documents").select(
        F.concat(F.lit("/t/"), "source", F.lit(".txt")).alias("path"),
        F.concat(F.lit("<"), "source", F.lit(">\n"), _labelled()).alias("content"))
    return TR.transcript_turns(files)


