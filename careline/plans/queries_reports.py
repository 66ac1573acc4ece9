"""Queries of reports, set operations and keyed writes."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from careline.functions import spans as SP
from careline.functions.core import strings, unpack
from careline.functions.lexicon import any_keyword
from careline.functions.text import content_stems, kst
from careline.operators import reports as R
from careline.operators import turns as O
from careline.operators import sketches as K
from careline.operators import upserts as U
from careline.operators.transcripts import merge_sources, nfc
from careline.plans.korean import KO, korean_turns
from careline.plans.queries_text import sql_stems
from careline.plans.registry import arr, q, query, sql_any, sql_count
from careline.rules import care, medical
from careline.sources.scratch import written
from careline.sources.tables import table


# ---- usage ---------------------------------------------------------------------------

@query("usage_summary", """
SELECT count(DISTINCT conv_id) AS n_users, count(*) FILTER (role = 'user') AS n_user_turns, count(*) AS n_messages FROM conversations""")
def usage_summary(spark, d):
    return R.usage_summary(table(spark, d, "conversations"))


@query("log_period", """
SELECT count(*) AS n_turns, min(strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d')) AS first_day,
  max(strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d')) AS last_day FROM events""")
def log_period(spark, d):
    return R.log_period(table(spark, d, "events"), kst(F.col("ts").cast("timestamp")))


@query("top_users", """
SELECT user_id, count(*) AS n_turns FROM events GROUP BY user_id ORDER BY n_turns DESC, user_id LIMIT 10""")
def top_users(spark, d):
    return R.top_users(table(spark, d, "events"), "user_id")


@query("store_stats", "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_sessions FROM orders")
def store_stats(spark, d):
    return R.store_stats(table(spark, d, "orders"), "o_custkey")


@query("event_distribution", """
SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 1)::DOUBLE AS percent FROM events GROUP BY event_type""")
def event_distribution(spark, d):
    return R.distribution(table(spark, d, "events"), "event_type")


# ---- detection quality -----------------------------------------------------------------

_MAIL, _TAIL, _NUM = r"[A-Za-z0-9_.-]+@[A-Za-z0-9_-]+\.[A-Za-z]+", r"@[A-Za-z0-9_-]+\.[A-Za-z]+", r"\d{3}-\d{4}"


@query("label_prf", f"""
WITH g AS (SELECT doc_id, k, unnest(regexp_extract_all(text, p, 0)) AS span, generate_subscripts(regexp_extract_all(text, p, 0), 1) AS gid
   FROM documents, (VALUES ('mail', {q(_MAIL)}), ('phone', {q(_NUM)})) v(k, p)),
f AS (SELECT doc_id, k, unnest(regexp_extract_all(text, p, 0)) AS found, generate_subscripts(regexp_extract_all(text, p, 0), 1) AS i
   FROM documents, (VALUES ('mail', {q(_TAIL)}), ('phone', {q("[0-9]{3,}")})) v(k, p)),
c AS (SELECT g.doc_id, g.k, gid, min(i) AS i FROM g JOIN f ON g.doc_id = f.doc_id AND g.k = f.k AND (contains(found, span) OR contains(span, found)) GROUP BY ALL),
t AS (SELECT k, (SELECT count(*) FROM c WHERE c.k = x.k) AS tp,
   (SELECT count(*) FROM f WHERE f.k = x.k) - (SELECT count(*) FROM (SELECT DISTINCT doc_id, i FROM c WHERE c.k = x.k)) AS fp,
   (SELECT count(*) FROM g WHERE g.k = x.k) - (SELECT count(*) FROM c WHERE c.k = x.k) AS fn FROM (VALUES ('mail'), ('phone')) x(k)),
a AS (SELECT k, tp, fp, fn FROM t UNION ALL SELECT NULL, sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM t),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS r FROM a)
SELECT k AS pii_type, tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1 FROM s""")
def label_prf(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "text")

    def spans(kind, pattern, text):
        rows = unpack(docs, ["case_id"], SP.pattern_spans("text", pattern), "start")
        return rows.select("case_id", F.lit(kind).alias("pii_type"), F.col("text").alias(text), "start")

    gold = spans("mail", _MAIL, "span").unionByName(spans("phone", _NUM, "span"))
    found = spans("mail", _TAIL, "text").unionByName(spans("phone", "[0-9]{3,}", "text"))
    return R.prf_by_type(gold, found)


_BAD = ["trash", "worthless", "pathetic", "idiot"]


@query("category_prf", f"""
WITH e AS (SELECT doc_id, unnest(list_filter([CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 1 THEN 'quality' END], lambda x: x IS NOT NULL)) AS category FROM labels),
f AS (SELECT doc_id, unnest(list_filter([CASE WHEN {sql_any('text', _BAD)} THEN 'toxic' END, CASE WHEN n_chars > 1000 THEN 'quality' END], lambda x: x IS NOT NULL)) AS category
   FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
j AS (SELECT coalesce(e.category, f.category) AS category, e.doc_id IS NOT NULL AS e, f.doc_id IS NOT NULL AS f FROM e FULL JOIN f ON e.doc_id = f.doc_id AND e.category = f.category),
t AS (SELECT category, count(*) FILTER (e AND f) AS tp, count(*) FILTER (NOT e) AS fp, count(*) FILTER (NOT f) AS fn FROM j GROUP BY ROLLUP (category)),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0::DOUBLE END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0::DOUBLE END AS r FROM t)
SELECT category, tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0::DOUBLE END AS f1 FROM s""")
def category_prf(spark, d):
    labels = table(spark, d, "labels")

    def named(toxic, quality):
        return F.explode(F.array_compact(F.array(F.when(toxic, "toxic"), F.when(quality, "quality"))))

    expected = labels.select(F.col("doc_id").alias("case_id"),
                             named(F.col("toxic") == 1, F.col("quality") == 1).alias("category"))
    detected = table(spark, d, "documents").join(labels.select("doc_id"), "doc_id", "left_semi").select(
        F.col("doc_id").alias("case_id"),
        named(any_keyword(F.col("text"), _BAD), F.col("n_chars") > 1000).alias("category"))
    return R.set_prf(expected, detected)


@query("level_accuracy", f"""
SELECT count(*) AS n_cases, avg(({sql_any('text', _BAD)}::INT >= toxic)::INT) AS level_accuracy, avg(n_chars) AS avg_latency_ms
FROM documents JOIN labels USING (doc_id)""")
def level_accuracy(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return R.level_accuracy(rows, any_keyword(F.col("text"), _BAD).cast("int"), F.col("toxic"), F.col("n_chars"))


# ---- response quality ------------------------------------------------------------------

def _sql_ends(text, suffixes):
    return "(" + " OR ".join(f"ends_with({text}, {q(s)})" for s in suffixes) + ")"


_QUALITY = f"""{KO}, a AS (SELECT conv_id, turn, text || CASE WHEN turn % 3 = 0 THEN ' 어떠세요?' ELSE '' END AS r, conv_id % 4 = 0 AS em FROM ko WHERE role = 'assistant'),
w AS (SELECT *, rtrim(r, ' ' || chr(10)) AS t FROM a),
sc AS (SELECT conv_id, turn, CASE WHEN length(r) BETWEEN 20 AND 300 THEN 1.0 WHEN length(r) < 20 THEN 0.3 ELSE 0.7 END::DOUBLE AS length,
  CASE WHEN {_sql_ends('t', care.HONORIFIC_ENDINGS)} THEN 1.0 ELSE 0.5 END::DOUBLE AS honorific,
  CASE WHEN {sql_any('r', care.EMPATHY_WORDS)} THEN 1.0 ELSE 0.0 END::DOUBLE AS empathy,
  CASE WHEN regexp_matches(r, {q(care.LIST_PATTERN)}) OR regexp_matches(r, {q(care.BOLD_PATTERN)}) OR regexp_matches(r, {q(care.NUMBERED_PATTERN)}) THEN 0.0 ELSE 1.0 END::DOUBLE AS no_list,
  CASE WHEN {sql_any('r', care.FORBIDDEN_PHRASES)} THEN 0.0 ELSE 1.0 END::DOUBLE AS no_forbidden,
  CASE WHEN em THEN (CASE WHEN contains(r, '119') THEN 1.0 ELSE 0.0 END)::DOUBLE END AS emergency_119,
  CASE WHEN {sql_any('r', care.INVASIVE_PHRASES)} THEN 0.0 ELSE 1.0 END::DOUBLE AS privacy,
  least(1.0, {sql_count('r', care.ADVICE_WORDS)} / 3.0)::DOUBLE AS specific_advice,
  CASE WHEN {_sql_ends('t', care.SOFT_ENDINGS)} THEN 1.0 ELSE 0.5 END::DOUBLE AS natural_ending FROM w),
qu AS (SELECT *, (length + honorific + empathy + no_list + no_forbidden + coalesce(emergency_119, 0) + privacy + specific_advice + natural_ending)
   / (8 + (emergency_119 IS NOT NULL)::INT) AS quality FROM sc)"""


def _scored(spark, d):
    said = korean_turns(table(spark, d, "conversations")).filter("role = 'assistant'").select(
        "conv_id", "turn", F.concat("text", F.when(F.expr("turn % 3 = 0"), " 어떠세요?").otherwise("")).alias("r"))
    intent = F.when(F.expr("conv_id % 4 = 0"), "emergency").otherwise("general_chat")
    return R.with_quality(said, F.col("r"), intent)


@query("response_quality", f"""WITH {_QUALITY} SELECT conv_id, turn, length, honorific, empathy, no_list, no_forbidden, emergency_119, privacy,
  round(specific_advice, 6) AS specific_advice, natural_ending, round(quality, 6) AS quality FROM qu""")
def response_quality(spark, d):
    return _scored(spark, d).drop("r").withColumn("quality", F.round("quality", 6)).withColumn(
        "specific_advice", F.round("specific_advice", 6))


_TRIALS = """tr AS (SELECT event_type AS topic, value / 40 AS base, (value + event_id % 7 - 3) / 40 AS ft, value AS bl, value * 2 AS fl FROM events)"""


def _trials(spark, d):
    return table(spark, d, "events").select(
        F.col("event_type").alias("topic"), (F.col("value") / 40).alias("base"),
        ((F.col("value") + F.expr("event_id % 7") - 3) / 40).alias("ft"),
        F.col("value").alias("bl"), (F.col("value") * 2).alias("fl"))


def _sql_compare(margin, keys=""):
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""s AS (SELECT {lead}count(*) AS n, round(avg(base), 6) AS base_mean, round(coalesce(stddev_samp(base), 0), 6) AS base_sd, round(avg(ft), 6) AS ft_mean,
  round(coalesce(stddev_samp(ft), 0), 6) AS ft_sd, count(*) FILTER (base > ft + {margin}::DOUBLE) AS base_wins, count(*) FILTER (ft > base + {margin}::DOUBLE) AS ft_wins,
  round(avg(bl), 6) AS base_latency, round(avg(fl), 6) AS ft_latency FROM tr {group})
SELECT *, n - base_wins - ft_wins AS ties, CASE WHEN ft_mean > base_mean + {margin}::DOUBLE THEN 'ft' WHEN base_mean > ft_mean + {margin}::DOUBLE THEN 'base' ELSE 'tie' END AS winner FROM s"""


@query("model_comparison", f"WITH {_TRIALS}, {_sql_compare(0.05)}")
def model_comparison(spark, d):
    return R.compare_models(_trials(spark, d), "base", "ft", care.HEURISTIC_MARGIN, latencies=("bl", "fl"))


@query("topic_comparison", f"WITH {_TRIALS}, {_sql_compare(0.3, 'topic')}")
def topic_comparison(spark, d):
    return R.compare_models(_trials(spark, d), "base", "ft", care.JUDGE_MARGIN, ["topic"], latencies=("bl", "fl"))


@query("criterion_comparison", f"""WITH {_TRIALS} SELECT criterion, round(avg(b), 6) AS base_mean, round(avg(f), 6) AS ft_mean, round(avg(f) - avg(b), 6) AS diff
FROM (SELECT 'score' AS criterion, base AS b, ft AS f FROM tr UNION ALL SELECT 'latency', bl, fl FROM tr) GROUP BY criterion""")
def criterion_comparison(spark, d):
    maps = _trials(spark, d).select(
        F.create_map(F.lit("score"), "base", F.lit("latency"), "bl", F.lit("only_base"), "bl").alias("b"),
        F.create_map(F.lit("score"), "ft", F.lit("latency"), "fl").alias("f"))
    return R.by_criterion(maps, "b", "f")


# ---- latency and errors ------------------------------------------------------------------

@query("latency_stats", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events),
k AS (SELECT *, round_even(0.5::DOUBLE * (n - 1), 0) AS k50, round_even(0.95::DOUBLE * (n - 1), 0) AS k95 FROM r)
SELECT event_type, count(*) AS n, max(value) FILTER (rn = k50) AS p50, max(value) FILTER (rn = k95) AS p95, max(value) AS max, round(avg(value), 6) AS avg
FROM k GROUP BY event_type""")
def latency_stats(spark, d):
    return R.latency_stats(table(spark, d, "events"), ["event_type"], "value")


@query("usage_sketches", """
SELECT event_type, min(day) AS first_day, max(day) AS last_day, count(*) AS n, count(DISTINCT user_id) AS n_users, min(value) AS least, max(value) AS most,
  round(avg(value), 6) AS mean FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) WHERE day BETWEEN '2024-01-05' AND '2024-01-20' GROUP BY event_type""")
def usage_sketches(spark, d):
    """Daily sketches of all events, written, and merged for a range of days."""
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    daily = written(K.daily_sketches(table(spark, d, "events"), day, ["event_type"], "user_id", "value"), "daily")
    return K.estimates(K.merged(daily, ["event_type"], F.lit("2024-01-05"), F.lit("2024-01-20"))).drop("p50", "p95")


_ERROR = "CASE WHEN event_type = 'error' THEN 'Code' || cast(floor(value / 10) as int) || ': ' || props END"


@query("error_kinds", f"""
SELECT split_part(error, ':', 1) AS kind, count(*) AS n FROM (SELECT {_ERROR} AS error FROM events) WHERE error IS NOT NULL GROUP BY 1""")
def error_kinds(spark, d):
    return R.error_kinds(table(spark, d, "events").select(F.expr(_ERROR).alias("error")))


@query("throughput", f"""
SELECT count(*) FILTER (error IS NULL) AS ok_turns, count(*) FILTER (error IS NOT NULL) AS failed_turns,
  round(count(*) FILTER (error IS NULL) / 60.0::DOUBLE, 6) AS turns_per_second FROM (SELECT {_ERROR} AS error FROM events)""")
def throughput(spark, d):
    return R.throughput(table(spark, d, "events").select(F.expr(_ERROR).alias("error")), F.lit(60.0))


@query("generation_metrics", """
WITH p AS (SELECT arg_max(text, turn) FILTER (role = 'user') AS g, arg_min(text, turn) FILTER (role = 'assistant') AS e FROM conversations GROUP BY conv_id)
SELECT count(*) AS num_samples, round(avg(length(g)), 6) AS avg_generated_length, round(avg(length(e)), 6) AS avg_expected_length,
  round(avg((contains(lower(g), 'erre') OR contains(lower(g), 'thing'))::INT), 6) AS keyword_match_rate FROM p WHERE g IS NOT NULL AND e IS NOT NULL""")
def generation_metrics(spark, d):
    pairs = O.prompt_and_expected(table(spark, d, "conversations"))
    return R.generation_metrics(pairs, F.col("input"), F.col("expected"), ["erre", "thing"])


# ---- sorts and sets ----------------------------------------------------------------------

@query("ordered_history", "SELECT event_id, user_id, event_type FROM events ORDER BY ts, event_id")
def ordered_history(spark, d):
    return table(spark, d, "events").orderBy("ts", "event_id").select("event_id", "user_id", "event_type")


@query("merged_sources", """
SELECT 'documents' AS category, source AS label, count(*) AS n FROM documents GROUP BY source
UNION ALL SELECT 'conversations', NULL, count(*) FROM conversations UNION ALL SELECT 'pages', NULL, count(*) FROM pages""")
def merged_sources(spark, d):
    docs = table(spark, d, "documents").select(F.lit("documents").alias("category"), F.col("source").alias("label"))
    rest = [table(spark, d, t).select(F.lit(t).alias("category")) for t in ("conversations", "pages")]
    return merge_sources([docs, *rest]).groupBy("category", "label").agg(F.count("*").alias("n"))


@query("stem_sets", f"""WITH {KO}, s AS (SELECT conv_id, turn, {sql_stems('text')} AS s FROM ko)
SELECT conv_id, turn, len(s)::INT AS n_stems, len(list_filter(s, lambda x: list_contains({arr(medical.GATE_WORDS)}, x)))::INT AS n_shared,
  len(list_filter(s, lambda x: NOT list_contains({arr(medical.GATE_WORDS)}, x)))::INT AS n_other FROM s""")
def stem_sets(spark, d):
    rows = korean_turns(table(spark, d, "conversations")).withColumn("s", content_stems("text"))
    gate = strings(medical.GATE_WORDS)
    return rows.select(
        "conv_id", "turn", F.size("s").alias("n_stems"), F.size(F.array_intersect("s", gate)).alias("n_shared"),
        F.size(F.array_except("s", gate)).alias("n_other"))


#: Letters of the tables in two characters each: the letter and its mark.
_LETTERS = [(c, unicodedata.normalize("NFD", c)) for c in "éèêçàáíóúñäöüÉÈÊÇÀÁÍÓÚÑÄÖÜ"]


def _sql_apart(text: str) -> str:
    for whole, parts in _LETTERS:
        text = f"replace({text}, '{whole}', '{parts}')"
    return text


@query("nfc_names", f"SELECT doc_id, nfc_normalize({_sql_apart('text')}) AS name, length({_sql_apart('text')}) > length(text) AS was_apart FROM documents")
def nfc_names(spark, d):
    """All texts with their letters taken apart and put together again."""
    apart = F.col("text")
    for whole, parts in _LETTERS:
        apart = F.replace(apart, F.lit(whole), F.lit(parts))
    docs = table(spark, d, "documents").select("doc_id", "text", apart.alias("apart"))
    return docs.select("doc_id", nfc("apart").alias("name"), (F.length("apart") > F.length("text")).alias("was_apart"))


# ---- keyed writes ------------------------------------------------------------------------

def _profiles(spark, d):
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("nickname"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("age"), F.col("c_mktsegment").alias("conditions"),
        F.lit(None).cast("string").alias("emergency_contact"), F.lit("old").alias("notes"),
        F.lit(True).alias("health_info_consent"), t0.alias("created_at"), t0.alias("updated_at"))


def _updates(spark, d):
    orders = table(spark, d, "orders")
    last = U.latest_by_key(orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"),
                           ["o_custkey"], ["o_orderkey"])
    s = F.col("o_orderstatus")
    return last.select(
        (F.col("o_custkey") + F.when(F.expr("o_custkey % 10 = 0"), 1_000_000_000).otherwise(0)).cast("string").alias("nickname"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("age"),
        F.when(s == "O", F.col("o_orderpriority")).alias("conditions"), F.col("o_orderpriority").alias("emergency_contact"),
        F.lit(None).cast("string").alias("notes"), F.lit(None).cast("boolean").alias("health_info_consent"),
        (s == "F").alias("clear_health_info"))


_UPDATES = """lo AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS st, arg_max(o_orderpriority, o_orderkey) AS pr FROM orders GROUP BY o_custkey),
u AS (SELECT (o_custkey + CASE WHEN o_custkey % 10 = 0 THEN 1000000000 ELSE 0 END)::VARCHAR AS nickname, st, pr FROM lo)"""


@query("profile_upsert", f"""WITH {_UPDATES}
SELECT coalesce(c_custkey::VARCHAR, u.nickname) AS nickname, c_name AS name, c_nationkey AS age,
  CASE WHEN st = 'F' AND c_custkey IS NOT NULL THEN NULL ELSE coalesce(CASE WHEN st = 'O' THEN pr END, c_mktsegment) END AS conditions,
  pr AS emergency_contact, CASE WHEN st = 'F' OR c_custkey IS NULL THEN NULL ELSE 'old' END AS notes,
  CASE WHEN c_custkey IS NULL THEN NULL ELSE true END AS health_info_consent,
  CASE WHEN c_custkey IS NULL THEN '2024-06-01' ELSE '2024-01-01' END AS created, CASE WHEN u.nickname IS NULL THEN '2024-01-01' ELSE '2024-06-01' END AS updated
FROM customer FULL JOIN u ON c_custkey::VARCHAR = u.nickname""")
def profile_upsert(spark, d):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    return U.upsert_profiles(_profiles(spark, d), _updates(spark, d), now).select(
        "nickname", *U.PROFILE_FIELDS, F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("profile_upsert_repeated", f"""WITH {_UPDATES}
SELECT coalesce(c_custkey::VARCHAR, u.nickname) AS nickname, c_name AS name, c_nationkey AS age,
  CASE WHEN st = 'F' AND c_custkey IS NOT NULL THEN NULL ELSE coalesce(CASE WHEN st = 'O' THEN pr END, c_mktsegment) END AS conditions,
  pr AS emergency_contact, CASE WHEN st = 'F' OR c_custkey IS NULL THEN NULL ELSE 'old' END AS notes,
  CASE WHEN c_custkey IS NULL THEN NULL ELSE true END AS health_info_consent,
  CASE WHEN c_custkey IS NULL THEN '2024-06-01' ELSE '2024-01-01' END AS created, CASE WHEN u.nickname IS NULL THEN '2024-01-01' ELSE '2024-06-01' END AS updated
FROM customer FULL JOIN u ON c_custkey::VARCHAR = u.nickname""")
def profile_upsert_repeated(spark, d):
    """As above, with an older and a newer update of every key."""
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    new = _updates(spark, d).withColumn("version", F.lit(2))
    stale = new.withColumn("version", F.lit(1)).withColumn("emergency_contact", F.lit("stale"))
    return U.upsert_profiles(_profiles(spark, d), stale.unionByName(new), now, order=["version"]).select(
        "nickname", *U.PROFILE_FIELDS, F.date_format("created_at", "yyyy-MM-dd").alias("created"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query("summary_upsert", f"""WITH {_UPDATES}
SELECT coalesce(c_custkey::VARCHAR, u.nickname) AS nickname, CASE WHEN u.nickname IS NOT NULL THEN pr ELSE c_mktsegment END AS summary,
  CASE WHEN u.nickname IS NOT NULL THEN length(pr) ELSE c_nationkey END::INT AS summarized_count FROM customer FULL JOIN u ON c_custkey::VARCHAR = u.nickname""")
def summary_upsert(spark, d):
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    old = _profiles(spark, d).select("nickname", F.col("conditions").alias("summary"),
                                     F.col("age").alias("summarized_count"), "created_at", "updated_at")
    new = _updates(spark, d).select("nickname", F.col("emergency_contact").alias("summary"),
                                    F.length("emergency_contact").alias("summarized_count"))
    return U.upsert_summaries(old, new, now).select("nickname", "summary", "summarized_count")


@query("latest_orders", """
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_orders(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    return U.latest_by_key(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("profile_delete", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def profile_delete(spark, d):
    doomed = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return U.delete_by_key(table(spark, d, "customer").select("c_custkey", "c_name"), doomed, "c_custkey")


@query("deletion_counts", """
SELECT count(*) FILTER (o_custkey IS NOT NULL) AS n_deleted, count(*) FILTER (o_custkey IS NULL) AS n_kept
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey""")
def deletion_counts(spark, d):
    doomed = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return U.deletion_counts(table(spark, d, "customer").select("c_custkey"), doomed, "c_custkey")


@query("assembled_contexts", """
WITH h AS (SELECT conv_id, turn, role, string_agg(CASE WHEN role = 'user' THEN '사용자' ELSE 'AI' END || ': ' || left(text, 200), chr(10)) OVER w AS hist
   FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT conv_id, turn, CASE WHEN c_custkey IS NULL THEN '등록된 환자 정보가 없습니다.' ELSE '- name: ' || c_name || chr(10) || CASE WHEN c_nationkey <> 0 THEN '- age: ' || c_nationkey || chr(10) ELSE '' END
   || '- conditions: ' || c_mktsegment END || chr(10) || chr(10) || coalesce(hist, '이전 대화 없음') || chr(10) || chr(10) || '관련 의료 정보 없음' AS context
FROM h LEFT JOIN customer ON c_custkey = conv_id AND c_nationkey <> 3 WHERE role = 'user'""")
def assembled_contexts(spark, d):
    from careline.plans.pipeline import assemble_context

    profiles = table(spark, d, "customer").filter("c_nationkey <> 3").withColumnRenamed("c_custkey", "conv_id")
    turns = O.turn_context(table(spark, d, "conversations")).filter("role = 'user'").join(profiles, "conv_id", "left")
    fields = {"name": F.col("c_name"), "age": F.col("c_nationkey"), "conditions": F.col("c_mktsegment")}
    return turns.select("conv_id", "turn", assemble_context(turns, fields, F.col("c_name").isNotNull()).alias("context"))
