"""Queries of lexicon, entity, intent, risk and personal-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from careline.functions import classify as C
from careline.functions import lexicon as L
from careline.functions import morphemes as M
from careline.functions import pii as P
from careline.functions import spans as SP
from careline.functions.core import let, strings, unpack
from careline.functions.scan import scan
from careline.operators import reports as R
from careline.plans import pipeline
from careline.plans.korean import KO, KO_DOCS, korean, korean_turns
from careline.plans.queries_turns import _CONTEXT
from careline.plans.registry import (
    arr, q, query, sql_any, sql_count, sql_match, sql_strip, sql_values,
)
from careline.rules import graph_seed, intents, medical, pii, risk
from careline.sources.tables import table

# A small pack for the documents; the tables hold invented words.
PACK = ["the", "then", "nd", "ation", "worth"]


def _docs(spark, d):
    return table(spark, d, "documents")


def _ko(spark, d):
    return korean_turns(table(spark, d, "conversations"))


def _ko_docs(spark, d):
    return _docs(spark, d).select("doc_id", korean("text").alias("text"))


# ---- keywords and spans --------------------------------------------------------------

@query("keyword_hits", f"""
SELECT doc_id, {sql_any('text', PACK)} AS any_hit, {sql_count('text', PACK)} AS n_hits,
  array_to_string(list_filter({arr(PACK)}, lambda k: contains(text, k)), ',') AS hits FROM documents""")
def keyword_hits(spark, d):
    t = F.col("text")
    return _docs(spark, d).select(
        "doc_id", L.any_keyword(t, PACK).alias("any_hit"), L.keyword_count(t, PACK).alias("n_hits"),
        F.array_join(L.keyword_hits(t, PACK), ",").alias("hits"))


_SPANS = f"""s AS (SELECT doc_id, term, unnest(string_split(text, term)) AS part,
    generate_subscripts(string_split(text, term), 1) AS i, len(string_split(text, term)) AS n
  FROM documents, {sql_values([[t] for t in PACK], 'v(term)')}),
c AS (SELECT *, sum(length(part) + length(term)) OVER (PARTITION BY doc_id, term ORDER BY i) - length(term) AS start FROM s),
sp AS (SELECT doc_id, term, start::BIGINT AS start, (start + length(term))::BIGINT AS stop FROM c WHERE i < n)"""


@query("term_spans", f'WITH {_SPANS} SELECT doc_id, term, start, stop AS "end" FROM sp')
def term_spans(spark, d):
    return unpack(_docs(spark, d), ["doc_id"], SP.term_spans("text", PACK), "start").select(
        "doc_id", F.col("text").alias("term"), F.col("start").cast("bigint").alias("start"),
        F.col("end").cast("bigint").alias("end"))


@query("longest_spans", f"""
SELECT doc_id, m AS term, count(*) AS n FROM (SELECT doc_id,
  unnest(regexp_extract_all(text, '(worth|ation|then|the|nd)', 1)) AS m FROM documents) GROUP BY ALL""")
def longest_spans(spark, d):
    kept = SP.longest_non_overlapping(SP.term_spans("text", PACK))
    return unpack(_docs(spark, d), ["doc_id"], kept, "start").groupBy(
        "doc_id", F.col("text").alias("term")).agg(F.count("*").alias("n"))


@query("merged_spans", f"""WITH {_SPANS},
b AS (SELECT * FROM sp WHERE term IN ('then', 'worth')), x AS (SELECT * FROM sp WHERE term IN ('nd', 'the')),
f AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND
  ((x.start >= b.start AND x.start < b.stop) OR (x.stop > b.start AND x.stop <= b.stop))))
SELECT doc_id, term, count(*) AS n, sum(start)::BIGINT AS places FROM (SELECT * FROM b UNION ALL SELECT * FROM f) GROUP BY ALL""")
def merged_spans(spark, d):
    merged = SP.add_uncovered(SP.term_spans("text", ["then", "worth"]), SP.term_spans("text", ["nd", "the"]))
    return unpack(_docs(spark, d), ["doc_id"], merged, "start").groupBy(
        "doc_id", F.col("text").alias("term")).agg(
        F.count("*").alias("n"), F.sum("start").alias("places"))


_TOKEN = rf"[가-힣]+(?:[은는이가을를에서로와과의도만])?|[a-zA-Z]+|\p{{Nd}}+(?:\.\p{{Nd}}+)?|[^\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\p{{Z}}\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]"


@query("token_counts", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {q(_TOKEN)}, 0) AS k FROM documents)
SELECT doc_id, len(k)::INT AS n_tokens, md5(array_to_string(k, ' ')) AS digest FROM t""")
def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", L.tokens("text").alias("k")).select(
        "doc_id", F.size("k").alias("n_tokens"),
        F.md5(F.array_join(F.transform("k", lambda k: k["text"]), " ")).alias("digest"))


# ---- entities ------------------------------------------------------------------------

_NOUNS = f"""nouns AS (SELECT conv_id, turn, term, category, instr(lower(text), term) - 1 AS start
  FROM ko, {sql_values(medical.NOUNS, 'n(term, category, description)')} WHERE contains(lower(text), term))"""


@query("noun_entities", f"""WITH {KO}, {_NOUNS}
SELECT conv_id, turn, term AS text, term AS lemma, category, 'NNG' AS pos_tag, start, start + length(term) AS "end",
  0.8::DOUBLE AS confidence, 'fallback' AS source FROM nouns""")
def noun_entities(spark, d):
    return unpack(_ko(spark, d), ["conv_id", "turn"], L.noun_matches("text"), "start").withColumn(
        "start", F.col("start").cast("bigint")).withColumn("end", F.col("end").cast("bigint"))


@query("compound_entities", f"""WITH {KO},
m AS (SELECT conv_id, turn, text AS t, regexp_extract(text, p, 0) AS text, category, lemma FROM ko,
  {sql_values(medical.COMPOUNDS, 'c(p, category, lemma)')} WHERE regexp_matches(text, p))
SELECT conv_id, turn, text, lemma, category, instr(t, text) - 1 AS start FROM m""")
def compound_entities(spark, d):
    return unpack(_ko(spark, d), ["conv_id", "turn"], L.compound_matches("text"), "start").select(
        "conv_id", "turn", "text", "lemma", "category", F.col("start").cast("bigint").alias("start"))


def _morphemes():
    words = F.filter(F.split("text", " "), lambda w: F.length(w) > 1)
    return F.transform(words, lambda w: F.struct(
        F.substring(w, F.lit(1), F.length(w) - 1).alias("morph"),
        F.get(strings(["NNG", "VA", "NNP"]), F.pmod(F.length(w), F.lit(3))).alias("tag")))


@query("tagged_entities", f"""WITH {KO},
w AS (SELECT conv_id, turn, text, unnest(string_split(text, ' ')) AS w FROM ko),
m AS (SELECT conv_id, turn, text AS t, left(w, length(w) - 1) AS morph, ['NNG', 'VA', 'NNP'][length(w) % 3 + 1] AS tag FROM w WHERE length(w) > 1),
e AS (SELECT conv_id, turn, t, morph, tag, morph AS lemma, category, 1.0::DOUBLE AS confidence FROM m
    JOIN {sql_values(medical.NOUNS, 'n(term, category, description)')} ON morph = term WHERE tag LIKE 'NN%'
  UNION ALL SELECT conv_id, turn, t, morph, tag, description, category, 0.9::DOUBLE FROM m
    JOIN {sql_values(medical.VERBS, 'v(term, category, description)')} ON morph = term WHERE tag IN ('VV', 'VA', 'XSV', 'XSA')
    AND NOT morph IN ({', '.join(q(x) for x in medical.MORPH_STOP_WORDS if x not in medical.MORPH_STOP_EXEMPT)}))
SELECT conv_id, turn, morph AS text, lemma, category, tag AS pos_tag, greatest(instr(t, morph) - 1, 0) AS start, confidence,
  count(*) AS n FROM e GROUP BY ALL""")
def tagged_entities(spark, d):
    return unpack(
        _ko(spark, d).withColumn("ms", _morphemes()), ["conv_id", "turn"],
        L.tagged_matches("text", "ms"), "start").groupBy(
        "conv_id", "turn", "text", "lemma", "category", "pos_tag",
        F.col("start").cast("bigint").alias("start"), "confidence").agg(F.count("*").alias("n"))


_TAGS = sorted(M.dictionary_tags().items(), key=lambda x: (-len(x[0]), x[0]))


@query("tagger_entities", f"""WITH {KO},
w AS (SELECT conv_id, turn, text AS t, unnest(regexp_extract_all(text, {q('|'.join(w for w, _ in _TAGS))})) AS morph FROM ko),
m AS (SELECT w.*, tag FROM w JOIN {sql_values(_TAGS, 'd(word, tag)')} ON morph = word),
e AS (SELECT conv_id, turn, t, morph, tag, morph AS lemma, category, 1.0::DOUBLE AS confidence FROM m
    JOIN {sql_values(medical.NOUNS, 'n(term, category, description)')} ON morph = term WHERE tag LIKE 'NN%'
  UNION ALL SELECT conv_id, turn, t, morph, tag, description, category, 0.9::DOUBLE FROM m
    JOIN {sql_values(medical.VERBS, 'v(term, category, description)')} ON morph = term WHERE tag IN ('VV', 'VA', 'XSV', 'XSA')
    AND NOT morph IN ({', '.join(q(x) for x in medical.MORPH_STOP_WORDS if x not in medical.MORPH_STOP_EXEMPT)}))
SELECT conv_id, turn, morph AS text, lemma, category, tag AS pos_tag, greatest(instr(t, morph) - 1, 0) AS start, confidence,
  count(*) AS n FROM e GROUP BY ALL""")
def tagger_entities(spark, d):
    """As tagged_entities, with the morphemes that the stand-in for a tagger finds."""
    tagged = _ko(spark, d).withColumn("ms", M.morphemes()("text"))
    return unpack(tagged, ["conv_id", "turn"], L.tagged_matches("text", "ms"), "start").groupBy(
        "conv_id", "turn", "text", "lemma", "category", "pos_tag",
        F.col("start").cast("bigint").alias("start"), "confidence").agg(F.count("*").alias("n"))


# Entities from the left: one per lemma; of two that overlap the later one only wins by its source.
@query("medical_entities", f"""WITH {KO_DOCS},
c AS (SELECT doc_id, i, 0 AS rank, term AS text, term AS lemma, category, 'NNG' AS pos_tag, instr(lower(text), term) - 1 AS start,
    0.8::DOUBLE AS confidence, 'fallback' AS source FROM kodocs,
    {sql_values([[i, *r] for i, r in enumerate(medical.NOUNS)], 'n(i, term, category, description)')} WHERE contains(lower(text), term)
  UNION ALL SELECT doc_id, i, 3, m, lemma, category, 'COMPOUND', instr(text, m) - 1, 0.95::DOUBLE, 'pattern' FROM (
    SELECT doc_id, i, text, regexp_extract(text, p, 0) AS m, category, lemma FROM kodocs,
    {sql_values([[i + 1000, *r] for i, r in enumerate(medical.COMPOUNDS)], 'c(i, p, category, lemma)')} WHERE regexp_matches(text, p))),
o AS (SELECT doc_id, list({{'rank': rank, 'text': text, 'lemma': lemma, 'category': category, 'pos_tag': pos_tag, 'start': start,
    'stop': start + length(text), 'confidence': confidence, 'source': source}} ORDER BY start, rank DESC, i) AS es FROM c GROUP BY doc_id),
k AS (SELECT doc_id, unnest(list_reduce(list_transform(es, lambda e: {{'e': e, 'kept': es[1:0]}}), lambda a, x: {{'e': x.e, 'kept':
    CASE WHEN len(list_filter(a.kept, lambda k: k.lemma = x.e.lemma)) > 0 THEN a.kept
      WHEN len(a.kept) > 0 AND x.e.start < a.kept[-1].stop THEN CASE WHEN x.e.rank > a.kept[-1].rank
        THEN list_append(a.kept[1:len(a.kept) - 1], x.e) ELSE a.kept END
      ELSE list_append(a.kept, x.e) END}}, {{'e': es[1], 'kept': es[1:0]}}).kept) AS e FROM o)
SELECT doc_id, e.text AS text, e.lemma AS lemma, e.category AS category, e.pos_tag AS pos_tag, e.start::INT AS start, e.stop::INT AS "end",
  e.confidence AS confidence, e.source AS source FROM k""")
def medical_entities(spark, d):
    return unpack(_ko_docs(spark, d), ["doc_id"], L.medical_entities("text"), "start")


@query("health_entities", f"""WITH {KO},
w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS entity FROM ko),
l AS (SELECT entity, ['TERM', 'QUANTITY', 'PERSON', 'DATE'][length(entity) % 4 + 1] AS label FROM w)
SELECT entity, label FROM l WHERE label IN ('QUANTITY', 'TIME', 'DATE') OR
  len(list_filter({arr(medical.HEALTH_KEYWORDS)}, lambda k: contains(entity, k) OR contains(k, entity))) > 0""")
def health_entities(spark, d):
    words = _ko(spark, d).select(F.explode(F.split("text", " ")).alias("entity")).distinct()
    label = F.get(strings(["TERM", "QUANTITY", "PERSON", "DATE"]), F.pmod(F.length("entity"), F.lit(4)))
    return words.withColumn("label", label).filter(L.is_health_related("entity", "label"))


def _sql_flags() -> str:
    return ", ".join(f"CASE WHEN {sql_any('l', kws)} THEN {q(flag)} END" for flag, kws in medical.SYMPTOM_FLAGS)


def _sql_advice() -> str:
    parts = [f"CASE WHEN alert THEN {q(medical.ALERT_ADVICE)} END"] + [
        f"CASE WHEN list_contains(f, {q(flag)}) THEN {q(a)} END" for flag, a in medical.SYMPTOM_ADVICE]
    return f"coalesce(array_to_string([{', '.join(parts)}], '|'), '')"


@query("symptom_scan", f"""WITH {KO},
x AS (SELECT conv_id, turn, lower(text) AS l FROM ko),
y AS (SELECT conv_id, turn, list_filter([{_sql_flags()}], lambda z: z IS NOT NULL) AS f, {sql_any('l', medical.ALERT_WORDS)} AS alert FROM x)
SELECT conv_id, turn, array_to_string(f, ',') AS symptoms, CASE WHEN alert THEN 'critical' ELSE 'normal' END AS alert_level,
  {_sql_advice()} AS recommendations, len(f) > 2 OR alert AS needs_attention FROM y""")
def symptom_scan(spark, d):
    return _ko(spark, d).select("conv_id", "turn", L.symptom_scan("text").alias("s")).select(
        "conv_id", "turn", F.array_join("s.symptoms", ",").alias("symptoms"), "s.alert_level",
        F.array_join("s.recommendations", "|").alias("recommendations"), "s.needs_attention")


def sql_colloquial(text: str) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({text}, {q(p)}) THEN {q(t)} END" for p, t in medical.COLLOQUIAL)
    lst = f"list_filter([{items}], lambda z: z IS NOT NULL)"
    return f"list_filter({lst}, lambda z, i: list_position({lst}, z) = i)"


_NAMES = [n for n, _, _ in graph_seed.NODES]


@query("graph_keywords", f"""WITH {KO},
k AS (SELECT conv_id, turn, list_filter({arr(_NAMES)}, lambda k: contains(text, k)) AS a, {sql_colloquial('text')} AS b FROM ko)
SELECT conv_id, turn, array_to_string(list_concat(a, list_filter(b, lambda z: NOT list_contains(a, z)))[1:5], '|') AS keywords,
  array_to_string(b, '|') AS colloquial FROM k""")
def graph_keywords(spark, d):
    from careline.operators.graph import hybrid_keywords, rule_keywords

    return _ko(spark, d).select(
        "conv_id", "turn",
        F.array_join(hybrid_keywords(rule_keywords("text", _NAMES)), "|").alias("keywords"),
        F.array_join(L.colloquial_terms("text"), "|").alias("colloquial"))


@query("clinical_terms", f"""WITH {KO} SELECT conv_id, turn,
  array_to_string(list_filter({arr(medical.CLINICAL_TERMS)}, lambda k: contains(text, k)), ',') AS kept FROM ko""")
def clinical_terms(spark, d):
    return _ko(spark, d).select("conv_id", "turn", F.array_join(L.clinical_terms(F.col("text")), ",").alias("kept"))


@query("keyword_contexts")
def keyword_contexts(spark, d):
    spans = SP.longest_non_overlapping(SP.term_spans("text", ["worth", "ation"]))
    rows = _docs(spark, d).withColumn("c", L.word_contexts("text", spans))
    return rows.select(
        "doc_id", F.size("c").alias("n_contexts"), L.combined_context("text", F.col("c")).alias("combined"),
        L.embedding_context("text", F.col("c")).alias("embedding_text"))


# Words before and after a word, where words are parted by single blanks.
@query("word_neighbours", f"""WITH {KO},
t AS (SELECT conv_id, turn, regexp_extract_all(text, '[가-힣]+|[a-zA-Z]+|[0-9]+|[^\\s\\p{{L}}\\p{{N}}]', 0) AS k FROM ko),
e AS (SELECT conv_id, turn, k, unnest(k) AS w, generate_subscripts(k, 1) AS i FROM t),
c AS (SELECT *, k[greatest(i - 5, 1):i - 1] AS b, k[i + 1:i + 5] AS a FROM e WHERE w IN ('두통이', '혈압이')),
f AS (SELECT *, list_filter(b, lambda x: NOT list_contains({arr(medical.CONTEXT_STOP_WORDS)}, x)) AS fb,
  list_filter(a, lambda x: NOT list_contains({arr(medical.CONTEXT_STOP_WORDS)}, x)) AS fa FROM c)
SELECT conv_id, turn, w AS target, trim(array_to_string(CASE WHEN len(fb) < 2 THEN b ELSE fb END, ' ') || ' ' || w || ' '
  || array_to_string(CASE WHEN len(fa) < 2 THEN a ELSE fa END, ' ')) AS context FROM f""")
def word_neighbours(spark, d):
    spans = SP.term_spans("text", ["두통이", "혈압이"])
    return unpack(_ko(spark, d), ["conv_id", "turn"], L.word_contexts("text", spans), "start").select(
        "conv_id", "turn", "target", F.col("full_context").alias("context"))


# ---- intent --------------------------------------------------------------------------

def _sql_intent() -> str:
    I, c = intents, intents.CONFIDENCE
    ctx = "(turn_count > 0 AND recent_topic <> '')"
    rules = [
        (sql_any("l", I.LEAK_WORDS), I.BLOCKED, c["leak"]),
        (sql_any("l", I.EMERGENCY_WORDS), I.EMERGENCY, c["emergency"]),
        (sql_match("m", I.END_PATTERNS), I.END, c["end"]),
        (sql_match("m", I.GENERAL_PATTERNS), I.GENERAL, c["general"]),
        (f"{ctx} AND {sql_match('m', I.FOLLOWUP_PATTERNS)}", I.FOLLOWUP, c["followup"]),
        (f"{ctx} AND length(m) <= 10", I.FOLLOWUP, c["followup_short"]),
        (f"{sql_count('l', I.HEALTH_WORDS)} >= 2", I.HEALTH, c["health_many"]),
        (sql_any("l", I.HEALTH_WORDS), I.HEALTH, c["health_one"]),
        (sql_any("l", I.MEDICATION_WORDS), I.MEDICATION, c["medication"]),
        (f"{sql_count('l', I.LIFESTYLE_WORDS)} >= 2", I.LIFESTYLE, c["lifestyle_many"]),
        (sql_any("l", I.LIFESTYLE_WORDS), I.LIFESTYLE, c["lifestyle_one"]),
        ("length(m) <= 10 AND turn_count > 0", I.FOLLOWUP, c["short"]),
    ]
    whens = " ".join(f"WHEN {cond} THEN {{'intent': {q(i)}, 'conf': {v}::DOUBLE}}" for cond, i, v in rules)
    return f"CASE {whens} ELSE {{'intent': {q(I.GENERAL)}, 'conf': {c['default']}::DOUBLE}} END"


_INTENT = f"""{_CONTEXT}, cx AS (SELECT *, {sql_strip('text')} AS m, lower({sql_strip('text')}) AS l FROM ctx WHERE role = 'user'),
it AS (SELECT *, {_sql_intent()} AS ic FROM cx),
iv AS (SELECT *, ic.intent AS intent, ic.conf AS intent_confidence, CASE ic.intent WHEN 'blocked' THEN 'blocked'
   WHEN 'end_conversation' THEN 'end_conversation' WHEN 'emergency' THEN 'emergency' WHEN 'general_chat' THEN 'general'
   ELSE 'needs_retrieval' END AS route FROM it)"""


def _intents(spark, d):
    from careline.operators.turns import turn_context

    return pipeline.with_intent(turn_context(_ko(spark, d)).filter("role = 'user'"))


@query("intent_cascade", f"""WITH {_INTENT} SELECT conv_id, turn, intent, intent_confidence, route,
  array_to_string(list_filter({arr(intents.EMERGENCY_WORDS)}, lambda k: contains(text, k)), ',') AS emergency FROM iv""")
def intent_cascade(spark, d):
    return _intents(spark, d).select(
        "conv_id", "turn", "intent", "intent_confidence", "route",
        F.array_join("emergency_keywords", ",").alias("emergency"))


@query("intent_distribution", f"""WITH {_INTENT} SELECT intent, count(*) AS n,
  round(count(*) / sum(count(*)) OVER () * 100, 1)::DOUBLE AS percent FROM iv GROUP BY intent""")
def intent_distribution(spark, d):
    return R.distribution(_intents(spark, d), "intent")


@query("emergency_alerts", f"""WITH {_INTENT} SELECT conv_id, turn, 'critical' AS level, text AS message,
  array_to_string(list_filter({arr(intents.EMERGENCY_WORDS)}, lambda k: contains(text, k)), ',') AS keywords,
  coalesce(c_name, '') AS emergency_contact, true AS action_required
  FROM iv LEFT JOIN customer ON conv_id = c_custkey AND c_nationkey < 20 WHERE intent = 'emergency'""")
def emergency_alerts(spark, d):
    profiles = table(spark, d, "customer").filter("c_nationkey < 20").select(
        F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("emergency_contact"))
    return pipeline.emergency_alerts(_intents(spark, d), profiles).withColumn(
        "keywords", F.array_join("keywords", ","))


# ---- risk ----------------------------------------------------------------------------

_RISK_ROWS = [[i, c["category"], risk.LEVELS.index(c["level"]), c["display"], c["expansion"],
               c["recommendation"]] for i, c in enumerate(risk.CATEGORIES)]
_RISK = f"""{KO},
t AS (SELECT conv_id, turn, role, text, list_filter({arr([n for n, _, _ in medical.NOUNS])}, lambda k: contains(lower(text), k)) AS terms,
   ({' + '.join(f"regexp_matches(text, {q(p)})::INT" for p in risk.RAISING)}) >= 2 AS up, {sql_match('text', risk.LOWERING)} AS down FROM ko),
k AS (SELECT i, category, base, display, expansion, recommendation,
   CASE i {' '.join(f"WHEN {i} THEN {arr(c['keywords'])}" for i, c in enumerate(risk.CATEGORIES))} END AS kws
   FROM {sql_values(_RISK_ROWS, 'c(i, category, base, display, expansion, recommendation)')}),
h AS (SELECT t.*, k.*, list_filter(kws, lambda w: contains(lower(text), w)) AS direct,
   list_filter(terms, lambda x: len(list_filter(kws, lambda w: contains(x, w) OR contains(w, x))) > 0) AS indirect FROM t, k),
sg AS (SELECT *, list_concat(direct, list_filter(indirect, lambda x: NOT list_contains(direct, x))) AS hits,
   CASE WHEN up AND base < 3 THEN base + 1 WHEN down AND base > 0 THEN base - 1 ELSE base END AS rank FROM h
   WHERE len(direct) + len(indirect) > 0)"""


def _signals(spark, d):
    nouns = F.transform(L.noun_matches("text"), lambda e: e["lemma"])
    return _ko(spark, d).withColumn("terms", nouns).withColumn(
        "signals", C.risk_signals("text", F.col("terms")))


@query("risk_signals", f"""WITH {_RISK} SELECT conv_id, turn, category, ({arr(risk.LEVELS)})[rank + 1] AS level, rank,
  array_to_string(hits, ',') AS trigger_terms, recommendation FROM sg""")
def risk_signals(spark, d):
    return unpack(_signals(spark, d), ["conv_id", "turn"], F.col("signals"), "category").select(
        "conv_id", "turn", "category", "level", "rank", F.array_join("trigger_terms", ",").alias("trigger_terms"),
        "recommendation")


_OVERALL = f"""{_RISK}, o AS (SELECT t.conv_id, t.turn, any_value(t.text) AS text, any_value(t.terms) AS terms, coalesce(max(rank), 0) AS top,
   list(expansion ORDER BY i) FILTER (i IS NOT NULL) AS expansions, list_sort(list_distinct(list(display) FILTER (display IS NOT NULL))) AS areas
   FROM t LEFT JOIN sg ON t.conv_id = sg.conv_id AND t.turn = sg.turn GROUP BY ALL)"""


@query("risk_overview", f"""WITH {_OVERALL} SELECT conv_id, turn, ({arr(risk.LEVELS)})[top + 1] AS overall_risk,
  CASE WHEN expansions IS NULL THEN {q(risk.SUMMARY_NONE)} ELSE {q(risk.SUMMARY_LEVEL)} || ({arr(risk.LEVEL_NAMES)})[top + 1] || chr(10)
    || {q(risk.SUMMARY_AREAS)} || array_to_string(areas, ', ') || chr(10)
    || CASE WHEN top = 3 THEN {q(risk.SUMMARY_CRITICAL)} ELSE '' END END AS summary,
  text || CASE WHEN len(terms) > 0 THEN ' ' || array_to_string(terms[1:5], ' ') ELSE '' END
    || CASE WHEN expansions IS NOT NULL THEN ' ' || array_to_string(expansions[1:3], ' ') ELSE '' END AS enhanced_query FROM o""")
def risk_overview(spark, d):
    rows = _signals(spark, d).withColumn("overall_risk", C.overall_risk(F.col("signals")))
    return rows.select(
        "conv_id", "turn", "overall_risk",
        C.risk_summary(F.col("signals"), F.col("overall_risk")).alias("summary"),
        C.enhance_query("text", F.col("terms"), F.col("signals")).alias("enhanced_query"))


@query("risk_distribution", f"""WITH {_OVERALL} SELECT ({arr(risk.LEVELS)})[top + 1] AS overall_risk, count(*) AS n,
  round(count(*) / sum(count(*)) OVER () * 100, 1)::DOUBLE AS percent FROM o GROUP BY 1""")
def risk_distribution(spark, d):
    return R.distribution(_signals(spark, d).select(C.overall_risk(F.col("signals")).alias("overall_risk")),
                          "overall_risk")


@query("gated_analysis", f"""WITH {KO} SELECT conv_id, turn, {sql_any('text', medical.GATE_WORDS)} AS gated FROM ko""")
def gated_analysis(spark, d):
    return _ko(spark, d).select("conv_id", "turn", C.analysis_gate("text").alias("gated"))


@query("analysed_turns")
def analysed_turns(spark, d):
    rows = pipeline.analyse_turns(_ko(spark, d))
    return rows.select("conv_id", "turn", "intent", "route", "report.overall_risk", "report.summary",
                       "may_refer", "note_repeated", "note_drift", "drift_topic", "risk_terms")


_GUIDED = "('health_consult', 'medication', 'followup')"


@query("guidance_flags", f"""WITH {_INTENT}, g AS (SELECT *, turn_count >= 3 AND intent IN {_GUIDED} AND (turn // 2) % 4 >= 1 AS may FROM iv),
fr AS (SELECT conv_id, min(turn) AS first FROM g WHERE may GROUP BY conv_id)
SELECT conv_id, turn, may AS may_refer, may AND turn = first AS referral, repeated_question AND intent IN {_GUIDED} AS note_repeated,
  topic_drifted AND intent IN {_GUIDED} AS note_drift, intent <> 'emergency' AS expert_guidance,
  intent <> 'emergency' AND {sql_any('text', intents.EMOTIONAL_RISK_WORDS)} AS note_emotional, (turn // 2) % 4 >= 2 AS note_high_risk,
  CASE WHEN (turn // 2) % 4 >= 2 THEN array_to_string(string_split(text, ' ')[1:5], ', ') END AS risk_terms
FROM g LEFT JOIN fr USING (conv_id)""".replace("may AND turn = first AS", "coalesce(may AND turn = first, false) AS"))
def guidance_flags(spark, d):
    # Levels go round by turn here, and the words of a turn are its terms; the risk side has its own queries.
    level = F.get(strings(["low", "medium", "high", "critical"]), (F.floor(F.col("turn") / 2) % 4).cast("int"))
    rows = _intents(spark, d).withColumn("report", F.struct(
        level.alias("overall_risk"), F.split("text", " ", -1).alias("detected_health_terms")))
    flagged = pipeline.first_in_session(pipeline.with_guidance(rows), "may_refer")
    return flagged.select("conv_id", "turn", "may_refer", "referral", "note_repeated", "note_drift",
                          "expert_guidance", "note_emotional", "note_high_risk", "risk_terms")


@query("flag_counts", f"""WITH {_CONTEXT} SELECT count(*) FILTER (repeated_question) AS n_repeated_question,
  count(*) FILTER (topic_drifted) AS n_topic_drifted FROM ctx WHERE role = 'user'""")
def flag_counts(spark, d):
    from careline.operators.turns import turn_context

    return R.flag_counts(turn_context(_ko(spark, d)).filter("role = 'user'"),
                         ["repeated_question", "topic_drifted"])


# ---- personal data -------------------------------------------------------------------

_SIMPLE = {k: P.PATTERNS[k] for k in P.ORDER if k != "name"}
_SURNAME = "|".join(pii.SURNAMES)
_HONOR = pii.HONORIFIC_PATTERN.replace("^\\s*", "^")


def _sql_pii_rows() -> str:
    out = [f"SELECT doc_id, {q(k)} AS pii_type, unnest(regexp_extract_all(text, {q(p)}, 0)) AS found FROM kodocs"
           for k, p in _SIMPLE.items()]
    out.append(f"""SELECT doc_id, 'name', r FROM (SELECT doc_id, unnest(runs) AS r, generate_subscripts(runs, 1) AS i, runs FROM
      (SELECT doc_id, regexp_extract_all(text, '[가-힣]+|[^가-힣]+', 0) AS runs FROM kodocs))
      WHERE regexp_matches(r, '^({_SURNAME})[가-힣]{{1,2}}$') AND r NOT IN ({', '.join(q(w) for w in pii.NOT_NAMES)})
        AND (length(r) = 3 OR left(r, 1) NOT IN ({', '.join(q(w) for w in pii.AMBIGUOUS_SURNAMES)})
          OR (trim(runs[i + 1]) = '' AND regexp_matches(runs[i + 2], {q(_HONOR)})))""")
    for kind, rows in (("family_ref", pii.FAMILY), ("stigma", pii.STIGMA)):
        out.append(f"""SELECT doc_id, {q(kind)}, term FROM (SELECT doc_id, term,
          unnest(range(0, (length(text) - length(replace(text, term, ''))) // length(term))) FROM kodocs,
          {sql_values(rows, 'v(term, mask)')})""")
    stems = [pii.surface_pattern(s) for s in pii.EMOTION_STEMS]
    words = [w + pii.SURFACE_TAIL for w in pii.EMOTION_WORDS + pii.CRISIS_WORDS]
    out.append("SELECT doc_id, 'emotional', unnest(regexp_extract_all(text, p, 0)) FROM kodocs, "
               + sql_values([[p] for p in stems + words], "v(p)"))
    return " UNION ALL ".join(out)


@query("pii_candidates", f"""WITH {KO_DOCS}, r AS ({_sql_pii_rows()})
SELECT doc_id, pii_type, found, count(*) AS n FROM r GROUP BY ALL""")
def pii_candidates(spark, d):
    """What each detector finds by itself, before the priority rule."""
    t = F.col("text")
    found = let(P.all_places(t), lambda at: F.concat(
        *[P.pattern_detections(t, k) for k in P.ORDER],
        P.term_detections(t, pii.FAMILY, "family_ref", pii.PSEUDONYMIZE, pii.FAMILY_CONFIDENCE, True, at),
        P.term_detections(t, pii.STIGMA, "stigma", pii.GENERALIZE, pii.STIGMA_CONFIDENCE, places=at),
        P.emotion_detections(t, places=at)))
    return unpack(_ko_docs(spark, d), ["doc_id"], found, "start").groupBy(
        "doc_id", "pii_type", F.col("text").alias("found")).agg(F.count("*").alias("n"))


def _sql_pii() -> str:
    """Accepted detections: ``acc`` (doc_id, start, stop, text, pii_type, mask, strategy, confidence).

    All candidates are placed, chains of candidates that touch are islands, and in each the
    candidates are taken in the order of their detectors.
    """
    family = sorted(pii.FAMILY, key=lambda r: -len(r[0]))
    patterns = [[P.ORDER.index(k), 0, k, p, *pii.MASKS[k]] for k, p in _SIMPLE.items()]
    emotional = [(pii.surface_pattern(s), pii.EMOTION_MASK, pii.EMOTION_STEM_CONFIDENCE) for s in pii.EMOTION_STEMS]
    emotional += [(w + pii.SURFACE_TAIL, mask, pii.EMOTION_WORD_CONFIDENCE)
                  for ws, mask in ((pii.EMOTION_WORDS, pii.EMOTION_MASK), (pii.CRISIS_WORDS, pii.CRISIS_MASK)) for w in ws]
    patterns += [[9, i, "emotional", p, mask, pii.GENERALIZE, c] for i, (p, mask, c) in enumerate(emotional)]
    terms = [[7, i, "family_ref", t, mask, pii.PSEUDONYMIZE, pii.FAMILY_CONFIDENCE] for i, (t, mask) in enumerate(family)]
    terms += [[8, i, "stigma", t, mask, pii.GENERALIZE, pii.STIGMA_CONFIDENCE] for i, (t, mask) in enumerate(pii.STIGMA)]
    names = "(rank, sub, pii_type, p, mask, strategy, confidence)"
    name_mask, name_strategy, name_confidence = pii.MASKS["name"]
    honorific = ", ".join(q(t) for t in pii.HONORIFIC_FAMILY)
    return f"""
pm AS (SELECT doc_id, v.*, regexp_extract_all(text, p, 0) AS ms, string_split_regex(text, p) AS gs FROM kodocs, {sql_values(patterns, 'v' + names)}
  WHERE regexp_matches(text, p)
  UNION ALL SELECT doc_id, v.*, list_transform(string_split(text, p)[2:], lambda z: p), string_split(text, p) FROM kodocs,
  {sql_values(terms, 'v' + names)} WHERE contains(text, p)),
pe AS (SELECT doc_id, rank, sub, pii_type, mask, strategy, confidence, unnest(ms) AS text, unnest(gs[1:len(ms)]) AS gap,
  generate_subscripts(ms, 1) AS i FROM pm),
pp AS (SELECT *, sum(length(gap) + length(text)) OVER (PARTITION BY doc_id, rank, sub ORDER BY i) - length(text) AS start FROM pe),
nr AS (SELECT doc_id, unnest(runs) AS r, generate_subscripts(runs, 1) AS i FROM
  (SELECT doc_id, regexp_extract_all(text, '[가-힣]+|[^가-힣]+', 0) AS runs FROM kodocs)),
np AS (SELECT *, sum(length(r)) OVER w - length(r) AS start, lead(r) OVER w AS gap, lead(r, 2) OVER w AS behind FROM nr
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ca AS (SELECT doc_id, rank, sub, pii_type, text, start, start + length(text) AS stop, CASE WHEN pii_type = 'age_specific'
    THEN (regexp_extract(text, '[0-9]{{1,3}}', 0)::INT // 10 * 10)::VARCHAR || mask ELSE mask END AS mask, strategy, confidence,
    text IN ({honorific}) AND pii_type IN ('family_ref', 'stigma') AS honorific FROM pp
  UNION ALL SELECT doc_id, {P.ORDER.index('name')}, 0, 'name', r, start, start + length(r), '', {q(name_strategy)}, {name_confidence}, false FROM np
  WHERE regexp_matches(r, '^({_SURNAME})[가-힣]{{1,2}}$') AND r NOT IN ({', '.join(q(w) for w in pii.NOT_NAMES)})
    AND (length(r) = 3 OR left(r, 1) NOT IN ({', '.join(q(w) for w in pii.AMBIGUOUS_SURNAMES)})
      OR (trim(gap) = '' AND regexp_matches(behind, {q(_HONOR)})))),
cb AS (SELECT *, start - honorific::INT AS lo, stop + (pii_type = 'name')::INT AS hi FROM ca),
cc AS (SELECT *, coalesce(lo >= max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi, rank, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM cb),
cd AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY lo, hi, rank, sub ROWS UNBOUNDED PRECEDING) AS island FROM cc),
ci AS (SELECT doc_id, island, list_sort(list({{'rank': rank, 'sub': sub, 'start': start, 'stop': stop, 'text': text, 'pii_type': pii_type,
    'mask': mask, 'strategy': strategy, 'confidence': confidence::DOUBLE, 'honorific': honorific}})) AS cs FROM cd GROUP BY doc_id, island),
ck AS (SELECT doc_id, unnest(list_reduce(list_transform(cs, lambda c: {{'c': c, 'kept': cs[1:0], 'skipped': cs[1:0]}}), lambda a, x:
  CASE WHEN len(list_filter(a.kept, lambda k: x.c.start < k.stop AND x.c.stop > k.start)) > 0
      OR (x.c.pii_type = 'family_ref' AND len(list_filter(a.skipped, lambda k: x.c.start >= k.start AND x.c.stop <= k.stop)) > 0) THEN a
    WHEN x.c.pii_type = 'family_ref' AND x.c.honorific AND len(list_filter(a.kept, lambda k: k.pii_type = 'name' AND abs(x.c.start - k.stop) <= 1)) > 0
      THEN {{'c': x.c, 'kept': a.kept, 'skipped': list_append(a.skipped, x.c)}}
    ELSE {{'c': x.c, 'kept': list_append(a.kept, x.c), 'skipped': a.skipped}} END, {{'c': cs[1], 'kept': cs[1:0], 'skipped': cs[1:0]}}).kept) AS k FROM ci),
nf AS (SELECT doc_id, k.text AS text, min(k.start) AS first FROM ck WHERE k.pii_type = 'name' GROUP BY doc_id, k.text),
nn AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS n FROM nf),
acc AS (SELECT ck.doc_id, k.start::INT AS start, k.stop::INT AS stop, k.text AS text, k.pii_type AS pii_type,
  CASE WHEN k.pii_type = 'name' THEN {q(name_mask)} || chr((65 + n % 26)::INT) || ']' ELSE k.mask END AS mask,
  k.strategy AS strategy, k.confidence AS confidence FROM ck LEFT JOIN nn ON k.pii_type = 'name' AND nn.doc_id = ck.doc_id AND nn.text = k.text)"""


_PII = f"{KO_DOCS.replace('AS (', 'AS MATERIALIZED (', 1)}, {_sql_pii()}"


def _detected(spark, d, seen=()):
    rows = _ko_docs(spark, d).withColumn("scanned", scan("text", P.SCANNED, seen))
    return rows.withColumn("pii", P.detect_pii("text", scanned=F.col("scanned.spans")))


@query("pii_spans", f"""WITH {_PII} SELECT doc_id, start, stop AS "end", text, pii_type, mask, strategy, confidence FROM acc""")
def pii_spans(spark, d):
    return unpack(_detected(spark, d), ["doc_id"], F.col("pii"), "start")


@query("pii_redacted", f"""WITH {_PII},
pg AS (SELECT acc.doc_id, acc.start, acc.mask, d.text, acc.stop, coalesce(lag(stop) OVER (PARTITION BY acc.doc_id ORDER BY acc.start), 0) AS done
  FROM acc JOIN kodocs d USING (doc_id)),
pd AS (SELECT doc_id, string_agg(substr(text, done + 1, start - done) || mask, '' ORDER BY start) || substr(any_value(text), max(stop) + 1) AS redacted,
  count(*) AS n FROM pg GROUP BY doc_id)
SELECT doc_id, coalesce(redacted, text, '') AS redacted, coalesce(n, 0)::INT AS n_pii FROM kodocs LEFT JOIN pd USING (doc_id)""")
def pii_redacted(spark, d):
    return _detected(spark, d).select(
        "doc_id", P.redact("text", F.col("pii")).alias("redacted"), P.pii_count(F.col("pii")).alias("n_pii"))


@query("pii_by_type", f"WITH {_PII} SELECT pii_type, count(*) AS n FROM acc GROUP BY pii_type")
def pii_by_type(spark, d):
    return unpack(_detected(spark, d), [], F.col("pii"), "p", None, ["p"]).groupBy(
        F.col("p.pii_type").alias("pii_type")).agg(F.count("*").alias("n"))


@query("health_summaries")
def health_summaries(spark, d):
    rows = _detected(spark, d, C.RISK_SEEN).withColumn("signals", C.risk_signals("text", seen=F.col("scanned.seen")))
    made = rows.select("doc_id", F.inline(F.array(P.health_summary("text", F.col("pii"), F.col("signals"), clinical=False))))
    return made.withColumn("clinical_terms_preserved", L.clinical_terms_scanned("context_redacted"))


# A pack for the addresses that the documents hold, masked by the same span operators.
_PHONE, _MAIL = r"\+1 \(\d{3}\) \d{3}-\d{4}", r"[A-Za-z0-9_.-]+@[A-Za-z0-9_-]+\.[A-Za-z]+"


@query("masked_contacts", f"""
SELECT doc_id, regexp_replace(regexp_replace(text, {q(_PHONE)}, '[phone]', 'g'), {q(_MAIL)}, '[mail]', 'g') AS masked,
  (len(regexp_extract_all(text, {q(_PHONE)}, 0)) + len(regexp_extract_all(text, {q(_MAIL)}, 0)))::INT AS n FROM documents""")
def masked_contacts(spark, d):
    def marked(pattern, mask):
        return F.transform(SP.pattern_spans("text", pattern), lambda s: F.struct(
            s["start"], s["end"], F.lit(mask).alias("mask")))

    spans = SP.by_start(SP.accept_in_order(F.concat(marked(_PHONE, "[phone]"), marked(_MAIL, "[mail]"))))
    rows = _docs(spark, d).withColumn("s", spans)
    return rows.select("doc_id", SP.mask_spans("text", F.col("s")).alias("masked"), F.size("s").alias("n"))


@query("preservation_rate", f"""WITH {KO_DOCS},
r AS (SELECT list_filter({arr(medical.CLINICAL_TERMS)}, lambda k: contains(text, k)) AS terms,
  regexp_replace(text, {q(P.PATTERNS['hospital'])}, '', 'g') AS redacted FROM kodocs)
SELECT sum(len(terms))::BIGINT AS n_required, sum(len(list_filter(terms, lambda k: contains(redacted, k))))::BIGINT AS n_kept,
  n_kept / n_required AS rate FROM r""")
def preservation_rate(spark, d):
    rows = _ko_docs(spark, d).select(
        L.clinical_terms(F.col("text")).alias("terms"),
        F.regexp_replace("text", P.PATTERNS["hospital"], "").alias("redacted"))
    return R.preservation_rate(rows, F.col("terms"), F.col("redacted"))


