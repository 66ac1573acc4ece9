"""Queries of graph, vector and schedule operators.

The graph is built from the given tables: regions, nations, customers and suppliers are
nodes, their keys are edges.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from careline.functions.core import unpack
from careline.operators import care as CA
from careline.operators import extraction as X
from careline.operators import graph as G
from careline.operators import retrieval as V
from careline.operators import vector_index as VI
from careline.plans.korean import KO_DOCS, korean, korean_turns
from careline.plans.registry import q, query, sql_values
from careline.rules import care
from careline.sources.scratch import work_folder, written
from careline.sources.tables import table

_NODES = """kn AS (SELECT 'Region' AS label, r_name AS name, 'R' || r_regionkey AS id, 'region' AS description FROM region
  UNION ALL SELECT 'Nation', n_name, 'N' || n_nationkey, 'nation of ' || n_regionkey FROM nation
  UNION ALL SELECT 'Customer', c_name, 'C' || c_custkey, c_mktsegment FROM customer
  UNION ALL SELECT 'Supplier', s_name, 'S' || s_suppkey, 'supplier' FROM supplier)"""
_EDGES = """ke AS (SELECT n_name AS src, r_name AS dst, 'AFFECTS' AS rel FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT c_name, n_name, 'SYMPTOM_OF' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT n_name, s_name, 'MANAGED_BY' FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def _nodes(spark, d):
    def part(name, label, title, prefix, key, description):
        return table(spark, d, name).select(
            F.lit(label).alias("label"), F.col(title).alias("name"),
            F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), description.alias("description"))

    return (
        part("region", "Region", "r_name", "R", "r_regionkey", F.lit("region"))
        .unionByName(part("nation", "Nation", "n_name", "N", "n_nationkey",
                          F.concat(F.lit("nation of "), F.col("n_regionkey").cast("string"))))
        .unionByName(part("customer", "Customer", "c_name", "C", "c_custkey", F.col("c_mktsegment")))
        .unionByName(part("supplier", "Supplier", "s_name", "S", "s_suppkey", F.lit("supplier")))
    )


def _id_edges(spark, d):
    """Edges between ids, as the tables give them."""
    def part(name, src, dst, rel):
        return table(spark, d, name).select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"))

    def key(p, c):
        return F.concat(F.lit(p), F.col(c).cast("string"))

    return (
        part("nation", key("N", "n_nationkey"), key("R", "n_regionkey"), "AFFECTS")
        .unionByName(part("customer", key("C", "c_custkey"), key("N", "c_nationkey"), "SYMPTOM_OF"))
        .unionByName(part("supplier", key("N", "s_nationkey"), key("S", "s_suppkey"), "MANAGED_BY"))
    )


def _edges(spark, d):
    return G.merge_edges(_nodes(spark, d), _id_edges(spark, d))


@query("kg_stats", f"""WITH {_NODES}, {_EDGES}
SELECT (SELECT count(*) FROM kn) AS node_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM ke)) AS edge_count""")
def kg_stats(spark, d):
    return G.graph_stats(_nodes(spark, d), _edges(spark, d))


@query("kg_names", f"WITH {_NODES} SELECT label, count(*) AS n, min(name) AS first, max(name) AS last FROM kn GROUP BY label")
def kg_names(spark, d):
    return G.names_by_label(_nodes(spark, d)).groupBy("label").agg(
        F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("kg_merged_nodes", f"""WITH {_NODES},
u AS (SELECT c_name AS name, 'order ' || max(o_orderkey) AS description FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name
  UNION ALL SELECT p_name || p_partkey, 'part' FROM part)
SELECT coalesce(label, 'Customer') AS label, coalesce(kn.name, u.name) AS name, id, coalesce(u.description, kn.description) AS description
FROM kn FULL JOIN u ON kn.name = u.name AND kn.label = 'Customer'""")
def kg_merged_nodes(spark, d):
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"))
    named = last.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.lit("Customer").alias("label"), F.col("c_name").alias("name"),
        F.concat(F.lit("order "), F.col("k").cast("string")).alias("description"))
    parts = table(spark, d, "part").select(
        F.lit("Customer").alias("label"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.lit("part").alias("description"))
    return G.merge_nodes(_nodes(spark, d), named.unionByName(parts))


@query("kg_merged_edges", f"WITH {_EDGES} SELECT DISTINCT src, dst, rel FROM ke")
def kg_merged_edges(spark, d):
    lost = table(spark, d, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("src"), F.lit("nowhere").alias("dst"),
        F.lit("CAUSES").alias("rel"))
    twice = _id_edges(spark, d)
    return G.merge_edges(_nodes(spark, d), twice.unionByName(twice).unionByName(lost))


@query("kg_triples", """
WITH t AS (SELECT o_orderkey, 'cust ' || o_custkey AS src, CASE WHEN o_custkey % 5 = 0 THEN 'Other' ELSE 'Symptom' END AS sl,
   CASE WHEN o_orderkey % 4 = 0 THEN 'UNKNOWN' ELSE 'SYMPTOM_OF' END AS rel, o_orderpriority AS dst FROM orders WHERE o_orderstatus <> 'F')
SELECT DISTINCT src, dst, rel FROM t WHERE rel = 'SYMPTOM_OF'
  AND src IN (SELECT src FROM t WHERE sl = 'Symptom')""")
def kg_triples(spark, d):
    nodes = spark.createDataFrame([], G.NODE_SCHEMA)
    edges = spark.createDataFrame([], G.EDGE_SCHEMA)
    return G.load_triples(_order_triples(spark, d), nodes, edges)[1]


def _order_triples(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("cust "), F.col("o_custkey").cast("string")).alias("src"),
        F.when(F.col("o_custkey") % 5 == 0, "Other").otherwise("Symptom").alias("src_label"),
        F.when(F.col("o_orderkey") % 4 == 0, "UNKNOWN").otherwise("SYMPTOM_OF").alias("rel"),
        F.col("o_orderpriority").alias("dst"), F.lit("Condition").alias("dst_label"),
        F.when(F.col("o_orderstatus") == "F", "failed").alias("error"))


def _loaded(nodes, edges, stats, **marks):
    """Nodes, edges and statistics of a load as rows of one shape."""
    rows = (
        nodes.select(F.lit("node").alias("kind"), F.col("label").alias("a"), F.col("name").alias("b"), F.lit("").alias("c"))
        .unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("rel").alias("c")))
        .unionByName(stats.select(F.lit("load").alias("kind"), F.col("processed_docs").cast("string").alias("a"),
                                  F.col("failed_docs").cast("string").alias("b"), F.lit("").alias("c"))))
    return rows.select("*", *[F.lit(v).alias(k) for k, v in marks.items()])


@query("kg_load", f"""WITH {_NODES}, {_EDGES},
t AS (SELECT o_orderkey, o_orderstatus = 'F' AS failed, 'cust ' || o_custkey AS src, CASE WHEN o_custkey % 5 = 0 THEN 'Other' ELSE 'Symptom' END AS sl,
   CASE WHEN o_orderkey % 4 = 0 THEN 'UNKNOWN' ELSE 'SYMPTOM_OF' END AS rel, o_orderpriority AS dst FROM orders),
n AS (SELECT DISTINCT label, name FROM (SELECT sl AS label, src AS name, failed FROM t UNION ALL SELECT 'Condition', dst, failed FROM t) WHERE label <> 'Other' AND NOT failed),
e AS (SELECT DISTINCT src, dst, rel FROM t WHERE rel = 'SYMPTOM_OF' AND NOT failed AND src IN (SELECT name FROM n WHERE label = 'Symptom')),
s AS (SELECT count(DISTINCT o_orderkey) FILTER (NOT failed)::VARCHAR AS p, count(DISTINCT o_orderkey) FILTER (failed)::VARCHAR AS f FROM t)
SELECT 'node' AS kind, label AS a, name AS b, '' AS c, true AS reset FROM n UNION ALL SELECT 'edge', src, dst, rel, true FROM e UNION ALL SELECT 'load', p, f, '', true FROM s
UNION ALL SELECT 'node', label, name, '', false FROM n UNION ALL SELECT 'node', label, name, '', false FROM kn
UNION ALL SELECT 'edge', src, dst, rel, false FROM e UNION ALL SELECT DISTINCT 'edge', src, dst, rel, false FROM ke UNION ALL SELECT 'load', p, f, '', false FROM s""")
def kg_load(spark, d):
    """Triples of the orders loaded into the graph of the tables, and instead of it."""
    triples = _order_triples(spark, d)
    both = [_loaded(*G.load_triples(triples, _nodes(spark, d), _edges(spark, d), reset=reset), reset=reset) for reset in (True, False)]
    return both[0].unionByName(both[1])


@query("kg_extracted", f"""WITH {KO_DOCS}, d AS (SELECT doc_id, text, length(text) > 8000 AS failed FROM kodocs),
x AS (SELECT unnest(string_split(text, '요 ')) AS l FROM d WHERE NOT failed),
e AS (SELECT DISTINCT s, c FROM x, {sql_values([[s] for s in X.SYMPTOMS], 's(s)')}, {sql_values([[c] for c in X.CONDITIONS], 'c(c)')} WHERE contains(l, s) AND contains(l, c))
SELECT 'node' AS kind, 'Symptom' AS a, s AS b, '' AS c FROM (SELECT DISTINCT s FROM e) UNION ALL SELECT 'node', 'Condition', c, '' FROM (SELECT DISTINCT c FROM e)
UNION ALL SELECT 'edge', s, c, 'SYMPTOM_OF' FROM e
UNION ALL SELECT 'load', count(*) FILTER (NOT failed)::VARCHAR, count(*) FILTER (failed)::VARCHAR, '' FROM d""")
def kg_extracted(spark, d):
    """Triples that an extractor finds in care talk rendered from all documents, loaded into an empty graph."""
    talk = table(spark, d, "documents").select("doc_id", korean("text").alias("text"))
    triples = X.extract_triples(talk, lambda: X.SentencePairs(X.SYMPTOMS, X.CONDITIONS, 8000, '요 '))
    return _loaded(*G.load_triples(
        written(triples, "triples"), spark.createDataFrame([], G.NODE_SCHEMA), spark.createDataFrame([], G.EDGE_SCHEMA)))


@query("kg_profile", f"""WITH {_NODES}, {_EDGES},
e AS (SELECT dst AS condition, src AS other, 'symptom' AS kind FROM ke WHERE rel = 'SYMPTOM_OF'
  UNION ALL SELECT src, dst, 'treatment' FROM ke WHERE rel = 'MANAGED_BY' UNION ALL SELECT src, dst, 'body_part' FROM ke WHERE rel = 'AFFECTS')
SELECT DISTINCT condition, c.description AS condition_description, kind, other AS name, o.description AS description
FROM e JOIN kn c ON c.name = condition AND c.label = 'Nation' JOIN kn o ON o.name = other""")
def kg_profile(spark, d):
    return G.condition_profile(_nodes(spark, d), _edges(spark, d), "Nation", "Region")


@query("kg_symptom_conditions", f"""WITH {_NODES}, {_EDGES}, k AS (SELECT DISTINCT right(c_name, 2) AS keyword FROM customer)
SELECT DISTINCT keyword, dst AS condition FROM k JOIN kn ON label = 'Customer' AND (contains(name, keyword) OR contains(id, keyword))
JOIN ke ON src = name AND rel = 'SYMPTOM_OF'""")
def kg_symptom_conditions(spark, d):
    keywords = table(spark, d, "customer").select(F.substring("c_name", -2, 2).alias("keyword")).distinct()
    return G.symptom_conditions(keywords, _nodes(spark, d), _edges(spark, d), symptom="Customer", condition="Nation")


_M = """m AS (SELECT src AS a, dst AS b, src || chr(1) || rel || chr(1) || dst AS e FROM k0 UNION ALL SELECT dst, src, src || chr(1) || rel || chr(1) || dst FROM k0)"""


@query("kg_related", f"""WITH {_NODES}, {_EDGES}, k0 AS (SELECT DISTINCT * FROM ke), {_M},
s AS (SELECT DISTINCT r_name AS keyword, name AS start FROM region JOIN kn ON contains(name, r_name) OR contains(id, r_name) OR contains(description, r_name)),
s5 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY start) <= 5),
h1 AS (SELECT keyword, start, b AS at_, [e] AS path FROM s5 JOIN m ON a = start),
h2 AS (SELECT keyword, start, b AS at_, list_append(path, e) AS path FROM h1 JOIN m ON a = at_ WHERE NOT list_contains(path, e)),
h3 AS (SELECT keyword, start, b AS at_, path FROM h2 JOIN m ON a = at_ WHERE NOT list_contains(path, e)),
u AS (SELECT DISTINCT keyword, at_ AS name, dist::INT AS distance FROM (SELECT *, 1 AS dist FROM h1 UNION ALL SELECT *, 2 FROM h2
   UNION ALL SELECT *, 3 FROM h3) WHERE at_ <> start),
r AS (SELECT DISTINCT keyword, u.name, label AS type, description, distance FROM u JOIN kn ON kn.name = u.name)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY distance, name, type) <= 20""")
def kg_related(spark, d):
    keywords = table(spark, d, "region").select(F.col("r_name").alias("keyword"))
    return G.related_nodes(keywords, _nodes(spark, d), _edges(spark, d), depth=3)


@query("graph_context")
def graph_context(spark, d):
    nodes, edges = G.seed_graph(spark)
    names = [n for n, _, _ in G.G.NODES]
    turns = korean_turns(table(spark, d, "conversations")).select(
        F.concat_ws("-", "conv_id", "turn").alias("turn_id"),
        G.hybrid_keywords(G.rule_keywords("text", names)).alias("keywords"))
    return G.graph_context(turns, nodes, edges, "turn_id")


# ---- vectors -------------------------------------------------------------------------

_CENTROIDS = """x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
a AS (SELECT label, i, avg(v) AS v FROM x GROUP BY ALL), ce AS (SELECT label, list(v ORDER BY i) AS c FROM a GROUP BY label)"""


def _centroids(spark, d):
    parts = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("embedding"))


_SCORED = f"""{_CENTROIDS}, sc AS (SELECT ce.label AS query_id, vec_id, embeddings.label AS label,
  round(list_cosine_similarity(c, embedding::DOUBLE[]), 6) AS score FROM ce, embeddings)"""


@query("vector_topk", f"""WITH {_SCORED}, r AS (SELECT query_id, vec_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM sc)
SELECT query_id, vec_id, score, rank, round(1 - score, 6) AS distance FROM r WHERE rank <= 5""")
def vector_topk(spark, d):
    queries = _centroids(spark, d).withColumnRenamed("label", "query_id")
    return V.top_k(queries, table(spark, d, "embeddings"), 5)


@query("vector_index_topk", f"""WITH {_SCORED}, r AS (SELECT query_id, vec_id, score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM sc)
SELECT query_id, vec_id, score, rank, round(1 - score, 6) AS distance FROM r WHERE rank <= 5""")
def vector_index_topk(spark, d):
    """The nearest lists, then every list that could hold a better row."""
    queries = _centroids(spark, d).withColumnRenamed("label", "query_id")
    index = VI.build(table(spark, d, "embeddings"), work_folder(spark, "index"))
    return VI.search(index, queries, 5, probes=2, exact=True).hits


@query("vector_filtered", f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sc)
SELECT query_id, vec_id, score, rank::INT AS rank, left('text of ' || vec_id::VARCHAR || repeat('.', 400), 300) AS text FROM r
WHERE rank <= 10 AND label % 2 = 0""")
def vector_filtered(spark, d):
    vectors = table(spark, d, "embeddings")
    docs = vectors.select(
        "vec_id", F.concat(F.lit("text of "), F.col("vec_id").cast("string"), F.repeat(F.lit("."), 400)).alias("text"),
        F.when(F.col("label") % 2 == 0, "healthcare_docs").otherwise("conversations").alias("category"))
    queries = _centroids(spark, d).withColumnRenamed("label", "query_id")
    return V.retrieve(V.top_k(queries, vectors, 10), docs).select("query_id", "vec_id", "score", "rank", "text")


@query("vector_gap_match", f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, query_id) AS rank,
   count(*) OVER (PARTITION BY vec_id) AS n FROM sc),
g AS (SELECT vec_id, max(n) AS n, max(score) FILTER (rank = 1) - max(score) FILTER (rank = 4) AS gap FROM r GROUP BY vec_id)
SELECT vec_id, query_id AS name, score FROM r JOIN g USING (vec_id) WHERE rank <= 2 AND score >= 0.2 AND NOT (g.n > 3 AND gap < 0.04)""")
def vector_gap_match(spark, d):
    names = _centroids(spark, d).withColumnRenamed("label", "name")
    scored = V.score_candidates(table(spark, d, "embeddings"), names)
    matched = V.match_with_gap(scored, threshold=0.2)
    return unpack(matched, ["vec_id"], F.col("matches"), "id").withColumnRenamed("id", "name")


@query("cosine_matrix", f"WITH {_SCORED} SELECT vec_id, query_id AS name, score FROM sc")
def cosine_matrix(spark, d):
    names = _centroids(spark, d).withColumnRenamed("label", "name")
    return V.cosine_pairs(table(spark, d, "embeddings"), names, "vec_id", "name")


@query("embedded_turns")
def embedded_turns(spark, d):
    vectors = V.embed()("text")
    return table(spark, d, "conversations").select("conv_id", "turn", vectors.alias("embedding"))


# ---- schedules -----------------------------------------------------------------------

_NOWS = "w AS (SELECT event_id, user_id, (hour(ts) * 60 + minute(ts))::INT AS now_min FROM events)"


def _nows(spark, d):
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("nickname"), CA.minute_of_day(F.col("ts")).alias("now_min"))


@query("due_medications", f"""WITH {_NOWS}, u AS (SELECT DISTINCT user_id FROM events WHERE user_id % 4 <> 0),
t AS (SELECT user_id, 'med ' || user_id::VARCHAR AS medication, unnest([(user_id * 37) % 1440, (user_id * 37 + 700) % 1440]) AS m FROM u),
j AS (SELECT event_id, w.user_id AS nickname, now_min, medication, m::INT AS scheduled_min, ((m - now_min + 5 + 1440) % 1440) - 5 AS dist FROM w JOIN t USING (user_id))
SELECT event_id, nickname, now_min, medication, scheduled_min, dist < 0 AS is_overdue FROM j WHERE dist <= 30""")
def due_medications(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("nickname")).distinct()

    def clock(shift):
        m = (F.col("nickname") * 37 + shift) % 1440
        return F.format_string("%02d:%02d", F.floor(m / 60), m % 60)

    meds = users.select(
        "nickname", F.concat(F.lit("med "), F.col("nickname").cast("string")).alias("name"),
        F.array(clock(0), clock(700)).alias("times"), (F.col("nickname") % 4 != 0).alias("is_active"))
    return CA.due_medications(_nows(spark, d), meds)


_ROUTINE = sql_values([[i, a, s, m, t] for i, a, s, m, t, _ in care.ROUTINE], "r(i, activity, start_min, dur, description)")


@query("current_activity", f"""WITH {_NOWS}, c AS (SELECT event_id, now_min, activity, description, (start_min + dur) % 1440 - now_min AS m, i FROM w,
  {_ROUTINE} WHERE (now_min - start_min + 1440) % 1440 <= dur QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY i) = 1)
SELECT event_id, activity, description, ((m + 1440) % 1440)::INT AS minutes_remaining FROM c""")
def current_activity(spark, d):
    return _nows(spark, d).withColumn("x", CA.current_activity(F.col("now_min"))).filter(
        "x is not null").select("event_id", "x.activity", "x.description", "x.minutes_remaining")


@query("next_activity", f"""WITH {_NOWS}, c AS (SELECT event_id, now_min, activity, description, start_min, start_min <= now_min AS tomorrow FROM w, {_ROUTINE}
  QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY start_min <= now_min, i) = 1)
SELECT event_id, activity, description, tomorrow AS is_tomorrow, ((start_min - now_min + 1440) % 1440)::INT AS minutes_until FROM c""")
def next_activity(spark, d):
    return _nows(spark, d).withColumn("x", CA.next_activity(F.col("now_min"))).select(
        "event_id", "x.activity", "x.description", "x.is_tomorrow", "x.minutes_until")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'completed' WHEN 'error' THEN 'skipped' ELSE 'open' END"


@query("daily_summary", f"""WITH l AS (SELECT user_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, event_type, {_STATUS} AS status FROM events)
SELECT user_id, day, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (status = 'completed'), '') AS completed,
  coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (status = 'skipped'), '') AS skipped,
  coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (status = 'open'), '') AS pending,
  round(count(*) FILTER (status = 'completed') / 11.0::DOUBLE, 6) AS completion_rate, count(*) FILTER (status <> 'open')::INT AS total_activities
FROM l GROUP BY ALL""")
def daily_summary(spark, d):
    from careline.functions.text import kst

    log = table(spark, d, "events").select(
        "user_id", F.date_format(kst(F.col("ts").cast("timestamp")), "yyyy-MM-dd").alias("day"),
        F.col("event_type").alias("activity"), F.expr(_STATUS).alias("status"))
    required = sum(1 for r in care.ROUTINE if r[5])
    out = CA.daily_summary(log, ["user_id", "day"], required)
    for c in ("completed", "skipped", "pending"):
        out = out.withColumn(c + "_", F.array_join(c, ","))
    return out.select(
        "user_id", "day", F.col("completed_").alias("completed"), F.col("skipped_").alias("skipped"),
        F.col("pending_").alias("pending"), F.round("completion_rate", 6).alias("completion_rate"), "total_activities")


@query("adherence", """
WITH u AS (SELECT DISTINCT user_id FROM events), l AS (SELECT user_id, value > 10 AS taken FROM events
  WHERE ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'purchase'),
r AS (SELECT user_id, count(*) AS doses, avg(taken::INT) AS rate FROM l GROUP BY user_id)
SELECT user_id AS nickname, coalesce(doses, 0) AS doses, round(coalesce(rate, 0.0), 6)::DOUBLE AS adherence_rate FROM u LEFT JOIN r USING (user_id)""")
def adherence(spark, d):
    events = table(spark, d, "events").withColumnRenamed("user_id", "nickname")
    log = events.filter("event_type = 'purchase'").select(
        "nickname", F.col("ts").alias("scheduled_time"), (F.col("value") > 10).alias("was_taken"))
    out = CA.adherence(log, events, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return out.withColumn("adherence_rate", F.round("adherence_rate", 6))


@query("activity_rollup", f"""
WITH r AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL),
h AS (SELECT *, floor(date_diff('second', date_trunc('second', last), TIMESTAMP '2024-02-01 00:00:00') / 3600)::INT AS hrs FROM r)
SELECT user_id, event_type, n, strftime(last, '%Y-%m-%d %H:%M:%S') AS last_time, CASE WHEN hrs < 1 THEN {q(care.AGE_NOW)}
  WHEN hrs < 24 THEN hrs::VARCHAR || {q(care.AGE_HOURS)} ELSE (hrs // 24)::VARCHAR || {q(care.AGE_DAYS)} END AS age FROM h""")
def activity_rollup(spark, d):
    log = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return CA.activity_rollup(
        log, ["user_id", "event_type"], "ts", F.lit("2024-02-01 00:00:00").cast("timestamp")
    ).withColumn("last_time", F.date_format("last_time", "yyyy-MM-dd HH:mm:ss"))


@query("grouped_neighbours", f"""WITH {_NODES}, {_EDGES}, k0 AS (SELECT DISTINCT * FROM ke), {_M},
s AS (SELECT DISTINCT n_name AS keyword, name AS start FROM nation JOIN kn ON contains(name, n_name) OR contains(id, n_name) OR contains(description, n_name)),
s5 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY start) <= 5),
h1 AS (SELECT keyword, start, b AS at_, [e] AS path FROM s5 JOIN m ON a = start),
h2 AS (SELECT keyword, start, b AS at_ FROM h1 JOIN m ON a = at_ WHERE NOT list_contains(path, e)),
u AS (SELECT DISTINCT keyword, at_ AS name, dist FROM (SELECT keyword, start, at_, 1 AS dist FROM h1 UNION ALL SELECT *, 2 FROM h2) WHERE at_ <> start),
r AS (SELECT DISTINCT keyword, u.name, label AS type, description, dist FROM u JOIN kn ON kn.name = u.name),
n AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY dist, name, type) <= 20),
t AS (SELECT *, row_number() OVER (PARTITION BY keyword, type ORDER BY dist, name) AS i FROM n)
SELECT keyword, type, string_agg(name || '(' || coalesce(description, '') || ')', ', ' ORDER BY i) AS names FROM t
WHERE i <= {G.G.NAMES_PER_TYPE} GROUP BY ALL""")
def grouped_neighbours(spark, d):
    keywords = table(spark, d, "nation").select(F.col("n_name").alias("keyword"))
    return G.group_by_type(G.related_nodes(keywords, _nodes(spark, d), _edges(spark, d), 2))


