"""Graph, vector, schedule, report and file operators on small inputs."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from careline.operators import care as CA
from careline.operators import extraction as X
from careline.operators import graph as G
from careline.operators import reports as R
from careline.operators import retrieval as V
from careline.operators import vector_index as VI
from careline.operators import upserts as U
from careline.sources import files as FS
from careline.sources import tables as S


# ---- graph ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def seed(spark):
    nodes, edges = G.seed_graph(spark)
    return nodes.cache(), edges.cache()


def test_seed_graph(seed):
    assert G.graph_stats(*seed).first() == (97, 87)
    assert G.merge_edges(*seed).count() == 87


def test_profile_of_a_condition(seed):
    rows = G.condition_profile(*seed).filter("condition = '골다공증'").collect()
    assert {(r.kind, r["name"]) for r in rows} == {
        ("symptom", "뼈 통증"), ("treatment", "칼슘 섭취"), ("treatment", "낙상 예방"),
        ("prevention", "규칙적 운동"), ("body_part", "뼈")}


def test_graph_context(spark, seed):
    rows = [(1, ["불면증"]), (2, ["당뇨"]), (3, ["금연"]), (4, ["발톱 변형", "요실금", "변비"]), (5, ["없는 말"])]
    df = spark.createDataFrame(rows, "i int, keywords array<string>")
    out = {r.i: r.graph_context for r in G.graph_context(df, *seed, "i").collect()}
    assert out[1].startswith("▶ 수면장애: 고령자 수면 장애\n  증상: 불면증, 수면 패턴 변화, 주간 졸림\n  관리: ")
    assert out[2].startswith("▶ 당뇨: 혈당 조절 이상\n  증상: 갈증, 고혈당, 빈뇨, 저혈당")
    assert out[3] == "▶ '금연' 관련 정보:\n  관련 질환: 폐질환(만성 폐쇄성 폐질환 등)\n  관련 증상: " \
        "가래(가래가 많은 증상), 만성기침(오래 지속되는 기침), 호흡곤란(숨이 차는 증상)\n  관리 방법: 호흡 운동(복식 호흡, 입술 오므리기 호흡)"
    assert out[4].count("▶") == 3 and "▶ 내향성 발톱" in out[4] and 5 not in out


def test_hybrid_keywords(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], ["z"]), ([], [], ["z"])], "r array<string>, e array<string>, f array<string>")
    out = [r[0] for r in df.select(G.hybrid_keywords(F.col("r"), F.col("e"), F.col("f"))).collect()]
    assert out == [["a", "b", "c"], ["z"]]


def test_triples_are_filtered_and_counted(spark, seed):
    t = spark.createDataFrame(
        [("d1", "새 증상", "Symptom", "SYMPTOM_OF", "당뇨", "Condition", None), ("d1", "x", "Person", "RELATED_TO", "당뇨", "Condition", None),
         ("d1", "갈증", "Symptom", "LIKES", "당뇨", "Condition", None), ("d2", "q", "Symptom", "SYMPTOM_OF", "당뇨", "Condition", "timeout")],
        "doc_id string, src string, src_label string, rel string, dst string, dst_label string, error string")
    nodes, edges, stats = G.load_triples(t, *seed)
    assert (nodes.count(), edges.count(), tuple(stats.first())) == (98, 88, (1, 1))


@pytest.mark.parametrize("ways", [{}, {"held": 0}, {"held": 0, "hub": 2}, {"held": 0, "width": 1, "hub": 1}])
def test_contains_join_is_complete(spark, ways):
    words = ["a", "ab", "abc", "abcd", "bc", "", "다", "나다"]
    texts = ["abcd", "xabc", "b", "가나다라", ""]
    left = spark.createDataFrame([(w,) for w in words], "w string")
    right = spark.createDataFrame([(t,) for t in texts], "t string")
    have = {tuple(r) for r in G.contains_join(left, right, "w", "t", **ways).collect()}
    assert have == {(w, t) for w in words for t in texts if w and w in t}


def test_a_failed_document_is_one_row(spark):
    docs = spark.createDataFrame([(1, "기침 당뇨\n기침 변비 당뇨"), (2, "x" * 31), (3, None), (3, "두통"), (None, "무릎 치매")], "doc_id long, text string")
    rows = X.extract_triples(docs.repartition(2), lambda: X.SentencePairs(X.SYMPTOMS, X.CONDITIONS, 30)).collect()
    assert sorted(((r.doc_id, r.src, r.dst) for r in rows if r.src), key=str) == [
        (1, "기침", "당뇨"), (1, "기침", "변비"), (None, "무릎", "치매")]
    assert [(r.doc_id, r.error) for r in rows if r.error] == [(2, "ValueError: more than 30 characters")]
    assert [r.doc_id for r in rows if r.src is None and r.error is None] == [3, 3]
    nodes, edges, stats = G.load_triples(spark.createDataFrame(rows, "doc_id long, " + X.TRIPLE), *(
        spark.createDataFrame([], s) for s in (G.NODE_SCHEMA, G.EDGE_SCHEMA)))
    assert (nodes.count(), edges.count(), tuple(stats.first())) == (5, 3, (2, 1))


# ---- vectors -------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(5)
    mat = rnd.normal(size=(200, 8))
    mat[7] = mat[3]  # a tie
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(mat)], "vec_id long, embedding array<float>")
    return mat.astype(np.float32).astype(float), df.repartition(6).cache()


#: A side that is shipped, and tiles of both.
CARRIERS = [{}, {"held_rows": 10, "tile_rows": 1000}, {"held_rows": 10, "tile_rows": 30}]


@pytest.mark.parametrize("ways", CARRIERS)
def test_top_k_on_all_carriers(vectors, ways):
    mat, df = vectors
    out = V.top_k(df.withColumnRenamed("vec_id", "query_id"), df, 3, **ways).collect()
    unit = mat / np.linalg.norm(mat, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    want = {(q, int(v), r + 1) for q in range(200)
            for r, v in enumerate(sorted(range(200), key=lambda v: (-scores[q, v], v))[:3])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in out} == want


def test_gap_rule(spark):
    names = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0]), ("d", [0.0, -1.0])], "name string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    out = {r.vec_id: [m.id for m in r.matches] for r in V.match_with_gap(V.score_candidates(q, names)).collect()}
    assert out == {1: ["a"], 2: []}


def test_many_candidates(spark, vectors):
    _, df = vectors
    names = df.select(F.concat(F.lit("n"), F.lpad(F.col("vec_id").cast("string"), 3, "0")).alias("name"), "embedding")
    some = [V.score_candidates(df, names, **ways) for ways in CARRIERS]
    assert all(some[0].exceptAll(other).count() == 0 and other.count() == 200 for other in some)


def test_few_queries_do_not_move_the_vectors(spark, vectors):
    mat, df = vectors
    few = df.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id")
    found = V.top_k(few, df, 3, held_rows=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FlatMapCoGroups" not in plan  # of k rows per query and task
    want = V.top_k(few, df, 3, held_rows=0)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    assert V.top_k(few.limit(0), df, 3, held_rows=100).count() == 0 == V.top_k(few, df.limit(0), 3).count()
    held = V.top_k(df.withColumnRenamed("vec_id", "query_id"), few.withColumnRenamed("query_id", "vec_id"), 3)
    assert "Exchange hashpartitioning" not in held._jdf.queryExecution().executedPlan().toString()


# ---- vector index --------------------------------------------------------------------

@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """20,000 rows in uneven clusters (one holds a third of all), with rows without an id or a vector, zeros and repeats."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 24))
    of = np.where(rng.random(20_000) < 0.33, 0, rng.integers(0, 60, 20_000))
    mat = (centres[of] + 0.35 * rng.normal(size=(20_000, 24))).astype(np.float32)
    mat[:3] = 0
    mat[100:120] = mat[99]
    rows = [(i, v.tolist()) for i, v in enumerate(mat)] + [(None, [1.0] * 24), (20_000, None)]
    path = str(tmp_path_factory.mktemp("index"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6).write.parquet(f"{path}/in")
    df = spark.read.parquet(f"{path}/in")
    return mat, df, VI.build(df, f"{path}/index", sample_rows=4000)


def test_every_row_is_indexed(spark, clustered):
    mat, df, index = clustered
    stored = spark.read.parquet(f"{index.path}/lists")
    assert index.rows.sum() == stored.count() == len(mat) == stored.select("vec_id").distinct().count()
    assert 100 < len(index.rows) <= 141 and index.size.sum() == len(mat) * 24 * 4
    unit = mat / (np.linalg.norm(mat, axis=1, keepdims=True) + 1e-10)
    for r in stored.filter("vec_id % 997 = 0").collect():
        scores = unit[r.vec_id] @ index.centroids.T
        at = index.numbers.tolist().index(r.list)
        assert abs(scores.max() - scores[at]) < 1e-6 and abs(r.near - scores[at]) < 1e-6 and index.widest[at] <= r.near


@pytest.mark.parametrize("probes, least", [(1, 0.5), (8, 0.9), (10**6, 1.0)])
def test_recall_and_costs(spark, clustered, probes, least):
    """Every row whose id is divisible by 100 against all rows."""
    mat, df, index = clustered
    queries = df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    found = VI.search(index, queries, 10, probes)
    want = {(r.query_id, r.vec_id) for r in V.top_k(queries, df, 10).collect()}
    got = {(r.query_id, r.vec_id) for r in found.hits.collect()}
    assert len(want) == 2000 and len(got & want) / len(want) >= least
    costs = found.costs.collect()
    assert len(costs) == 200 and {r.lists for r in costs} == {min(probes, len(index.rows))}
    assert all(r.bytes == r.rows * 96 and r.all_rows == len(mat) for r in costs)
    if probes < 100:
        assert sum(r.rows for r in costs) < 0.4 * sum(r.all_rows for r in costs)


def test_exact_search_reads_what_it_must(spark, clustered):
    mat, df, index = clustered
    queries = df.filter("vec_id % 100 = 0 OR vec_id IN (1, 99, 105)").withColumnRenamed("vec_id", "query_id")
    found = VI.search(index, queries, 25, 1, exact=True)
    assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, V.top_k(queries, df, 25).collect()))
    near = [r.rows / r.all_rows for r in found.costs.collect() if r.query_id not in (0, 1)]  # a zero vector is near to none
    assert np.mean(near) < 0.9
    scan = VI.probe(spark, index, *V.held_side(queries.filter("embedding IS NOT NULL"), "query_id", "embedding"), np.eye(len(near) + 2, len(index.rows), dtype=bool), 3,
                    "query_id bigint, vec_id bigint, score double")
    assert "PartitionFilters: [list" in scan._jdf.queryExecution().executedPlan().toString()


def test_index_of_odd_tables(spark, tmp_path):
    schema = "vec_id string, embedding array<double>"
    few = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 0.0])], schema)
    index = VI.build(few, f"{tmp_path}/few")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (3, None)], "query_id int, embedding array<double>")
    hits = VI.search(index, queries, 2, exact=True).hits.collect()
    assert sorted((r.query_id, r.vec_id, r.score, r["rank"]) for r in hits) == [
        (1, "a", 1.0, 1), (1, "b", 1.0, 2), (2, "a", 0.0, 1), (2, "b", 0.0, 2)]
    none = VI.build(few.limit(0), f"{tmp_path}/none")
    assert VI.search(none, queries).hits.count() == 0
    assert VI.search(index, queries.limit(0)).hits.count() == 0


def test_queries_in_blocks(spark, clustered, monkeypatch):
    mat, df, index = clustered
    queries = df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    want = VI.search(index, queries, 5, 4)
    monkeypatch.setattr(VI, "HELD_ROWS", 100)
    found = VI.search(index, queries, 5, 4)
    assert sorted(map(tuple, found.hits.collect())) == sorted(map(tuple, want.hits.collect()))
    assert sorted(map(tuple, found.costs.collect())) == sorted(map(tuple, want.costs.collect()))


@pytest.mark.parametrize("ways", [{}, {"held_rows": 0, "tile_rows": 1}, {"held_rows": 0}])
def test_candidates_without_a_vector_do_not_count(spark, ways):
    schema = "name string, embedding array<float>"
    names = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0]), (None, [1.0, 1.0])], schema)
    q = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "vec_id long, embedding array<float>")
    rows = V.score_candidates(q, names, **ways).collect()
    assert [(r.vec_id, r.n_candidates, [b.id for b in r.best]) for r in rows] == [(1, 2, ["a", "c"])]
    none = V.score_candidates(q, names.filter("embedding IS NULL")).collect()
    assert [(r.vec_id, r.n_candidates, r.best) for r in none] == [(1, 0, [])]


def test_more_candidates_than_a_collect_would_hold(spark):
    many = spark.range(21_000).selectExpr("id AS vec_id", "array(cos(id), sin(id), 1D) AS embedding")
    pairs = V.cosine_pairs(many.filter("vec_id < 3").withColumnRenamed("vec_id", "query_id"), many)
    assert pairs.count() == 63_000
    best = V.top_k(many.filter("vec_id < 40").withColumnRenamed("vec_id", "query_id"), many, 1).collect()
    assert len(best) == 40 and all(r.score == 1 and r.vec_id <= r.query_id for r in best)


def test_category_drop_after_ranking(spark, vectors):
    _, df = vectors
    docs = df.select("vec_id", F.lit("t" * 400).alias("text"), F.when(F.col("vec_id") % 2 == 0, "conversations").alias("category"))
    out = V.retrieve(V.top_k(df.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id"), df, 5), docs)
    assert out.filter("vec_id % 2 = 0").count() == 0 and 0 < out.count() < 25
    assert out.agg(F.max(F.length("text"))).first()[0] == 300


def test_embedding_slot(spark):
    df = spark.createDataFrame([("무릎 통증",), ("무릎 통증 심함",), ("날씨",), (None,)], "t string")
    a, b, c, _ = [np.array(r[0]) for r in df.select(V.embed()("t")).collect()]
    assert len(a) == 384 and a @ b > a @ c


# ---- schedules -----------------------------------------------------------------------

@pytest.mark.parametrize("now,current,following", [
    (420, ("wake_up", 30), ("breakfast", 60, False)), (450, ("wake_up", 0), ("breakfast", 30, False)),
    (451, None, ("breakfast", 29, False)), (1380, None, ("wake_up", 480, True))])
def test_routine(spark, now, current, following):
    df = spark.createDataFrame([(now,)], "m int")
    r = df.select(CA.current_activity(F.col("m")).alias("c"), CA.next_activity(F.col("m")).alias("n")).first()
    assert (r.c and (r.c.activity, r.c.minutes_remaining)) == current
    assert (r.n.activity, r.n.minutes_until, r.n.is_tomorrow) == following


def test_overnight_item(spark):
    items = spark.createDataFrame([("u", "night", 1410, 60, "", True)],
                                  "nickname string, activity string, start_min int, duration_min int, description string, is_required boolean")
    r = CA.pack_routines(items).select(CA.current_activity(F.lit(15), F.col("routine")).alias("c")).first()
    assert (r.c.activity, r.c.minutes_remaining) == ("night", 15)


def test_due_around_midnight(spark):
    meds = spark.createDataFrame([("u", "m", ["00:10", "23:56", "12:00"], True), ("u", "x", ["00:00"], False)],
                                 "nickname string, name string, times array<string>, is_active boolean")
    now = spark.createDataFrame([("u", 1439), ("u", 2)], "nickname string, now_min int")
    out = sorted((r.now_min, r.scheduled_min, r.is_overdue) for r in CA.due_medications(now, meds).collect())
    assert out == [(2, 10, False), (1439, 10, False), (1439, 1436, True)]


def test_mood_and_history(spark):
    rows = spark.createDataFrame([("u", "good", 14, None, "2024-01-02"), ("u", "bad", 0, "비", "2024-01-03")],
                                 "nickname string, mood string, energy_level int, notes string, timestamp string")
    moods = CA.mood_log(rows)
    assert [tuple(r) for r in moods.select("energy_level", "text").collect()] == [
        (10, "기분: good, 에너지: 14/10"), (1, "기분: bad, 에너지: 0/10, 메모: 비")]
    symptoms = spark.createDataFrame([("u", f"s{i:02d}", f"2024-02-{i + 1:02d}") for i in range(20)], "nickname string, symptoms string, timestamp string")
    last = CA.symptom_history(symptoms, moods, last=5).collect()
    assert sorted(r.symptoms or r.mood for r in last) == ["bad", "good", "s17", "s18", "s19"]


# ---- reports and writes --------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 5, 40, 101])
def test_nearest_rank(spark, n):
    rows = spark.createDataFrame([("a", float((i * 37) % 50)) for i in range(n)], "k string, v double")
    r = R.latency_stats(rows, ["k"], "v", buckets=8).first()
    values = sorted(float((i * 37) % 50) for i in range(n))
    assert (r.n, r.p50, r.p95) == (n, values[round(0.5 * (n - 1))], values[round(0.95 * (n - 1))])


def test_consent_clears_only_existing_rows(spark):
    schema = ("nickname string, name string, age int, conditions string, emergency_contact string, notes string, "
              "health_info_consent boolean")
    t = datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "A", 80, "당뇨", "1", "n", True, t, t), ("b", "B", 70, "x", "2", "m", True, t, t)],
                                schema + ", created_at timestamp, updated_at timestamp")
    new = spark.createDataFrame([("a", None, 81, "새", None, None, False, True), ("c", "C", None, "y", None, "z", None, True)],
                                schema + ", clear_health_info boolean")
    out = {r.nickname: r for r in U.upsert_profiles(old, new, F.lit("2024-06-01").cast("timestamp")).collect()}
    assert (out["a"]["name"], out["a"].age, out["a"].conditions, out["a"].notes, out["a"].health_info_consent) == ("A", 81, None, None, False)
    assert (out["c"].conditions, out["c"].notes) == ("y", "z") and out["b"].updated_at == t and out["b"].notes == "m"


def test_add_columns_and_create_once(spark, tmp_path):
    from pyspark.sql.types import StructType

    df = U.ensure_columns(spark.range(2), StructType.fromDDL("id bigint, extra string"))
    assert df.columns == ["id", "extra"] and df.filter("extra is null").count() == 2
    spark.sql(f"CREATE DATABASE made LOCATION '{tmp_path}/made'")
    name = "made.once"
    schema = StructType.fromDDL("id bigint")
    assert U.create_if_absent(spark, name, schema) and not U.create_if_absent(spark, name, schema)
    spark.sql("DROP DATABASE made CASCADE")


def test_level_accuracy_and_preservation(spark):
    df = spark.createDataFrame([(3, 2, ["혈압"], "혈압"), (0, 1, ["당뇨", "수면"], "수면")], "a int, e int, t array<string>, r string")
    assert R.level_accuracy(df, F.col("a"), F.col("e")).first() == (2, 0.5)
    assert R.preservation_rate(df, F.col("t"), F.col("r")).first() == (3, 2, 2 / 3)


# ---- files ---------------------------------------------------------------------------

def test_files(spark, tmp_path):
    (tmp_path / "c" / "sub").mkdir(parents=True)
    (tmp_path / "c" / "건강 가이드.txt").write_text("가\n나", encoding="utf-8")
    (tmp_path / "c" / "skip.md").write_text("x")
    (tmp_path / "c" / "sub" / "b.txt").write_text("b")
    one = FS.read_corpus(spark, str(tmp_path / "c"), "healthcare_docs").collect()
    assert [(r.source, r.category, r.content) for r in one] == [("건강 가이드", "healthcare_docs", "가\n나")]
    assert FS.read_corpus(spark, str(tmp_path / "c"), recursive=True).count() == 2
    (tmp_path / "d.jsonl").write_text('{"id":"1","dialogue":[{"speaker":"환자","text":"네"}]}\n\n{"id":"2","turns":[{"role":"user","content":"응"}]}\n', encoding="utf-8")
    rows = FS.read_dialogues(spark, str(tmp_path / "d.jsonl")).orderBy("id").collect()
    assert [(r.dialogue[0].speaker, r.dialogue[0].text) for r in rows] == [("환자", "네"), ("user", "응")]
    FS.write_jsonl(spark.createDataFrame([("가",)], ["t"]), str(tmp_path / "out"))
    assert any('{"t":"가"}' in p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part*"))


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", 네', "x")], "id int, content string, other string")
    assert FS.export_csv(df.limit(0), str(tmp_path), "conversations", S.HISTORY_FIELDS) is None
    path = FS.export_csv(df, str(tmp_path), "conversations", S.HISTORY_FIELDS, "kim", datetime(2024, 5, 6, 7, 8))
    assert path.endswith("conversations_kim_20240506_0708")
    parts = [p.read_text(encoding="utf-8").splitlines() for p in (tmp_path / "conversations_kim_20240506_0708").glob("part*")]
    assert ["\ufeffid,nickname,role,content", '1,"","","say ""hi"", 네"'] in parts


def test_refresh_snapshot_and_report(spark, tmp_path):
    p = str(tmp_path / "corpus")
    FS.refresh_corpus(spark.range(3), p)
    FS.refresh_corpus(spark.range(2), p, replace=False)
    assert spark.read.parquet(p).count() == 5
    FS.refresh_corpus(spark.range(1), p)
    assert spark.read.parquet(p).count() == 1
    a = FS.write_snapshot(spark.range(1), str(tmp_path / "profiles"), "1")
    b = FS.write_snapshot(spark.range(4), str(tmp_path / "profiles"), "2")
    assert (spark.read.parquet(a).count(), spark.read.parquet(b).count()) == (1, 4)
    FS.write_eval_report(spark.range(1), spark.range(5), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "trials")).count() == 5


def test_broken_history_rows(spark):
    raw = spark.createDataFrame([(2, "u", '{"type":"ai","data":{"content":" a\\rb "}}'), (1, "u", "{no"), (3, "v", None)], "id long, session_id string, message string")
    rows = S.decode_chat_history(raw, "u", ordered=True).collect()
    assert [(r.id, r.role, r.content) for r in rows] == [(1, "", ""), (2, "assistant", "a b")]
