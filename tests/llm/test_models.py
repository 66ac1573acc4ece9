import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from careline.llm import langid, quality
from careline.llm.splits import held_out, sampled

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, moves, start = rng.normal(size=(17, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    fresh = np.zeros(17, bool)
    fresh[[0, 1, 6, 13]] = True
    found = langid.forward_backward(scores, moves, start, fresh, expected=True)
    marginals, counts = np.zeros((17, 3)), np.zeros((3, 3))
    bounds = [*np.flatnonzero(fresh), 17]
    for a, b in zip(bounds, bounds[1:]):
        z, m, c = 0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for y in itertools.product(range(3), repeat=b - a):
            w = np.exp(start[y[0]] + sum(scores[a + t][v] for t, v in enumerate(y)) + sum(moves[p, q] for p, q in zip(y, y[1:])))
            z += w
            for t, v in enumerate(y):
                m[t, v] += w
            for p, q in zip(y, y[1:]):
                c[p, q] += w
        marginals[a:b], counts = m / z, counts + c / z
    assert np.allclose(found.marginals, marginals) and np.allclose(found.transitions, counts)


def test_language_of_held_out_documents(spark):
    from careline.llm.q_langid import op2_language_id

    found = op2_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    out = [r for r in found if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in found)


def test_switches_inside_a_text():
    rows = [("the house and the garden of it with that " * 5, "en"), ("der die das und nicht mit ein auch ist " * 5, "de")] * 20
    model = langid.train(rows)
    words = langid.words_of([(0, "the garden of the house das ist nicht der mit und")])
    scores = langid.summed(model.weights, *langid.features(words), len(words.length))[words.codes]
    marginals = langid.forward_backward(scores, model.moves, model.start, np.eye(1, len(scores), dtype=bool)[0]).marginals
    assert marginals.argmax(1).tolist() == [1] * 5 + [0] * 6
    assert langid.label([None, "", "12 !!", "the"], model)[0] == ["und", "und", "und", "en"]


def test_language_of_odd_tables(odd_docs, no_docs, clashing):
    model = langid.fit(odd_docs)
    assert set(model.languages) <= {"en", "de"}
    found = langid.with_language(odd_docs, model).collect()
    assert len(found) == odd_docs.count() and all(r.lang_pred == "und" for r in found if r.doc_id in (3, 4, 5, 9))
    kept = langid.with_known_language(clashing, model)
    assert kept.columns == clashing.columns and kept.filter("text IS NULL").count() == 0
    assert kept.filter("score <> 8").count() == 0
    empty = langid.fit(no_docs)
    assert empty.languages == [] and langid.label(["the"], empty)[0] == ["und"]
    assert langid.with_language(no_docs, empty).count() == 0


def test_quality_of_held_out_documents(spark):
    from careline.llm.q_quality import op6_quality

    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    found = op6_quality(spark, SF)
    assert found.count() == 1000
    out = found.filter("held_out").join(labels, "doc_id").collect()
    ones, zeros = ([r.score for r in out if r.quality == k] for k in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.85
    assert np.mean([r.predicted == r.quality for r in out]) > 0.85


def test_slopes_equal_differences():
    net = quality.fresh(1)
    net = quality.Network(*[p.astype(np.float64) for p in net.parts()])
    texts, y, w = [b"hello world " * 40, b"", b"xyz" * 300], np.array([1, 0, 1.0]), np.array([1, 2, 0.5])

    def loss():
        data, steps = quality.laid_out(texts)
        p = quality.probability(net, quality.half_maxima(net, data), steps)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    for p, g in zip(net.parts(), quality.gradient(net, texts, y, w)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = p[at], 1e-5
        p[at] = kept + step
        up = loss()
        p[at] = kept - step
        down = loss()
        p[at] = kept
        assert g[at] == pytest.approx((up - down) / (2 * step), rel=1e-2, abs=1e-6)


def test_score_sees_the_whole_text_and_not_its_neighbours():
    net = quality.fresh(3)
    good, odd = "some ordinary text. " * 2000, "some ordinary text. " * 1990 + "$$$ | !! " * 20
    both = quality.score(net, [good, odd, None, "", "x"])
    assert both[0] != both[1] and both[2] == both[3]
    assert np.allclose([quality.score(net, [t])[0] for t in (good, odd, None, "", "x")], both, atol=1e-6)


def test_quality_of_odd_tables(spark, odd_docs, no_docs, clashing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (8, 1), (3, None), (3, 7)], "doc_id long, quality int")
    net = quality.fit(odd_docs, labels)
    found = quality.with_quality(clashing, net)
    assert found.columns == [c for c in clashing.columns if c != "score"] + ["score"]
    assert found.filter("score BETWEEN 0 AND 1").count() == clashing.count()
    none = quality.fit(no_docs, labels.limit(0))
    assert quality.score(none, ["x"]).tolist() == [0.5] and quality.with_quality(no_docs, none).count() == 0


def test_samples_are_bounded_and_whole(spark):
    rows = spark.range(20_000).selectExpr("id", "CASE WHEN id % 100 = 0 THEN 'rare' ELSE 'often' END AS label")
    some, shares = sampled(rows, "id", "label", 200)
    n = {r[0]: r[1] for r in some.groupBy("label").count().collect()}
    assert n["rare"] == 200 and 140 < n["often"] < 260 and shares["rare"] == 1
    held = spark.createDataFrame([(5,), (None,)], "id long").select(held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in held] == [zlib.crc32(b"5") % 5 == 0, False]


def test_long_rows_are_learned(spark):
    # books only: numbers in front, so that a span of raw characters could be without any letter
    words = {"en": "the house and the garden of it with that ", "de": "der die das und nicht mit ein auch ist "}
    rows = [(i, "12 " * 30_000 + words[k] * 800 + "34 " * 30_000, k) for i, k in enumerate(["en", "de"] * 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["de", "en"]
    assert langid.label(["the garden of the house", "das ist nicht der"], model)[0] == ["en", "de"]
    good = [(i, ("fine words of a text. " if i % 2 else "$$ || ## @@ !! ") * 1500, i) for i in range(60)]
    docs = spark.createDataFrame(good, "doc_id long, text string, n int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    net = quality.fit(docs, labels)
    assert quality.score(net, ["fine words of a text. " * 9])[0] > 0.5 > quality.score(net, ["$$ || ## @@ !! " * 9])[0]


def test_no_language_rejects_nothing(spark, odd_docs):
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    model = langid.fit(docs)
    assert model.languages == []
    kept = langid.with_known_language(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_spans_are_bounded_and_from_the_whole_text(spark):
    from careline.llm.splits import spans

    text = "".join(chr(0x4E00 + i) for i in range(1000))
    df = spark.createDataFrame([(i, t) for i in range(20) for t in (text, text[:40])], "id long, text string")
    found = [r.s for r in df.select(spans(F.col("text"), F.col("id"), 40).alias("s")).collect()]
    assert text[:40] in found and all(len(s) <= 43 for s in found)
    for s in set(found) - {text[:40]}:
        parts = s.split(" ")
        assert [len(p) for p in parts] == [10] * 4 and all(p in text[250 * i:250 * i + 250] for i, p in enumerate(parts))
    assert len(set(found)) > 10


def slow_score(net, text):
    """The network on one text, chunk by chunk, place by place and filter by filter."""
    data = (text or "").encode()
    half = quality.CHUNK // 2
    steps = max(-(-len(data) // half), 2)
    data = data.ljust((steps + 1) * half + quality.WIDTH, b"\0")
    rows = []
    for c in range(steps - 1):
        pooled = []
        for f in range(quality.FILTERS):
            most = max(sum(float(net.tables[k, data[p + k], f]) for k in range(quality.WIDTH)) for p in range(c * half, (c + 2) * half))
            pooled.append(max(most + float(net.bias[f]), 0.0))
        rows.append([np.tanh(sum(p * float(w) for p, w in zip(pooled, net.hidden[:, h])) + float(net.hidden_bias[h]))
                     for h in range(quality.HIDDEN)])
    both = [sum(r[h] for r in rows) / len(rows) for h in range(quality.HIDDEN)] + [max(r[h] for r in rows) for h in range(quality.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(b * float(w) for b, w in zip(both, net.last)) + float(net.last_bias[0]))))


def test_scores_equal_the_network_written_out():
    net = quality.fresh(3)
    net.bias[:] = np.linspace(-2, 2, quality.FILTERS)
    net.hidden_bias[:] = np.linspace(-1, 1, quality.HIDDEN)
    half = quality.CHUNK // 2
    texts = [None, "", "a", "Some words, é and 日本語!", "x" * half, "y z " * (half // 4) + "q", "the end. " * (half * 3 // 9), "b" * (2 * half + 1)]
    assert np.allclose(quality.score(net, texts), [slow_score(net, t) for t in texts], atol=1e-4)


def test_the_stage_names_unknown_languages(spark):
    words = {"en": "the house and the garden of it with that ", "de": "der die das und nicht mit ein auch ist "}
    rows = [(i, words[k] * 3, None if i < 6 else k) for i, k in enumerate(["en", "de"] * 20)] + [(90, "12 !", "en"), (91, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    kept = langid.with_known_language(docs, langid.fit(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.lang) for r in kept.collect()) == [(i, "de" if i % 2 else "en") for i in range(40)]


def test_only_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(i, f"{'abc'[i % 3]}word {'abc'[i % 3]}other text", f"l{0 if i > 40 else i % 5}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(docs).languages) == 2
