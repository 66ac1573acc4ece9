import math
import re
from collections import Counter

import numpy as np
import pytest
from compare import SMALL, compare, connect
from pyspark.sql import functions as F

from careline.llm import q_search
from careline.llm import search as S

ITEMS = "item_id long, text string"


def slow_terms(text):
    return ["".join(c.lower() if c.isascii() else c for c in t)
            for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def slow_ranked(docs, items, k=10):
    """item, rank, doc, score by scoring every document for every item."""
    docs = [(i, Counter(slow_terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(x[2] for x in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(slow_terms(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, c, size in docs:
            m = 10 + 90 * size * n // total
            scored.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                                for t in terms if t in c), i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k]) if s < 0]
    return sorted(map(str, out))


def rows(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


@pytest.mark.parametrize("k, step", [(1, 1), (3, 2), (10, 8)])
def test_best_positions_lose_nothing_and_stop_early(k, step):
    rng = np.random.default_rng(k)
    n, met = 3000, 0
    for trial in range(30):
        terms = np.concatenate([np.full(int(c), t) for t, c in enumerate(rng.integers(1, n, 6))])
        docs = np.concatenate([rng.permutation(n)[:c] for c in np.bincount(terms)])
        tfs = np.minimum(rng.zipf(2.0, len(terms)), 50)
        norms = rng.integers(10, 40 if trial % 2 else 2000, n)
        shard = S.Shard(terms, docs, tfs, norms)
        weights = rng.integers(1, 9000 if trial % 3 else 2, 6)
        full = np.zeros(n, np.int64)
        np.add.at(full, docs, weights[terms] * (10**9 * tfs // (1000 * tfs + 8 * norms[docs])))
        for _ in range(2):  # a search leaves no marks
            got, scores = shard.best(np.arange(6), weights, k, step)
            assert (full[got] == scores).all() and len(set(got.tolist())) == len(got)
            want = np.lexsort((np.arange(n), -full))[:k]
            order = np.lexsort((got, -scores))[:k]
            assert got[order].tolist() == want.tolist()
        met += len(got)
    assert met < 30 * n * 0.7


def test_equal_scores_are_not_cut_off():
    """All documents are alike, so only the smallest numbers are right, wherever they stand in a list."""
    shard = S.Shard(np.zeros(500, int), np.arange(500)[::-1].copy(), np.ones(500, int), np.full(500, 100))
    docs, scores = shard.best(np.array([0]), np.array([5]), 10, 1)
    assert sorted(docs.tolist()) == list(range(500)) and len(set(scores.tolist())) == 1


@pytest.mark.parametrize("sizes", [{}, {"block": 200, "shard": 700, "chunk": 300}])
def test_documents(spark, odd_docs, no_docs, clashing, sizes):
    items = [(1, "The SAME text, here"), (2, None), (3, "--"), (4, "und"), (5, "text"), (5, "nicht thing"), (None, "another text"), (6, "no such words")]
    asked = spark.createDataFrame(items, ITEMS)
    want = slow_ranked([(r.doc_id, r.text) for r in odd_docs.collect()], items)
    assert rows(S.ranked(odd_docs, asked, **sizes)) == want
    more = asked.withColumn("query", F.lit(1)).withColumn("rank", F.lit(2)).withColumn("term", F.lit(3))
    assert rows(S.ranked(clashing.withColumn("block", F.lit(1)).withColumn("shard", F.lit(1)), more, **sizes)) == want
    assert rows(S.ranked(no_docs, asked)) == [] == rows(S.ranked(odd_docs, asked.limit(0)))
    assert rows(S.ranked(odd_docs.filter("text IS NULL"), asked)) == []


def test_no_document_is_sharded_twice(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").repartition(7)
    asked = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = slow_ranked([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in asked.select("item_id", "text").collect()])
    assert rows(S.ranked(docs, asked, block=20_000, shard=90_000, chunk=3_000)) == want


def test_query_equals_sql(spark):
    name = "op11_ranked_search"
    assert compare(spark, connect(SMALL), q_search.QUERIES[name], q_search.ORACLE[name], SMALL) is None
