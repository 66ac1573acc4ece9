"""Stages against plain Python, and the queries against SQL."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline as P
from careline.llm import langid, queries
from careline.llm.common import read
from careline.llm.simhash import fingerprint
from compare import compare, connect
from test_decontaminate import brute

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), queries.queries()[name], queries.oracle_sql()[name], SF) is None


def kept(df):
    return sorted(r.doc_id for r in df.collect())


def test_stages(spark):
    docs = read(spark, SF, "documents")
    stages = dict(P.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash_dedup", "decontaminate", "packing"]
    first = stages["language_id"](spark, docs, SF)
    model = langid.fit(docs)
    rows = docs.collect()
    langs = langid.label([r.text for r in rows], model)[0]
    assert kept(first) == sorted(r.doc_id for r, x in zip(rows, langs) if x != "und") and first.columns == docs.columns
    # each later stage over the whole table
    best = {}
    for r in rows:
        best[r.text or ""] = max(best.get(r.text or "", r.doc_id), r.doc_id)
    exact = stages["exact_dedup"](spark, docs, SF)
    assert kept(exact) == sorted(best.values()) and exact.columns == docs.columns
    a = np.array([fingerprint(r.text) for r in rows], np.int64).view(np.uint64)
    near, label = np.bitwise_count(a[:, None] ^ a[None]) <= 2, np.arange(len(a))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    least = {}
    for r, k in zip(rows, label):
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert kept(stages["simhash_dedup"](spark, docs, SF)) == sorted(least.values())
    some = docs.filter("doc_id < 60")
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    clean = {d for d, _, _, _, bad in brute([(r.doc_id, r.text) for r in some.collect()], items) if not bad}
    assert kept(stages["decontaminate"](spark, some, SF)) == sorted(clean)


def test_run(spark):
    done = P.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(done.columns)
    whole = done.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert whole and all(r[1] == r[2] for r in whole)


def test_stages_on_odd_tables(spark, clashing, no_docs):
    for docs in (clashing, no_docs):
        now = docs
        for name, stage in P.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns
        rows = P.pack(spark, now, SF).collect()
        assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)
