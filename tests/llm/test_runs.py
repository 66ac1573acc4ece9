import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from compare import SMALL

from careline.llm import q_runs
from careline.llm import runs as R


def slow_runs(words, least=24, power=3):
    """(start, end, period) of all runs, by comparing words q apart for every q."""
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, power * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((a, b, q) for (a, b), q in found.items())


def slow_summary(words):
    runs = slow_runs(words)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    sha = (lambda s: hashlib.sha256(s.encode()).hexdigest())
    best = min(runs, key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]), default=None)
    top = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{a},{b - a},{q}\n" for a, b, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def slow_words(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def fast_runs(docs):
    sizes = np.array([len(d) for d in docs])
    doc, a, b, q = R.runs_of([w for d in docs for w in d], sizes)
    out = [[] for _ in docs]
    for d, *run in zip(doc.tolist(), a.tolist(), b.tolist(), q.tolist()):
        out[d].append(tuple(run))
    return out


def strange(rng):
    """Words of a document with nested, touching and overlapping repeats."""
    letters = [bytes([97 + i]) for i in range(int(rng.integers(1, 5)))]
    parts = []
    for _ in range(int(rng.integers(0, 7))):
        unit = [letters[int(i)] for i in rng.integers(0, len(letters), int(rng.integers(1, 20)))]
        if rng.random() < 0.3:
            unit = unit[:2] * int(rng.integers(1, 12)) + unit
        parts += unit * int(rng.integers(1, 9)) + unit[:int(rng.integers(0, len(unit) + 1))]
    return parts


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    docs = [strange(rng) for _ in range(150)]
    assert fast_runs(docs) == [slow_runs(d) for d in docs]


def test_edges_of_the_definition():
    a, b = [b"a"], [b"b"]
    docs = [[], a * 23, a * 24, a * 23 + b, (a + b) * 12, (a * 7 + b) * 3, (a * 7 + b) * 3 + a * 7, [b"%d" % i for i in range(9)] * 3,
            [b"%d" % (i % 9) for i in range(26)], a * 24 + b * 24, b + a * 40, [b"x"]]
    assert fast_runs(docs) == [slow_runs(d) for d in docs]
    assert fast_runs([a * 24, a * 24]) == [[(0, 24, 1)]] * 2  # no run goes on over documents


def test_grammar_derives_the_documents():
    rng = np.random.default_rng(2)
    docs = [strange(rng) for _ in range(40)] + [[b"q"] * 1000]
    sizes = np.array([len(d) for d in docs])
    words = [w for d in docs for w in d]
    g = R.re_pair(R.numbered(words, sizes), sizes)
    for rule, at in zip(g.rule_of, g.place):
        one = g.first[rule]
        assert words[at:at + g.whole[rule]] == words[one:one + g.whole[rule]]
    assert len(g.symbols) < len(words) / 2 and set(np.cumsum(sizes) - sizes) & set(range(len(words))) <= set(g.symbols.tolist())


def test_hashes_that_mislead_are_replaced(monkeypatch):
    monkeypatch.setattr(R, "HASHES", [((7, 3),), *R.HASHES])
    rng = np.random.default_rng(8)
    docs = [strange(rng) for _ in range(60)]
    assert fast_runs(docs) == [slow_runs(d) for d in docs]


def test_cost_is_not_quadratic():
    import time

    long = [b"w%d" % i for i in range(50_000)]
    for words in ([b"a"] * 400_000, long * 4, [w for x in long for w in (b"the", b"same", b"four", b"words", b"again", x)]):
        began = time.process_time()
        found = fast_runs([words])[0]
        assert time.process_time() - began < 25
    assert found == []


def test_documents(spark, odd_docs, no_docs, clashing):
    want = sorted(str((r.doc_id, *slow_summary(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")[:3000])))
                  for r in odd_docs.collect() if len(r.text or "") < 1000)
    got = R.with_runs(odd_docs, block=3)
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect() if len(r.text or "") < 1000) == want
    assert R.with_runs(no_docs).count() == 0
    more = R.with_runs(clashing, texts=True).collect()
    assert len(more) == odd_docs.count() and {r.n_runs for r in more if r.doc_id in (6, 7)} == {1}
    assert {len(r.collapsed.split()) for r in more if r.doc_id == 6} == {8} and more[0].raw == clashing.first().raw


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in docs if len(r.text or "") < 6000]
    want = {r.doc_id: slow_summary(slow_words(r.doc_id, r.text)) for r in short}
    got = {r[0]: tuple(r[1:]) for r in q_runs.op12_period_runs(spark, SMALL).collect()}
    assert len(got) == len(docs) and {k: got[k] for k in want} == want
    assert sum(v[0] > 0 for v in want.values()) > 5
