import re

import numpy as np
import pytest
import xxhash

from careline.llm import simhash as S


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(n, near):
    label = np.arange(n)
    while True:
        new = np.array([label[near[i]].min() for i in range(n)]) if n else label
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("text", [None, "", " ", "one", "One TWO", "a b c", "a b c d É é K", "x\x0by\x1cz w a", "the of and " * 700])
def test_fingerprint(text):
    assert S.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_bit_slices_equal_popcounts(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, np.uint64)
    lanes = np.array([base[rng.integers(40)] ^ np.uint64(sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))}))
                      for _ in range(256)], np.uint64)
    queries = np.repeat(lanes[:50, None], 4, 1)
    bits = np.unpackbits(S.near(S.planes_of(lanes), queries, radius).view(np.uint8), axis=1, bitorder="little")
    assert (bits == (np.bitwise_count(lanes[:50, None] ^ lanes[None]) <= radius)).all()


@pytest.mark.parametrize("tile", [4, 512])
def test_no_link_is_lost(spark, tile, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(-2**63, 2**63, 30, np.int64)
    fps = sorted({int(base[rng.integers(30)] ^ np.int64(sum({1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5))})))
                  for _ in range(600)} | {0, 1, -1, -2**63})
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")
    groups = S.candidate_groups(distinct, tile)
    assert groups.selectExpr("max(size(fps)) AS n").first().n <= 6 * tile + 8 if tile > 4 else True
    found = {r.node: r.root for r in S.components(S.near_links(groups)).collect()}
    a = np.array(fps, np.int64).view(np.uint64)
    want = classes(len(a), np.bitwise_count(a[:, None] ^ a[None]) <= 2)
    names = {}
    for f, w in zip(fps, want):
        names.setdefault(int(w), set()).add(found.get(f, f))
    assert all(len(v) == 1 for v in names.values()) and len(set().union(*names.values())) == len(names)


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    found = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(1, 201)} == {0} and {found[1000 + i] for i in range(1, 300)} == {1000}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(odd_docs, no_docs, clashing):
    rows = odd_docs.collect()
    found = S.near_duplicates(odd_docs).collect()
    assert sorted(str((r.id, r.fp)) for r in found) == sorted(str((r.doc_id, S.fingerprint(r.text))) for r in rows)
    a = np.array([S.fingerprint(r.text) for r in rows], np.int64).view(np.uint64)
    label = classes(len(a), np.bitwise_count(a[:, None] ^ a[None]) <= 2)
    least = {int(k): min((r.doc_id for r, x in zip(rows, label) if x == k and r.doc_id is not None), default=None) for k in label}
    assert sorted(str((r.id, r.component_id)) for r in found) == sorted(str((r.doc_id, least[int(k)])) for r, k in zip(rows, label))
    kept = S.keep_first(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(least)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert S.near_duplicates(no_docs).count() == 0 and S.keep_first(no_docs).count() == 0
