from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from careline.llm import exact


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((r.doc_id, best[r.text or ""], len(groups[r.text or ""])) for r in rows), key=str)


@pytest.mark.parametrize("key", [
    exact.sha256_key, lambda t: F.lpad(F.hex(F.length(t) % 3), 8, "0"), lambda t: F.lit("00ff")])
def test_groups_equal_brute_force_even_if_keys_collide(odd_docs, key):
    found = exact.exact_groups(odd_docs, key=key).collect()
    assert sorted(((r.id, r.keep_id, r.group_size) for r in found), key=str) == expected(odd_docs.collect())
    kept = [r for r in found if r.kept]
    assert len(kept) == odd_docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_directory_doubles_only_where_buckets_are_overfull():
    counts = [(c, 10) for c in range(8)] + [(12, 1)]
    cells = exact.directory(counts, bits=4, capacity=25)
    depth = {c: d for c, _, d in cells}
    assert len(cells) == 16 and depth[0] == 3 and depth[12] == 1 and depth[8] == 1
    bucket = {c: b for c, b, _ in cells}
    held = defaultdict(int)
    for c, n in counts:
        held[bucket[c]] += n
    assert max(held.values()) <= 25 and bucket[0] == bucket[1] != bucket[2]


def test_one_cell_that_stays_overfull():
    assert {d for _, _, d in exact.directory([(5, 1000)], bits=3, capacity=10) if _ is not None} == {1, 2, 3}


def test_the_index_settles_the_groups(odd_docs, monkeypatch):
    """Owners bring together what parts of one text have left apart; rows of an index without them are lost."""
    long = [r for r in exact.build_index(odd_docs, key=lambda t: F.lit("00ff"), parts=50).collect()]
    assert sorted(r.slot for r in long) == list(range(1, long[0].chain + 1)) and all(r.text is not None for r in long)
    assert sum(r.group_size for r in long) == odd_docs.count()
    build = exact.build_index
    monkeypatch.setattr(exact, "build_index", lambda *a, **b: build(*a, **b).filter("key < '8'"))
    assert exact.exact_groups(odd_docs).count() < odd_docs.count()


def test_buckets_own_ranges_of_keys(odd_docs):
    index = exact.build_index(odd_docs, capacity=1).collect()
    assert all(r.chain == 1 and r.slot == 1 for r in index)
    assert len({r.bucket for r in index}) == len(index)
    assert [r.key for r in sorted(index, key=lambda r: r.bucket)] == sorted(r.key for r in index)


def test_empty_table_and_other_columns(no_docs, clashing):
    assert exact.exact_groups(no_docs).count() == 0 and exact.keep_one(no_docs).count() == 0
    kept = exact.keep_one(clashing)
    assert kept.columns == clashing.columns
    rows = kept.collect()
    assert len(rows) == len({r.text or "" for r in clashing.collect()}) == len({r.text or "" for r in rows})
    assert [r.doc_id for r in rows if r.text == "The same text here."] == [2]
    assert [r.doc_id for r in rows if not r.text] == [4]
