import hashlib
import re

import pytest

from careline.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    wins = {(str(i) if i is not None else "null", tuple(w[s:s + 13])) for i, t in items for w in [words(t)] if w
            for s in range(max(len(w) - 13, 0) + 1)}
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    names.add(i)
        yield d, len(w), len(hit), tuple(sorted(names)), bool(hit) and 20 * len(hit) >= len(w)


ITEM = "Alpha beta gamma delta Epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
DOCS = [
    (1, ITEM), (2, "x " * 400 + ITEM.upper() + " y" * 400), (3, "alpha beta gamma"), (4, "É alpha É x" * 3), (5, None),
    (6, ""), (7, "short one, here: SHORT one"), (7, "short one, here: SHORT one"), (8, ITEM + " " + ITEM),
    (9, ITEM.replace("delta", "Delta!,")), (10, "é alpha"), (11, "q " * 1000 + "short one"), (None, "short one"), (12, "İstanbul K K"),
]
ITEMS = [(1, ITEM), (2, "short ONE"), (3, None), (4, ""), (5, "é alpha"), (2, "short ONE"), (None, "gamma"), (6, ITEM),
         (7, "istanbul"), (8, "not in any document at all")]


@pytest.mark.parametrize("limit", [1000, 5, 0])
def test_equals_brute_force_with_and_without_broadcast(spark, limit):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = D.contamination(docs, items, limit=limit).collect()
    have = sorted(((r.id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in found), key=str)
    assert have == sorted(brute(DOCS, ITEMS), key=str)
    if limit == 5:  # windows are too many to broadcast, their keys are not
        rare = D.anchors(docs, D.item_windows(items))
        assert rare.select("key").distinct().count() <= limit < rare.count()


def test_rarest_word_is_joined(spark):
    docs = spark.createDataFrame([(i, "common " * 5 + ("rare" if i == 3 else "")) for i in range(9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "common rare")], "item_id long, text string")
    anchor = D.anchors(docs, D.item_windows(items)).collect()
    assert [(r.key, r.o, r.key2, r.step) for r in anchor] == [("rare", 1, "common", -1)]


def test_empty_tables_and_other_columns(spark, no_docs, clashing):
    items = spark.createDataFrame([(1, "the same text", 0, 0)], "item_id long, text string, id int, win int")
    none = items.limit(0)
    assert D.contamination(no_docs, items).count() == 0
    clean = D.contamination(clashing, none).collect()
    assert len(clean) == clashing.count() and not any(r.n_hit or r.contaminated for r in clean)
    assert D.drop_contaminated(clashing, none).count() == clashing.count()
    left = D.drop_contaminated(clashing, items)
    assert left.columns == clashing.columns and left.filter("text LIKE 'The same%'").count() == 0
    assert left.count() == clashing.count() - 4


def test_digest_of_no_items(spark):
    from careline.llm.q_decontaminate import op1_decontaminate

    found = op1_decontaminate(spark, "/root/testdata/sf0.001").filter("n_items = 0").first()
    assert found.items_sha256 == hashlib.sha256(b"").hexdigest()
