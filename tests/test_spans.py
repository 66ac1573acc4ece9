"""Spans against plain loops over generated texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from careline.functions import core
from careline.functions import lexicon as L
from careline.functions import spans as SP
from careline.functions.chunks import section_split
from careline.functions.lexicon import word_contexts
from careline.functions.pii import detect_pii

TERMS = ["aa", "ab", "aba", "b", "수면", "수면제", "면제"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(7)
    made = ["".join(rnd.choice(["a", "b", "c", " ", "수면", "제", "😀", "\n"]) for _ in range(rnd.randint(0, 60)))
            for _ in range(200)] + ["", "a" * 300, "ab" * 200]
    return made, spark.createDataFrame(list(enumerate(made)), "i int, t string").repartition(4).cache()


def spans_of(df, column):
    return {r.i: [(s.start, s.end, s.text) for s in r.s] for r in df.select("i", column.alias("s")).collect()}


def every(text, terms):
    return sorted((i, i + len(t), t) for t in terms for i in range(len(text)) if text.startswith(t, i))


def test_pattern_spans(texts):
    made, df = texts
    have = spans_of(df, SP.pattern_spans("t", "a+b?|수면"))
    for i, t in enumerate(made):
        assert have[i] == [(m.start(), m.end(), m.group()) for m in re.finditer("a+b?|수면", t)]


def test_term_spans_and_longest(texts):
    made, df = texts
    have = spans_of(df, SP.term_spans("t", TERMS))
    kept = spans_of(df, SP.longest_non_overlapping(SP.term_spans("t", TERMS)))
    for i, t in enumerate(made):
        assert sorted(have[i]) == every(t, TERMS)
        want = []
        for s in sorted(every(t, TERMS), key=lambda s: (s[0], -(s[1] - s[0]))):
            if not want or s[0] >= want[-1][1]:
                want.append(s)
            elif s[1] - s[0] > want[-1][1] - want[-1][0]:
                want[-1] = s
        assert kept[i] == want


def test_accepted_spans_never_overlap_and_masks_rebuild(texts):
    made, df = texts
    spans = SP.by_start(SP.accept_in_order(SP.term_spans("t", TERMS)))
    marked = F.transform(spans, lambda s: s.withField("mask", F.concat(F.lit("<"), s["text"], F.lit(">"))))
    rows = df.select("i", spans.alias("s"), SP.mask_spans("t", marked).alias("m")).collect()
    for r in rows:
        assert all(a.end <= b.start for a, b in zip(r.s, r.s[1:]))
        assert r.m.replace("<", "").replace(">", "") == made[r.i]
        assert all(made[r.i][s.start:s.end] == s.text for s in r.s)


def test_add_uncovered(spark):
    s = "array<struct<start:int,end:int,text:string>>"
    df = spark.createDataFrame([([(0, 3, "abc")], [(1, 2, "b"), (2, 5, "cde"), (3, 5, "de")])], f"a {s}, b {s}")
    out = df.select(SP.add_uncovered("a", "b").alias("x")).first().x
    assert [r.text for r in out] == ["abc", "de"]


def test_found_terms_and_counts(texts):
    made, df = texts
    terms = TERMS + ["c", "제", "d", "e", "f", "g", "h", "i", "j", "a"]
    rows = df.select("i", L.keyword_hits(F.col("t"), terms).alias("h"),
                     L.keyword_count(F.col("t"), terms + ["b"]).alias("n"),
                     L.any_keyword(F.col("t"), terms).alias("any")).collect()
    for r in rows:
        want = [t for t in terms if t in made[r.i]]
        assert r.h == want and r.any == bool(want)
        assert r.n == len(want) + ("b" in made[r.i])


def test_prefix_sums(spark):
    rows = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 63, 64, 65, 500)], "v array<int>")
    for r in rows.select("v", core.prefix_sums(F.col("v")).alias("s")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]


def test_word_contexts(spark):
    text = "저는 어제 밤 부터 아주 심한 두통이 있어서 약을 먹고 잠을 잤어요"
    df = spark.createDataFrame([(text,)], ["t"])
    c = df.select(L.word_contexts("t", SP.term_spans("t", ["두통"])).alias("c")).first().c[0]
    assert c.before_words == ["어제", "밤", "부터", "아주", "심한"]
    # The word that holds the term starts before its end, so it is on neither side.
    assert c.after_words == ["있어서", "약을", "먹고", "잠을", "잤어요"]
    assert c.full_context == "어제 밤 부터 아주 심한 두통 있어서 약을 먹고 잠을 잤어요"


def test_stop_words_stay_when_few(spark):
    df = spark.createDataFrame([("그 이것 두통 것 등 수",)], ["t"])
    c = df.select(L.word_contexts("t", SP.term_spans("t", ["두통"])).alias("c")).first().c[0]
    assert c.before_words == ["그", "이것"] and c.after_words == ["것", "등", "수"]


@pytest.mark.parametrize("unit, rule", [
    ("이영자 할머니 010-2345-6789 외로워서 아버지 ", lambda c: detect_pii(c)),
    ("then we went home ", lambda c: word_contexts(c, SP.term_spans(c, ["the", "then"]))),
    ("then the hen ", lambda c: SP.longest_non_overlapping(SP.term_spans(c, ["the", "then", "he"]))),
    ("some line of text\n", lambda c: section_split(c)),
])
def test_long_texts_cost_their_length(spark, unit, rule):
    def seconds(n):
        df = spark.createDataFrame([(unit * n,)], "t string").repartition(1)
        begin = time.perf_counter()
        df.select(F.size(rule(F.col("t")))).collect()
        return time.perf_counter() - begin

    seconds(10)
    assert seconds(16_000) < 3 * seconds(8_000) + 2
