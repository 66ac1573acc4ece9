"""What each row costs: digests, passes over the text and tables are made once."""

import re

import pytest
from pyspark.sql import functions as F

from careline.functions import lexicon as L
from careline.functions import pii as P
from careline.functions.spans import MARK, pattern_spans
from careline.plans.korean import korean
from careline.rules import pii


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame([("a b",)], "text string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_word_has_one_digest(words):
    assert plan(words.select(korean("text").alias("k"))).count("md5(") == 1


def test_names_are_judged_in_the_pattern(words):
    """Text behind a candidate is not copied for each of them."""
    assert "substring(" not in plan(words.select(P.pattern_detections(F.col("text"), "name").alias("x")))


def test_term_lists_share_one_cut(words):
    shown = plan(words.select(P.detect_pii("text").alias("x")))
    assert shown.count(", (?=(?:") == 1


def test_tagged_tables_are_literals(words):
    ms = F.array(F.struct(F.col("text").alias("morph"), F.lit("NNG").alias("tag")))
    assert "map_from_entries" not in plan(words.select(L.tagged_matches("text", ms).alias("x")))


@pytest.mark.parametrize("text", [
    "무섭무섭무섭무섭무섭 무서워 죽고 싶어요죽고 싶어요", "슬퍼슬프슬퍼슬프", "무기력하다 무기력 모멸감 모멸", "무섭" * 300 + " 암암암",
    f"{MARK}무섭{MARK}네요 85세{MARK} 3월 5일{MARK}", "하늘 씨 하늘  씨 하늘\n님 나라 고민 김치 함께 박순자", "김영\n", "강남", "",
])
def test_detectors_equal_plain_patterns(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    t = F.col("text")
    kinds = {k: [(m.start(), m.end()) for m in re.finditer(P.PATTERNS[k], text)] for k in P.ORDER if k != "name"}
    kinds["name"] = [m.span() for m in re.finditer(P.NAME_PATTERN, text) if m.group() not in pii.NOT_NAMES and (
        len(m.group()) == 3 or m.group()[0] not in pii.AMBIGUOUS_SURNAMES
        or re.match(pii.HONORIFIC_PATTERN, text[m.end():]))]
    row = df.select(*[P.pattern_detections(t, k).alias(k) for k in kinds], P.emotion_detections(t).alias("emotional")).first()
    for k, spans in kinds.items():
        assert [(d["start"], d["end"]) for d in row[k]] == spans, k
    rules = [pii.surface_pattern(s) for s in pii.EMOTION_STEMS] + [
        w + pii.SURFACE_TAIL for w in pii.EMOTION_WORDS + pii.CRISIS_WORDS]
    assert [(d["start"], d["end"], d["text"]) for d in row["emotional"]] == [
        (*m.span(), m.group()) for r in rules for m in re.finditer(r, text)]


def test_spans_of_a_text_with_marks(spark):
    df = spark.createDataFrame([(f"a{MARK}b1{MARK}22 c",), ("12",), ("x",), (None,)], "text string")
    found = [[tuple(s) for s in r[0]] for r in df.select(pattern_spans("text", r"\d+")).collect()]
    assert found == [[(3, 4, "1"), (5, 7, "22")], [(0, 2, "12")], [], []]


def test_places_are_found_by_halving(spark, words):
    """Points are not sorted together with the marks."""
    from careline.functions.spans import counts_before

    points, marks = [0, 3, 3, 7, 20], [4, 3, 0, 99, -1, 7]
    df = spark.createDataFrame([(points, marks), ([], marks), (points, [])], "p array<int>, m array<int>")
    for at_mark in (True, False):
        counted = df.select(counts_before(F.col("p"), F.col("m"), at_mark).alias("c"))
        assert "array_sort" not in plan(counted)
        assert [r[0] for r in counted.collect()] == [
            [sum(p < m or at_mark and p == m for p in ps) for m in ms] for ps, ms in ((points, marks), ([], marks), (points, []))]


def test_few_distinct_needles_need_no_join(spark):
    from careline.operators.graph import contains_join

    needles = spark.createDataFrame([("ab",), ("b",), ("",)], "k string")
    hay = spark.createDataFrame([("xaby", 1), ("b", 2), ("q", 3), (None, 4), ("xaby", 5)], "h string, n int")
    met = contains_join(needles, hay, "k", "h")
    assert "Join" not in plan(met)
    want = [("ab", "xaby", 1), ("ab", "xaby", 5), ("b", "b", 2), ("b", "xaby", 1), ("b", "xaby", 5)]
    assert sorted(map(tuple, met.collect())) == want
    twice = contains_join(needles.unionByName(needles), hay, "k", "h")
    assert sorted(map(tuple, twice.collect())) == sorted(want * 2)
