"""Scanned matches against plain patterns and against the expressions that pass over the text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from careline.functions import classify as C
from careline.functions import lexicon as L
from careline.functions import pii as P
from careline.functions.scan import DIGITS, Rule, Term, compiled, finder, scan
from careline.functions.spans import MARK
from careline.plans import all_queries
from careline.plans.korean import PHRASES, PLAIN
from careline.rules import medical, pii, risk

ODD = [
    None, "", " ", "암", "딸", "85", "김", "무섭무섭무서워 죽고 싶어요죽고 싶어요", "슬퍼슬프슬퍼슬프", "모멸감 모멸", f"{MARK}무섭{MARK}85세{MARK}",
    "최민수 할아버지 최민수  할아버지 최민수할아버지", "하늘　씨 하늘\x1c씨 하늘 씨", "٣월 ٥일 85　세 85\x1f세", "010 1234 5678 0101234567890",
    "900101-1234567900101 1234567", "부산광역시 해운대구 우동 3-1번지 서울시 강남구 역삼동가나다라마도 시", "가나다라마바사아자차카타파하병원약국",
    "😀김영수😀 씨 😀3번 10일", "119 안  좋고 못 자고 많이", "어제부터 2번", "잘 없 아프",
]
WORDS = [*PHRASES, *PLAIN, *pii.NOT_NAMES, *risk.RAISING, "하늘", "나은", "씨", "님", "할아버지", "12월", "0", "1", "-", ".", "시", "도", "구", "동", "원",
         "병원", "\n", "\t", "가슴 아파", *[t for t, _ in P.EMOTION_HEADS], *medical.CLINICAL_TERMS, *C.RISK_WORDS]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(5)
    made = ODD + [rnd.choice(["", " "]).join(rnd.choices(WORDS, k=rnd.randint(1, 60))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate(made)), "i int, t string").repartition(4)


def test_matches_of_patterns_and_terms():
    rules = [Rule(r"\d+\s?x", DIGITS), Rule("[a-c]{1,3}z", "z", 1, 3), Rule("(?<![a-c])c[a-c]+", "c", 0, 0, "ac"), Term(("ab", "a"), "[b-c]{0,2}"),
             Term(("b",)), Term(("bc",))]
    plain = [r"\d+\s?x", "[a-c]{1,3}z", "(?<![a-c])c[a-c]+", "(?:ab|a)[b-c]{0,2}", "b", "bc"]
    find, rnd = finder(rules, [Term(("bc", "q")), "z.*x"]), random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choices("abcz1٣x 　", k=rnd.randint(0, 14)))
        spans, seen = find(text)
        one_by_one = [(i, *m.span(), m.group()) for i, p in enumerate(plain) for m in re.finditer(p, text)]
        assert spans == one_by_one
        assert seen == [i for i, p in enumerate(["bc|q", "z.*x"]) if re.search(p, text)]


def test_white_space_is_that_of_the_jvm(spark):
    chars = [chr(c) for c in [*range(0x20), 0x20, 0x85, 0xa0, 0x1680, 0x180e, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202f, 0x205f, 0x3000, 0xfeff]]
    df = spark.createDataFrame([(c,) for c in chars], "c string").select("c", F.col("c").rlike(r"(?dU)^\s\z").alias("s"))
    alone, inside = compiled(r"\s"), compiled(r"[-.\s]")
    for r in df.collect():
        assert (bool(alone.fullmatch(r.c)), bool(inside.fullmatch(r.c))) == (r.s, r.s), repr(r.c)


def test_detections_and_signals_as_without_a_scan(texts):
    rows = texts.withColumn("s", scan("t", P.SCANNED, C.RISK_SEEN)).select(
        "i", "t", P.detect_pii("t").alias("p0"), P.detect_pii("t", scanned=F.col("s.spans")).alias("p1"),
        C.risk_signals("t").alias("r0"), C.risk_signals("t", seen=F.col("s.seen")).alias("r1"),
        L.clinical_terms(F.col("t")).alias("c0"), L.clinical_terms_scanned("t").alias("c1")).collect()
    assert sum(len(r.p0) for r in rows) > 1000
    for r in rows:
        assert r.p1 == r.p0, r.t
        assert r.r1 == r.r0, r.t
        assert r.c1 == r.c0, r.t


def test_health_summaries_scan_a_text_once(spark):
    """No detector, keyword or pattern passes over the text by itself; the texts are scanned, and what is left of them masked."""
    made = all_queries()["health_summaries"](spark, "/root/testdata/sf0.001")
    shown = made._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"regexp_replace\(|regexp_extract_all\(|RLIKE|\(\?=", shown)
    assert shown.count("ArrowEvalPython") == 2
