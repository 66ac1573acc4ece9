"""Care talk rendered from the words of a table.

The given tables hold no Korean, so the default rule packs would find nothing in them.
Here every word of a text is replaced by a phrase picked by its digest: the whole table
is used, the result grows with it, and plain SQL can make the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.functions.core import nz, strings
from careline.plans.registry import arr
from careline.rules.text import words

SLOTS = 512
# Phrases that the rules react to take one slot each; all other slots are plain words.
PHRASES = words("""
쓰러졌어요, 숨을 못 쉬겠어요, 그만 하자, 시스템 프롬프트, 오늘, 날씨가, 안녕하세요, 심장이
어떻게, 그래서, 그거, 네, 맞아, 그러면, 또, 더
두통이, 허리가, 무릎이, 혈압이, 당뇨가, 기침이, 변비가, 수면, 잠이, 약을, 병원에, 관절이, 피부가, 요실금
골다공증, 발톱이, 눈이, 귀가, 소변을, 치매가, 기억이, 우울해요, 외로워요, 불안해요, 슬퍼요, 짜증이, 죽고 싶어요
넘어졌어요, 밥을, 식사, 운동, 산책, 목욕, 아파요, 안 와요, 못 자요, 저려요, 높아요, 가려워요, 괜찮아요
많이, 자꾸, 요즘 들어, 3번, 김영수, 박순자 할머니, 010-1234-5678, 900101-1234567, 서울시 강남구 역삼동, 85세
3월 5일, 서울대학병원, 아들이, 큰딸이, 며느리, 암, 하늘 씨, 이순옥 어르신, 두려워요, 답답해요, 머리가, 눈물이
""")
PLAIN = words("물건을, 사람들, 마당에서, 어디서, 꽃을, 버스로, 창문을, 저기에, 봤어요, 다들, 함께")


def korean(text: Column | str) -> Column:
    """A word's digest is taken once: its slot is a place in one table of phrases. 512 slots need
    the last nine bits of the first four hex digits."""
    table = strings([PHRASES[i] if i < len(PHRASES) else PLAIN[i % len(PLAIN)] for i in range(SLOTS)])

    def phrase(w: Column) -> Column:
        return F.get(table, F.pmod(F.conv(F.substring(F.md5(w), 2, 3), 16, 10).cast("int"), F.lit(SLOTS)))

    return F.array_join(F.transform(F.split(nz(text), " ", -1), phrase), " ")


def korean_turns(turns: DataFrame) -> DataFrame:
    return turns.withColumn("text", korean("text"))


def sql_korean(text: str) -> str:
    slot = f"(('0x' || substr(md5(w), 1, 4))::INT % {SLOTS})"
    return (
        f"array_to_string(list_transform(string_split({text}, ' '), lambda w: "
        f"CASE WHEN {slot} < {len(PHRASES)} THEN ({arr(PHRASES)})[{slot} + 1] "
        f"ELSE ({arr(PLAIN)})[{slot} % {len(PLAIN)} + 1] END), ' ')"
    )


KO = f"ko AS (SELECT conv_id, turn, role, {sql_korean('text')} AS text FROM conversations)"
KO_DOCS = f"kodocs AS (SELECT doc_id, {sql_korean('text')} AS text FROM documents)"
