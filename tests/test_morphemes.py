"""The slot for a tagger and its dictionary stand-in."""

import random
import re
import time

from pyspark.sql import functions as F

from careline.functions import lexicon as L
from careline.functions import morphemes as M


def test_longest_words_from_the_left():
    tags = {"a": "N", "ab": "V", "abcd": "N", "bc": "A", "c": "N"}
    longest = re.compile("|".join(sorted(tags, key=len, reverse=True)))
    rng, tagger = random.Random(1), M.DictionaryTagger(tags)
    for _ in range(300):
        text = "".join(rng.choice("abcdx ") for _ in range(rng.randrange(0, 40)))
        assert tagger(text) == [(m, tags[m]) for m in longest.findall(text)]


def test_cost_is_linear():
    began = time.process_time()
    assert M.dictionary_tagger()("가" * 2_000_000) == []
    assert time.process_time() - began < 10


def test_slot(spark):
    made = spark.sparkContext.accumulator(0)

    def factory():
        made.add(1)
        return lambda text: [(w, "NNG" if w == "두통" else "JX") for w in text.split()]

    texts = spark.createDataFrame([(1, "두통 이 두통"), (2, None), (3, "")], "id int, text string").coalesce(1)
    tagged = texts.withColumn("ms", M.morphemes(factory)("text"))
    rows = {r.id: [(m.morph, m.tag) for m in r.ms] for r in tagged.collect()}
    assert rows == {1: [("두통", "NNG"), ("이", "JX"), ("두통", "NNG")], 2: [], 3: []} and made.value == 1
    found = tagged.select("id", F.size(L.tagged_matches("text", "ms")).alias("n")).collect()
    assert {r.id: r.n for r in found} == {1: 2, 2: 0, 3: 0}
