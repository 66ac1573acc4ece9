"""Slot for a morphological tagger, and its dictionary stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import functions as F

from careline.rules import medical, pii

MORPHEMES = "array<struct<morph:string,tag:string>>"
Tagger = Callable[[str], Sequence[tuple[str, str]]]


def morphemes(factory: Callable[[], Tagger] | None = None) -> Callable:
    """Tagged morphemes of a text column, as ``tagged_matches`` and the name and emotion detectors take them. ``factory``
    is called once per task and gives the tagger; the stand-in knows the words of the rule pack. A null text has none."""
    make = factory or dictionary_tagger

    @F.pandas_udf(MORPHEMES)
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = make()
        for texts in batches:
            yield pd.Series([[{"morph": m, "tag": t} for m, t in tagger(text or "")] for text in texts], index=texts.index)

    return tagged


class DictionaryTagger:
    """From the left the longest word of a dictionary at each place, by a trie; what is in no word is passed over. A
    step looks at no more characters than the longest word has."""

    def __init__(self, tags: dict[str, str]):
        self.trie: dict = {}
        for word, tag in tags.items():
            node = self.trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = tag

    def __call__(self, text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(text):
            node, end, tag = self.trie, at, None
            for i in range(at, len(text)):
                node = node.get(text[i])
                if node is None:
                    break
                if "" in node:
                    end, tag = i + 1, node[""]
            if tag is None:
                at += 1
            else:
                out.append((text[at:end], tag))
                at = end
        return out


def dictionary_tags() -> dict[str, str]:
    """Words of the rule pack with tags: verbs, emotional stems, and nouns, which go first where a word is several."""
    return (dict.fromkeys((t for t, _, _ in medical.VERBS), "VV") | dict.fromkeys(pii.EMOTION_STEMS, "VA")
            | dict.fromkeys((t for t, _, _ in medical.NOUNS), "NNG"))


def dictionary_tagger() -> DictionaryTagger:
    return DictionaryTagger(dictionary_tags())
