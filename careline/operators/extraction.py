"""Slot for a model that extracts triples from documents, and its rule stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from careline.rules.text import words

#: src, src_label, rel, dst, dst_label
Triple = tuple[str, str, str, str, str]
Extractor = Callable[[str], Sequence[Triple]]
TRIPLE = "src string, src_label string, rel string, dst string, dst_label string, error string"
#: Documents that a worker takes out of a batch at a time.
AT_A_TIME = 64


def extract_triples(docs: DataFrame, factory: Callable[[], Extractor], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident and ``TRIPLE``: the triples of every document, as ``load_triples`` takes them.

    ``factory`` is called once per task and gives the extractor. A document that it fails on is one row with the error and no
    triple, and the others go on; a document without triples is one row of nulls, so that it
    counts as processed. Null texts are empty. Documents pass through Arrow batches, some at a time.
    """
    schema = StructType([docs.schema[ident], *StructType.fromDDL(TRIPLE).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = factory()
        for batch in batches:
            for at in range(0, len(batch), AT_A_TIME):
                part = batch.slice(at, AT_A_TIME)
                owner, rows = [], []
                for i, value in enumerate(part.column(1).to_pylist()):
                    try:
                        found = [(*triple, None) for triple in extract(value or "")] or [(None,) * 6]
                    except Exception as e:  # whatever a model raises is that document's error
                        found = [(None,) * 5 + (f"{type(e).__name__}: {e}",)]
                    owner += [i] * len(found)
                    rows += found
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(owner)), *(pa.array(c, pa.string()) for c in zip(*rows))], schema=arrow)

    return docs.select(F.col(ident), F.col(text)).mapInArrow(run, schema)


class SentencePairs:
    """Stand-in for a model: a symptom and a condition named in one sentence belong together. Like a model
    it takes texts up to some length only."""

    def __init__(self, symptoms: Sequence[str], conditions: Sequence[str], most_chars: int = 20_000, end: str = "\n"):
        self.symptoms, self.conditions, self.most_chars, self.end = symptoms, conditions, most_chars, end

    def __call__(self, text: str) -> list[Triple]:
        if len(text) > self.most_chars:
            raise ValueError(f"more than {self.most_chars} characters")
        found = {}
        for sentence in text.split(self.end):
            have = [c for c in self.conditions if c in sentence]
            if have:
                found |= dict.fromkeys((s, "Symptom", "SYMPTOM_OF", c, "Condition")
                                       for s in self.symptoms if s in sentence for c in have)
        return list(found)


#: Words of the rendered care talk that the stand-in knows.
SYMPTOMS = words("두통, 기침, 불면증, 무릎, 허리")
CONDITIONS = words("당뇨, 요실금, 변비, 골다공증, 치매")
