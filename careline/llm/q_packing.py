"""op5: all documents in sequences of 2048 tokens."""

from careline.llm.common import read
from careline.llm.packing import packed
from careline.llm.q_tokens import files


def op5_packing(spark, sf_dir):
    return packed(read(spark, sf_dir, "documents"), files())


QUERIES = {"op5_packing": op5_packing}
ORACLE: dict[str, str] = {}
