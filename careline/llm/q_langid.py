"""op2: language of all documents."""

from pyspark.sql import functions as F

from careline.llm.common import read
from careline.llm.langid import fit, with_language
from careline.llm.splits import held_out


def op2_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = with_language(docs, fit(docs), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}
