"""op6: quality of all documents."""

from pyspark.sql import functions as F

from careline.llm.common import read
from careline.llm.quality import fit, with_quality
from careline.llm.splits import held_out

GOOD = 0.3


def op6_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_quality(docs, fit(docs, read(spark, sf_dir, "labels")), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= GOOD).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
