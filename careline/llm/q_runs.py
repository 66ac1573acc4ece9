"""op12: periodic runs in all documents."""

from pyspark.sql import functions as F

from careline.llm.common import filled, read
from careline.llm.runs import with_runs


def planted(docs):
    """doc_id and text, where one document in ten repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(filled("text"), r"[\x20\x09-\x0D]+", -1), "")
    n, g = F.size("words"), F.floor(h / 10)
    a = F.col("g") % n
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(
        F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    chosen = docs.filter(h % 10 == 0).select("doc_id", words.alias("words"), g.alias("g"))
    changed = (chosen.withColumn("a", F.when(n > 0, a)).withColumn("p", p)
               .select("doc_id", F.array_join(again, " ").alias("text")))
    return changed.unionByName(docs.filter(F.coalesce(h % 10 != 0, F.lit(True))).select("doc_id", "text"))


def op12_period_runs(spark, sf_dir):
    return with_runs(planted(read(spark, sf_dir, "documents")), keep=["doc_id"])


QUERIES = {"op12_period_runs": op12_period_runs}
ORACLE: dict[str, str] = {}
