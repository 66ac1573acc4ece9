"""op3: near duplicates among all documents."""

from pyspark.sql import functions as F

from careline.llm.common import read
from careline.llm.simhash import near_duplicates


def op3_simhash_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id")


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
ORACLE: dict[str, str] = {}
