"""op4: exact duplicates among all documents."""

from pyspark.sql import functions as F

from careline.llm.common import read
from careline.llm.exact import exact_groups


def op4_exact_dedup(spark, sf_dir):
    return exact_groups(read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
        F.col("key").alias("text_sha256"))


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE = {"op4_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""}
