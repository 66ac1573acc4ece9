"""op8: tokens of all documents."""

import public_tokenizers
from pyspark.sql import functions as F

from careline.llm.common import filled, read
from careline.llm.tokens import token_counts

VOCABULARY = "byte_bpe_50k"
LIMIT = 512


def files() -> tuple[str, str]:
    """The vocabulary as ranks and for tokenizers."""
    return tuple(public_tokenizers.path(f"{VOCABULARY}.{k}") for k in ("tiktoken", "json"))


def op8_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.octet_length(filled("text")).cast("bigint").alias("n_bytes"))
    return token_counts(docs, *files(), keep=["doc_id", "n_bytes"]).withColumn(
        "over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
