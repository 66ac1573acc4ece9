"""op7: all pages written as web archives and read back."""

from pyspark.sql import functions as F

from careline.llm import warc
from careline.llm.common import read, scratch


def op7_warc(spark, sf_dir):
    path = scratch(spark, "archives")
    warc.write_archives(read(spark, sf_dir, "pages"), path, compression="gzip")
    return warc.resolved(warc.read_archives(spark, path)).select(
        F.col("id").alias("page_id"), F.col("payload_bytes").cast("bigint").alias("payload_bytes"), "payload_digest",
        F.col("kind").alias("record_type"), "refers_to")


QUERIES = {"op7_warc": op7_warc}
ORACLE = {"op7_warc": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    r AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first FROM p)
    SELECT page_id, strlen(html) AS payload_bytes,
      array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ('0b' || substr(array_to_string([lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')
          FOR c IN string_split(sha1(html), '')], ''), 1 + 5 * i, 5))::INT, 1) FOR i IN range(32)], '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to
    FROM r"""}
