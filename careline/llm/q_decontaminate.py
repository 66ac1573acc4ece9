"""op1: benchmark passages in all documents."""

from pyspark.sql import functions as F

from careline.llm.common import read
from careline.llm.decontaminate import contamination


def op1_decontaminate(spark, sf_dir):
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE = {"op1_decontaminate": f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, list_slice(w, s + 1, s + 13) AS win
            FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 13, 0) + 1)) AS s
                  FROM i WHERE len(w) > 0)),
    ks AS (SELECT DISTINCT len(win) AS k FROM win),
    p AS (SELECT doc_id, s, k, list_slice(w, s + 1, s + k) AS win
          FROM (SELECT doc_id, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS s FROM d, ks)),
    m AS (SELECT doc_id, s, k, item_id FROM p JOIN win USING (win)),
    hit AS (SELECT doc_id, count(DISTINCT t) AS n_hit
            FROM (SELECT doc_id, unnest(range(s, s + k)) AS t FROM m) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
           FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""}
