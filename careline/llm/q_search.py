"""op11: the best documents of each benchmark item."""

from careline.llm.common import LOWER, UPPER, read
from careline.llm.search import ranked


def op11_ranked_search(spark, sf_dir):
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _terms(text: str) -> str:
    return (f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), "
            r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLE = {"op11_ranked_search": f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_terms("text")} AS w FROM documents),
    size AS (SELECT count(*) AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
    p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
    q AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS t FROM benchmark),
    w AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
          FROM p, size WHERE t IN (SELECT t FROM q) GROUP BY t),
    m AS (SELECT r, doc_id, 10 + (90 * len(w) * n) // l AS m FROM d, size),
    s AS (SELECT item_id, r, any_value(doc_id) AS doc_id,
                 sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (r) GROUP BY item_id, r)
    SELECT item_id, row_number() OVER best AS rank, doc_id, score FROM s WHERE score > 0
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10"""}
