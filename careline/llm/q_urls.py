"""op13: rules for the URLs of all pages."""

from careline.llm import urls
from careline.llm.common import read

#: Verdict, host and path of each rule.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op13_url_filter(spark, sf_dir):
    rules = spark.createDataFrame([(h, p, v) for v, h, p in RULES], urls.RULE)
    return urls.judged(read(spark, sf_dir, "pages").select("page_id", "url", "html"), rules, keep=["page_id"])


def _attribute(tag: str, name: str) -> str:
    q = "''"
    return (f"trim(replace(coalesce(regexp_extract({tag}, '(?i)[\\s\"{q}/]{name}\\s*=\\s*\"([^\"]*)\"', 1), '') || "
            f"coalesce(regexp_extract({tag}, '(?i)[\\s\"{q}/]{name}\\s*=\\s*{q}([^{q}]*){q}', 1), '') || "
            f"coalesce(regexp_extract({tag}, '(?i)[\\s\"{q}/]{name}\\s*=\\s*([^\\s\"{q}>]+)', 1), ''), '&amp;', '&'))")


def _node(url: str) -> str:
    return (f"CASE WHEN contains({url}, '://') THEN lower(regexp_extract({url}, '^([^:/?#]*)://', 1)) || '://' || "
            f"lower(regexp_extract({url}, '://([^/?#]*)', 1)) || "
            f"coalesce(nullif(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), ''), '/') || "
            f"regexp_extract({url}, '://[^?#]*(\\?[^#]*)', 1) END")


def _judged(table: str, key: str) -> str:
    """key, rule, verdict of the rows of a table with host and path that a rule fits."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in RULES)
    return (f"SELECT {key}, first(r.host || r.path ORDER BY length(r.host || r.path) DESC, r.verdict) AS rule, "
            f"first(r.verdict ORDER BY length(r.host || r.path) DESC, r.verdict) AS verdict "
            f"FROM {table} t JOIN (VALUES {rules}) r(host, path, verdict) ON starts_with(t.path, r.path) "
            f"AND (t.host = r.host OR ends_with(t.host, '.' || r.host)) GROUP BY {key}")


QUERIES = {"op13_url_filter": op13_url_filter}
ORACLE = {"op13_url_filter": f"""
    WITH RECURSIVE p AS (
      SELECT page_id, html, coalesce(url, '') AS url,
        lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, {_node("url")} AS node FROM pages),
    tag AS (SELECT url, node, unnest(regexp_extract_all(regexp_replace(html,
        '(?s)<!--.*?-->|(?i:<script\\b.*?</script\\s*>)', ' ', 'g'), '(?i)<(?:link|meta)\\b[^>]*>')) AS tag FROM p),
    raw AS (
      SELECT url, node, {_attribute("tag", "href")} AS link FROM tag WHERE regexp_matches(tag, '(?i)^<link')
        AND list_contains(regexp_split_to_array(lower({_attribute("tag", "rel")}), '\\s+'), 'canonical')
      UNION ALL
      SELECT url, node, regexp_extract({_attribute("tag", "content")}, '(?i)url\\s*=\\s*[''"]?([^''"]*)', 1) FROM tag
        WHERE regexp_matches(tag, '(?i)^<meta') AND lower({_attribute("tag", "http-equiv")}) = 'refresh'),
    target AS (SELECT node, CASE
        WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
        WHEN starts_with(link, '//') THEN regexp_extract(url, '^([^:/?#]*)://', 1) || ':' || link
        WHEN starts_with(link, '/') THEN regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1) || link END AS url FROM raw),
    edge AS (SELECT DISTINCT node AS a, {_node("url")} AS b FROM target),
    ways AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
    reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, e.b FROM reach r JOIN ways e ON r.b = e.a),
    place AS (SELECT DISTINCT b, regexp_extract(b, '://([^/?#]*)', 1) AS host,
        regexp_extract(b, '://[^/?#]*([^?#]*)', 1) AS path FROM reach),
    taken AS (SELECT a, min(verdict) AS verdict FROM reach JOIN ({_judged("place", "b")}) USING (b) GROUP BY a),
    own AS ({_judged("(SELECT DISTINCT url, host, path FROM p)", "url")})
    SELECT page_id, host, path, rule, coalesce(own.verdict, taken.verdict, 'allow') AS verdict
    FROM p LEFT JOIN own USING (url) LEFT JOIN taken ON p.node = taken.a"""}
