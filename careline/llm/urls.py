"""Block and allow rules for URLs, and their propagation over redirects and canonical links.

A rule is a host, a path and a verdict; it fits its host and all subdomains of it, where the path of
the URL starts with the path of the rule. The longest rule that fits (host and path together) decides;
of equally long ones, one that allows goes first, then the smaller host and path.

URLs that a page's canonical link or meta refresh, or a row of a table of redirects, names as the same
document are linked, and connected components of the links are its classes of aliases. A URL
without a rule of its own takes over from its class: it is allowed if some alias is explicitly
allowed, else blocked if some alias is blocked, else allowed. Links compare URLs with scheme and
host in lower case, without fragment, and with ``/`` for an empty path.

Rules are a table. Hosts and paths are judged once each: the suffixes of a host meet the hosts of rules,
and only the path lengths that such a host has are looked up. Small rule tables are broadcast
after they have been counted, others are joined by a shuffle; so are decisions. Components run in
written rounds of minimum labels, so hubs are aggregated in their own tasks before any exchange.
Only DataFrame operations are used, and the html is read once, for links.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule, no aliases, and is
allowed; a null html has no links; repeated rows are judged each; a link to itself plays no part; of several
canonical links in a page all are edges; links inside comments and scripts do not count; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careline.llm.common import ascii_lower, filled, small_side, written
from careline.llm.simhash import components

ALLOW, BLOCK = "allow", "block"
RULE = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The form in which links compare URLs; null if there is no ``://``."""
    path = path_of(url)
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    scheme = ascii_lower(F.regexp_extract(F.trim(url), r"^([^:/?#]*)://", 1))
    return F.when(url.contains("://"), F.concat(
        scheme, F.lit("://"), host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, or the empty text."""
    pattern = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.trim(F.regexp_replace(value, "&amp;", "&"))


def _without_dots(path: Column) -> Column:
    """A path whose segments ``.`` and ``..`` are resolved."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == ".", done).when(
        p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(p))))
    end = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), end)).otherwise(path)


def resolved(link: Column, base: Column) -> Column:
    """The URL that ``link`` means on the page ``base``; null for an empty one."""
    scheme = F.regexp_extract(F.trim(base), r"^([^:/?#]*)://", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, r"://([^/?#]*)", 1))
    path = path_of(base)
    folder = F.concat(F.regexp_extract(path, r"^(.*/)?", 1))
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    own, rest = F.regexp_extract(link, r"^([^?#]*)", 1), F.regexp_extract(link, r"^[^?#]*(.*)", 1)
    return (F.when((link == "") | link.startswith("#"), F.lit(None).cast("string"))
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("?"), F.concat(origin, path, link))
            .when(link.startswith("/"), F.concat(origin, _without_dots(own), rest))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), rest)))


def page_links(html: Column) -> Column:
    """Targets of canonical links and meta refreshes, as written, of a page."""
    head = F.regexp_replace(html, r"(?s)<!--.*?-->|(?i:<script\b.*?</script\s*>)", " ")
    tags = F.regexp_extract_all(head, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), 0)
    canonical = F.filter(tags, lambda t: t.rlike("(?i)^<link") & F.array_contains(
        F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    refresh = F.filter(tags, lambda t: t.rlike("(?i)^<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh"))
    return F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(refresh, lambda t: F.trim(F.regexp_extract(
            _attribute(t, "content"), r"""(?i)url\s*=\s*['"]?([^'"]*)""", 1))))


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                redirects: DataFrame | None = None) -> DataFrame:
    """a, b: different URLs (as ``node_of`` has them) that are linked. ``redirects`` has from_url, to_url."""
    url = F.col(url_col)
    named = pages.filter(url.contains("://") & F.col(html_col).rlike(r"(?i)canonical|refresh")).select(
        url.alias("from_url"), F.explode(page_links(F.col(html_col))).alias("link")).select(
        "from_url", resolved(F.col("link"), F.col("from_url")).alias("to_url"))
    if redirects is not None:
        named = named.unionByName(redirects.select("from_url", "to_url"))
    ends = named.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b"))
    return ends.filter("a <> b").distinct()


def fitting(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, verdict of the distinct hosts and paths in ``places`` that a rule fits."""
    own = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"),
                       F.col("verdict").alias("rule_verdict"))
    own = written(own.filter(F.col("rule_host") != "").groupBy("rule_host", "rule_path").agg(
        F.min("rule_verdict").alias("rule_verdict")), "rules")
    lengths = written(own.groupBy("rule_host").agg(
        F.collect_set(F.length("rule_path")).alias("sizes")), "rule-hosts")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    met = (places.filter(F.col("host") != "").select("host", "path").distinct()
           .select("host", "path", F.explode(suffixes).alias("rule_host"))
           .join(small_side(lengths), "rule_host")
           .select("host", "path", "rule_host", F.explode("sizes").alias("size"))
           .filter(F.col("size") <= F.length("path"))
           .withColumn("rule_path", F.expr("substring(path, 1, size)"))
           .join(small_side(own), ["rule_host", "rule_path"]))
    order = F.struct(-(F.length("rule_host") + F.col("size")), F.col("rule_verdict"), "rule_host", "rule_path")
    return met.groupBy("host", "path").agg(F.min(order).alias("best")).select(
        "host", "path", F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.col("best.rule_verdict").alias("verdict"))


def class_decisions(links: DataFrame, rules: DataFrame) -> DataFrame:
    """node, verdict of every linked URL whose class has an explicit verdict."""
    roots = written(components(links), "classes")
    ends = roots.select("node").unionByName(roots.select(F.col("root").alias("node"))).distinct().select(
        "node", host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"))
    own = ends.join(small_side(written(fitting(ends, rules), "class-rules")), ["host", "path"]).select("node", "verdict")
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    classes = members.join(own, "node").groupBy("root").agg(F.min("verdict").alias("verdict"))  # allow < block
    return members.join(classes, "root").select("node", "verdict")


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", html_col: str = "html",
           keep: list[str] | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """The columns ``keep`` of ``pages`` (by default all but host, path, rule and verdict) with host,
    path, rule (null if none fits) and verdict. ``rules``: host, path, verdict (allow or block)."""
    made = ["host", "path", "rule", "verdict"]
    kept = [c for c in (pages.columns if keep is None else keep) if c not in made]
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(url).alias("host"),
                        path_of(url).alias("path"), node_of(url).alias("node"))
    found = small_side(written(fitting(rows, rules), "fitting"))
    rows = rows.join(found, ["host", "path"], "left")
    links = written(alias_links(pages, url_col, html_col, redirects), "alias-links")
    if links.limit(1).count():
        classes = small_side(written(class_decisions(links, rules), "decisions")).withColumnRenamed("verdict", "taken")
        rows = rows.join(classes, "node", "left")
    else:
        rows = rows.withColumn("taken", F.lit(None).cast("string"))
    return rows.select("row.*", "host", "path", "rule",
                       F.coalesce("verdict", "taken", F.lit(ALLOW)).alias("verdict"))
