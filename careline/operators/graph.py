"""Property-graph operators over node and edge tables.

Nodes: label, name, id, description. Edges: src, dst, rel (by node name). Look-ups are
equi-joins on node names; "contains" look-ups are keyed by the rarest short character gram first,
so that they are hash joins and not nested loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careline.functions.core import mapping, nz, strings, unpack
from careline.functions.lexicon import colloquial_terms, keyword_hits
from careline.rules import graph_seed as G
from careline.rules import medical
from careline.sources.scratch import written

#: Offers of a gram that one part of a look-up holds, about.
HUB_ROWS = 10_000
#: Needles, and characters of them, that are tried on each haystack in place.
HELD_NEEDLES, HELD_CHARS = 256, 16_384
NODE_SCHEMA = "label string, name string, id string, description string"
EDGE_SCHEMA = "src string, dst string, rel string"
PROFILE = {  # kind -> relation, side of the condition
    "symptom": ("SYMPTOM_OF", "dst"), "treatment": ("MANAGED_BY", "src"),
    "body_part": ("AFFECTS", "src"), "risk_factor": ("CAUSES", "dst"),
    "prevention": ("PREVENTS", "dst"),
}


def seed_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    nodes = spark.createDataFrame([(la, n, None, d) for n, la, d in G.NODES], NODE_SCHEMA)
    edges = spark.createDataFrame([(s, d, r) for s, d, r in G.EDGES], EDGE_SCHEMA)
    return nodes, edges


def node_name(alias: str | None = None) -> Column:
    p = f"{alias}." if alias else ""
    return F.coalesce(F.col(p + "name"), F.col(p + "id"))


# ---- writes -----------------------------------------------------------------------

def merge_nodes(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert or update by (label, name); the description of an update wins."""
    both = nodes.withColumn("_v", F.lit(0)).unionByName(
        updates.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return both.groupBy("label", "name").agg(
        F.max_by("id", F.struct(F.col("id").isNotNull(), F.col("_v"), F.col("id"))).alias("id"),
        F.max_by("description", F.struct("_v", "description")).alias("description")
    ).select("label", "name", "id", "description")


def node_keys(nodes: DataFrame) -> DataFrame:
    """Every name or id a node answers to, with one node per key (smallest label, name)."""
    keys = nodes.select(
        F.explode(F.array_distinct(F.array_compact(F.array("name", "id")))).alias("key"),
        "label", node_name().alias("node"))
    return keys.groupBy("key").agg(F.min(F.struct("label", "node")).alias("_n")).select(
        "key", F.col("_n.node").alias("node"), F.col("_n.label").alias("label"))


def merge_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends resolved by name or id, without repeats. An edge with an
    unknown end is left out."""
    keys = node_keys(nodes).select("key", "node")
    return (
        edges.join(keys.toDF("src", "_a"), "src").join(keys.toDF("dst", "_b"), "dst")
        .select(F.col("_a").alias("src"), F.col("_b").alias("dst"), "rel").distinct()
    )


def load_triples(triples: DataFrame, nodes: DataFrame, edges: DataFrame,
                 labels: Sequence[str] = tuple(G.LABELS),
                 relations: Sequence[str] = tuple(G.RELATIONS),
                 reset: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extracted triples, filtered to the allow-lists, merged into the graph.

    Returns nodes, edges and the load statistics (documents processed and failed).
    """
    good = triples.filter("error is null")
    ends = good.select(F.explode(F.array(
        F.struct(F.col("src_label").alias("label"), F.col("src").alias("name")),
        F.struct(F.col("dst_label").alias("label"), F.col("dst").alias("name")))).alias("n"),
    ).select("n.label", "n.name").filter(F.col("label").isin(list(labels))).distinct()
    fresh = ends.select("label", "name", F.lit(None).cast("string").alias("id"),
                        F.lit(None).cast("string").alias("description"))
    base = nodes.limit(0) if reset else nodes
    all_nodes = base.unionByName(fresh.join(base, ["label", "name"], "left_anti"))
    allowed = good.filter(F.col("rel").isin(list(relations))).select("src", "dst", "rel")
    old = edges.limit(0) if reset else edges
    all_edges = merge_edges(all_nodes, old.unionByName(allowed))
    stats = triples.agg(
        F.countDistinct(F.when(F.col("error").isNull(), F.col("doc_id"))).alias("processed_docs"),
        F.countDistinct(F.when(F.col("error").isNotNull(), F.col("doc_id"))).alias("failed_docs"))
    return all_nodes, all_edges, stats


# ---- look-ups ---------------------------------------------------------------------

def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("node_count"))
    return n.join(F.broadcast(edges.agg(F.count("*").alias("edge_count"))))


def names_by_label(nodes: DataFrame, label: str | None = None) -> DataFrame:
    named = nodes.select("label", node_name().alias("name")).filter("name is not null")
    return named if label is None else named.filter(F.col("label") == label)


def condition_profile(nodes: DataFrame, edges: DataFrame, label: str = "Condition",
                      body_label: str = "BodyPart", kinds: dict | None = None) -> DataFrame:
    """Distinct neighbours of every condition by kind, as rows.

    One scan of the edges gives all kinds; there is no product of the five lists and no
    list per condition, so a condition with very many neighbours is many rows.
    """
    kinds = kinds or PROFILE
    rows = F.array_compact(F.array(*[
        F.when(F.col("rel") == rel, F.struct(
            F.col(side).alias("condition"),
            F.col("src" if side == "dst" else "dst").alias("other"), F.lit(kind).alias("kind")))
        for kind, (rel, side) in kinds.items()]))
    ends = edges.select(F.inline(rows))
    named = nodes.select("label", node_name().alias("n"), "description")
    conditions = named.filter(F.col("label") == label).select(
        F.col("n").alias("condition"), F.col("description").alias("condition_description"))
    others = named.select(F.col("n").alias("other"), F.col("label").alias("other_label"),
                          F.col("description").alias("other_description"))
    return (
        ends.join(conditions, "condition").join(others, "other")
        .filter((F.col("kind") != "body_part") | (F.col("other_label") == body_label))
        .select("condition", "condition_description", "kind", F.col("other").alias("name"),
                F.col("other_description").alias("description")).distinct()
    )


def packed_profiles(nodes: DataFrame, edges: DataFrame, profile: DataFrame | None = None,
                    label: str = "Condition") -> DataFrame:
    """One row per condition with sorted lists per kind (for graphs of bounded degree)."""
    profile = condition_profile(nodes, edges, label) if profile is None else profile

    def items(kind: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.struct(
            "name", nz("description").alias("description")))))

    lists = profile.groupBy("condition").agg(*[items(k).alias(k) for k in PROFILE])
    every = nodes.filter(F.col("label") == label).select(
        node_name().alias("condition"), nz("description").alias("description")).distinct()
    return every.join(lists, "condition", "left")


def grams(c: Column, width: int) -> Column:
    """Distinct stretches of ``width`` characters, or the whole of a shorter text."""
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(c) - (width - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(width))))


def contains_join(needles: DataFrame, haystacks: DataFrame, needle: str, haystack: str,
                  width: int = 3, hub: int = HUB_ROWS, held: int = HELD_NEEDLES) -> DataFrame:
    """Inner join where the haystack contains the needle. Empty needles match nothing here.

    Up to ``held`` distinct needles (and ``HELD_CHARS`` characters) are tried on each haystack where it is, in one
    projection. Of more than that, a needle is looked up by the rarest of its grams (stretches of ``width`` characters, or all of a shorter
    needle). The grams that needles use are counted over the distinct haystacks first; needles with a gram that no
    haystack has are out. Haystacks then offer the chosen grams only, under a number and without their texts. A gram with
    more than ``hub`` offers is dealt to several parts, and its needles are copied to each. Texts are joined back to
    the candidates by number and verified, so what is shuffled grows with the candidates and not with the texts.
    """
    asked = needles.select(F.col(needle).alias("_n")).filter(F.length("_n") > 0).groupBy("_n").agg(F.count("*").alias("_c"))
    counted = asked.limit(held + 1).collect()
    few = sorted(r["_n"] for r in counted)
    if len(few) <= held and sum(map(len, few)) <= HELD_CHARS:
        met = haystacks.withColumn("_n", F.explode(F.filter(strings(few), lambda n: F.contains(F.col(haystack), n))))
        if needles.columns == [needle] and needle not in haystacks.columns and all(r["_c"] == 1 for r in counted):
            # needles that are nothing but distinct texts have nothing to add
            return met.select(F.col("_n").alias(needle), *haystacks.columns)
        return needles.join(met, F.col(needle) == F.col("_n")).drop("_n")
    texts = written(haystacks.select(F.col(haystack).alias("_h")).filter(F.length("_h") > 0).distinct()
                    .withColumn("_id", F.xxhash64("_h")), "texts")
    asked = written(needles.select(F.col(needle).alias("_n")).filter(F.length("_n") > 0).distinct()
                    .select("_n", F.explode(grams(F.col("_n"), width)).alias("_g")), "grams")
    sizes = F.array(*[F.lit(r[0]) for r in asked.select(F.length("_g")).distinct().collect()])  # up to ``width`` numbers
    every = F.array_distinct(F.flatten(F.transform(sizes, lambda n: F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("_h") - (n - 1), F.lit(1))), lambda i: F.substring("_h", i, n)))))
    offered = texts.select("_id", F.explode(every).alias("_g"))
    counts = written(offered.join(asked.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(
        F.count("*").alias("_c")), "gram-counts")
    keyed = written(asked.join(counts, "_g", "left").groupBy("_n").agg(
        F.min(F.struct(F.coalesce("_c", F.lit(0)).alias("c"), F.col("_g").alias("g"))).alias("_k"))
        .filter("_k.c > 0").select("_n", F.col("_k.g").alias("_g"), F.ceil(F.col("_k.c") / hub).cast("int").alias("_parts")), "keyed")
    keys = keyed.select("_g", "_parts").distinct()
    offers = offered.join(keys, "_g").select("_id", "_g", F.pmod("_id", F.col("_parts")).cast("int").alias("_part"))
    spread = keyed.select("_n", "_g", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    met = spread.join(offers, ["_g", "_part"]).select("_n", "_id").join(texts, "_id").filter(
        F.contains("_h", F.col("_n"))).select("_n", "_h").distinct()  # numbers could clash
    return (needles.join(met, F.col(needle) == F.col("_n"))
            .join(haystacks, F.col("_h") == F.col(haystack)).drop("_n", "_h"))


def symptom_conditions(keywords: DataFrame, nodes: DataFrame, edges: DataFrame,
                       keyword: str = "keyword", symptom: str = "Symptom",
                       condition: str = "Condition", relation: str = "SYMPTOM_OF") -> DataFrame:
    """Distinct conditions of the symptoms whose name or id holds the keyword."""
    keys = nodes.filter(F.col("label") == symptom).select(
        node_name().alias("src"),
        F.explode(F.array_distinct(F.array_compact(F.array("name", "id")))).alias("_key"))
    conditions = nodes.filter(F.col("label") == condition).select(node_name().alias("dst"))
    # symptoms meet their conditions first, so no row per keyword and symptom is moved
    linked = keys.join(edges.filter(F.col("rel") == relation).select("src", "dst"), "src").join(
        conditions.distinct(), "dst", "left_semi").select("_key", F.col("dst").alias("condition"))
    return contains_join(keywords.select(keyword).distinct(), linked, keyword, "_key").select(
        keyword, "condition").distinct()


def related_nodes(keywords: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2,
                  keyword: str = "keyword", starts: int = G.START_NODES,
                  limit: int = G.RELATED_LIMIT) -> DataFrame:
    """Nodes within ``depth`` hops (at most 3) of the nodes that hold the keyword.

    Hops go both ways and use an edge once per path. Starts are the first ``starts``
    nodes by name; results are ordered by distance, then name.

    One frontier is moved, and written after each hop: keyword, start, node, and of the used edges those that could be
    used again from there (the others cannot matter), so paths that differ otherwise are one row. A hop gives the best
    ``limit`` nodes of each keyword, and keywords that have as many go no further, so only
    small neighbourhoods are entered. Of the neighbours of a node the first ``limit`` by name, and as many more as a
    path may exclude, are enough for both; hubs are cut to them before they meet the keywords.
    """
    named = written(nodes.select(node_name().alias("name"), F.col("label").alias("type"), "id",
                                 "description").filter("name is not null"), "named")
    texts = named.select("name", F.explode(F.array_distinct(F.array_compact(
        F.array("name", "id", "description")))).alias("_t"))
    edge_id = F.concat_ws("\u0001", "src", "rel", "dst")
    both = written(edges.select(F.inline(F.array(
        F.struct(F.col("src").alias("_at"), F.col("dst").alias("_to"), edge_id.alias("_e")),
        F.struct(F.col("dst").alias("_at"), F.col("src").alias("_to"), edge_id.alias("_e"))))).distinct(), "both")
    known = named.select(F.col("name").alias("_to"), F.lit(True).alias("_known")).distinct()
    first = Window.partitionBy(keyword).orderBy("_start")
    by_name = Window.partitionBy("_at", "_known").orderBy("_to")
    # an edge that touches neither end of the next hop cannot be used by it
    touching = F.array_sort(F.array_distinct(F.filter(
        F.array_append("_used", F.col("_e")), lambda e: F.array_contains(_ends(e), F.col("_to")))))
    frontier = written(
        contains_join(keywords.select(keyword).distinct(), texts, keyword, "_t")
        .select(keyword, F.col("name").alias("_start")).distinct()
        .withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= starts)
        .select(keyword, "_start", F.col("_start").alias("_at"), strings([]).alias("_used")), "starts")
    order = Window.partitionBy(keyword).orderBy("name", "type", "description")
    reached, last = [], min(depth, G.MAX_DEPTH)
    for distance in range(1, last + 1):
        # nodes that edges name and no row describes are passed through, but are no results
        ways = both.join(frontier.select("_at").distinct(), "_at", "left_semi").join(known, "_to", "left").withColumn(
            "_r", F.dense_rank().over(by_name)).filter(F.col("_known").isNull() | (F.col("_r") <= limit + depth + 1))
        step = frontier.join(ways.drop("_r"), "_at").filter(~F.array_contains("_used", F.col("_e"))).select(
            keyword, "_start", "_to", "_known", touching.alias("_used")).distinct()
        step = step if distance == last else written(step, f"hop-{distance}")
        reached.append(
            step.filter(F.col("_known") & (F.col("_to") != F.col("_start"))).select(keyword, F.col("_to").alias("name")).distinct()
            .join(named.select("name", "type", "description"), "name").distinct()
            .withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= limit)
            .select(keyword, "name", "type", "description", F.lit(distance).alias("distance")))
        full = _union(reached).groupBy(keyword).count().filter(F.col("count") >= limit)
        frontier = step.join(full, keyword, "left_anti").select(keyword, "_start", F.col("_to").alias("_at"), "_used")
    w = Window.partitionBy(keyword).orderBy("distance", "name", "type", "description")
    return (
        _union(reached).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit)
        .select(keyword, "name", "type", "description", "distance")
    )


def _ends(edge: Column) -> Column:
    parts = F.split(edge, "\u0001")
    return F.array(parts[0], F.element_at(parts, -1))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---- keywords and context ---------------------------------------------------------

def rule_keywords(text: Column | str, names: Sequence[str]) -> Column:
    """Node names in the text, then medical terms for colloquial wording."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.concat(keyword_hits(c, names), colloquial_terms(c)))


def hybrid_keywords(rules: Column, matched: Column | None = None,
                    fallback: Column | None = None, keep: int = G.KEYWORDS_KEPT) -> Column:
    """Ordered union of rule and vector keywords; the fallback only where both are empty."""
    none = strings([])
    found = F.array_distinct(F.concat(rules, none if matched is None else matched))
    if fallback is not None:
        found = F.when(F.size(found) == 0, fallback).otherwise(found)
    return F.slice(found, 1, keep)


def format_profile(profile: DataFrame) -> DataFrame:
    """Packed profiles as text blocks (condition, block, has_symptoms)."""

    def names(kind: str) -> Column:
        return F.array_join(F.transform(kind, lambda x: x["name"]), ", ")

    def line(kind: str, label: str) -> Column:
        return F.when(F.size(kind) > 0, F.array(F.concat(F.lit(label), names(kind)))).otherwise(
            strings([]))

    treatments = F.transform("treatment", lambda t: F.concat(
        F.lit(G.FMT_TREATMENT), t["name"], F.lit(G.FMT_DASH), t["description"]))
    lines = F.concat(
        F.array(F.concat(F.lit(G.FMT_HEAD), "condition", F.lit(": "), "description")),
        line("symptom", G.FMT_SYMPTOMS), F.coalesce(treatments, strings([])),
        line("prevention", G.FMT_PREVENTION), line("risk_factor", G.FMT_RISK))
    return profile.select("condition", F.array_join(lines, "\n").alias("block"),
                          (F.size("symptom") > 0).alias("has_symptoms"))


def group_by_type(related: DataFrame, keyword: str = "keyword",
                  per_type: int = G.NAMES_PER_TYPE) -> DataFrame:
    """First nodes of each type as one ``name(description), …`` text per keyword and type."""
    w = Window.partitionBy(keyword, "type").orderBy("distance", "name")
    kept = related.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_type)
    return kept.groupBy(keyword, "type").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", F.concat(
            "name", F.lit("("), nz("description"), F.lit(")")).alias("t")))),
        lambda x: x["t"]), ", ").alias("names"))


def keyword_blocks(nodes: DataFrame, edges: DataFrame, keywords: DataFrame) -> DataFrame:
    """Text blocks of every keyword in order: conditions of matching symptoms, the
    condition itself, else the neighbourhood."""
    nodes, edges, keywords = written(nodes, "nodes"), written(edges, "edges"), written(keywords, "keywords")
    blocks = written(format_profile(packed_profiles(nodes, edges)), "profiles")
    via = symptom_conditions(keywords, nodes, edges).join(blocks, "condition").select(
        "keyword", F.lit(0).alias("part"), F.col("condition").alias("o"), "block")
    direct = keywords.join(blocks.filter("has_symptoms"),
                           F.col("keyword") == F.col("condition")).select(
        "keyword", F.lit(1).alias("part"), F.lit("").alias("o"), "block")
    told = written(via.unionByName(direct), "told")
    open_ = keywords.join(told.select("keyword").distinct(), "keyword", "left_anti")
    grouped = group_by_type(related_nodes(open_, nodes, edges, 2))
    label = mapping(G.TYPE_LABELS)
    rank = F.array_position(strings([t for t, _ in G.TYPE_LABELS]), F.col("type"))
    around = (
        grouped.filter(rank > 0).groupBy("keyword").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.concat(
                F.lit("  "), label[F.col("type")], F.lit(": "), "names").alias("t")))),
            lambda x: x["t"]), "\n").alias("lines"))
        .select("keyword", F.lit(2).alias("part"), F.lit("").alias("o"), F.concat(
            F.lit(G.FMT_HEAD + "'"), "keyword", F.lit(G.FMT_RELATED + "\n"), "lines")
            .alias("block"))
    )
    return told.unionByName(around)


def keyword_vocabulary(nodes: DataFrame) -> DataFrame:
    """Every keyword the rules can give: node names and terms for colloquial wording."""
    terms = F.explode(strings(sorted({t for _, t in medical.COLLOQUIAL})))
    named = nodes.select(node_name().alias("keyword")).filter("keyword is not null")
    return named.unionByName(nodes.sparkSession.range(1).select(terms.alias("keyword"))).distinct()


def graph_context(texts: DataFrame, nodes: DataFrame, edges: DataFrame, ident: str,
                  keywords: str = "keywords", keep: int = G.CONTEXTS_KEPT,
                  vocabulary: DataFrame | None = None) -> DataFrame:
    """First distinct blocks of the keywords of each text, joined by lines.

    The blocks are worked out once per keyword of the vocabulary, which depends on the
    graph and not on the texts; texts then join them by key and are read once.
    """
    exploded = unpack(texts, [ident], F.col(keywords), "keyword", "_k", ["keyword"])
    blocks = written(keyword_blocks(
        nodes, edges, keyword_vocabulary(nodes) if vocabulary is None else vocabulary), "blocks")
    parts = exploded.join(blocks, "keyword")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_k", "part", "o", "block"))),
                          lambda x: x["block"])
    return parts.groupBy(ident).agg(F.array_join(
        F.slice(F.array_distinct(ordered), 1, keep), "\n").alias("graph_context"))
