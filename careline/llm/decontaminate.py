"""Benchmark passages inside documents: a prefix-filtered containment join.

A window is a run of 13 consecutive words of a benchmark item (a shorter item is one
window). Every word of the benchmark is counted in all documents, so that the words of a
window can be ordered by rarity. A document holds a window only if it holds the window's
rarest word, so one prefix word is joined; the window's place around that word must lie
inside the document (length bound), the second rarest word must stand at its place
(positional bound), and then the words are compared one by one.

Only DataFrame operations are used, and every text is split twice: for the word counts
and for the join. Both are projections of the scan; what is shuffled are counts and matches.
The windows are broadcast if their counted number allows it. Beyond that, words and windows
meet in a shuffled join, and the words around a candidate are fetched by a join on the row. Words
that are no window's rarest stay out of that shuffle if the keys alone can be broadcast, and
words are counted per task before they meet the vocabulary, so frequent ones do not pile up.

Defined cases: null or wordless texts have no words and no windows; repeated rows of one id
and text give a row each; an item id that occurs twice counts once, a null item id is the
string ``null``; columns with other names play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careline.llm.common import BROADCAST_ROWS, ascii_lower, bounded, filled, written

#: Words of a window.
WINDOW = 13
#: What stands between words, with A-Z taken as letters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def raw_words(text: Column) -> Column:
    """Words of a text, letters as they are."""
    return F.array_remove(F.split(text, GAP), "")


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """item_id as string, win (words), k (their number), without repeats."""
    words = raw_words(ascii_lower(filled(text_col)))
    last = F.greatest(F.size("words") - window, F.lit(0))
    return (
        items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item_id"),
                     words.alias("words"))
        .filter(F.size("words") > 0)
        .select("item_id", F.explode(F.transform(
            F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, window))).alias("win"))
        .select("item_id", "win", F.size("win").alias("k")).distinct())


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = filled(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"),
                       raw_words(text).alias("raw"))


def anchors(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id",
            text_col: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Per distinct window the places and keys of its two rarest words. Windows with a word
    that no document has are left out: they cannot occur."""
    wins = windows.select("win", "k").distinct()
    spots = wins.select("win", "k", F.posexplode("win").alias("o", "w")).select(
        "win", "k", "o", F.lower("w").alias("w"))
    vocabulary = written(spots.select("w").distinct(), "vocabulary")
    seen = _numbered(docs, id_col, text_col).select(F.explode("raw").alias("w")).select(
        F.lower("w").alias("w"))
    if bounded(vocabulary, limit):
        counted = seen.join(F.broadcast(vocabulary), "w").groupBy("w").agg(F.count("*").alias("n"))
    else:
        counted = seen.groupBy("w").agg(F.count("*").alias("n")).join(vocabulary, "w")
    counts = written(counted, "counts")
    ranked = spots.join(counts, "w").groupBy("win", "k").agg(
        F.sort_array(F.collect_list(F.struct("n", "o", "w"))).alias("by"))
    second = F.coalesce(F.get("by", F.lit(1)), F.get("by", F.lit(0)))
    return ranked.filter(F.size("by") == F.col("k")).select(
        "win", "k", F.col("by")[0]["w"].alias("key"), F.col("by")[0]["o"].alias("o"),
        (second["o"] - F.col("by")[0]["o"]).alias("step"), second["w"].alias("key2"))


def occurrences(docs: DataFrame, windows: DataFrame, id_col: str = "doc_id",
                text_col: str = "text", limit: int = BROADCAST_ROWS) -> DataFrame:
    """id, th (hash of the text), n_words, start, k, win of every occurrence of a window; and
    one row with k = 0 for each row of ``docs``, so that its words are counted in the same pass."""
    rare = written(anchors(docs, windows, id_col, text_col, limit), "anchors")
    rows = _numbered(docs, id_col, text_col).withColumn("n_words", F.size("raw"))
    none = F.array().cast("array<string>")
    start = F.col("p") - F.col("o")
    fits = (start >= 0) & (start + F.col("k") <= F.col("n_words"))
    second = F.lower(F.get("raw", F.col("p") + F.col("step"))) == F.col("key2")
    part = F.slice("raw", F.greatest(start, F.lit(0)) + 1, F.col("k"))
    same = ascii_lower(F.array_join(part, " ")) == F.array_join("win", " ")
    columns = ["id", "th", "n_words", start.alias("start"), "k", "win"]
    if bounded(rare, limit):
        blank = rare.sparkSession.range(1).select(
            none.alias("win"), F.lit(0).alias("k"), F.lit("").alias("key"), F.lit(0).alias("o"),
            F.lit(0).alias("step"), F.lit("").alias("key2"))
        head = F.concat(F.array(F.lit("")), F.col("raw"))  # the empty word stands for the row itself
        met = rows.select("id", "th", "n_words", "raw", F.posexplode(head).alias("p", "w"))
        met = met.withColumn("p", F.col("p") - 1).withColumn("key", F.lower("w")).join(
            F.broadcast(rare.unionByName(blank)), "key")
        return met.filter((F.col("k") == 0) | (fits & second & same)).select(columns)
    keys = written(rare.select("key").distinct(), "keys")
    met = rows.select("id", "th", "n_words", F.posexplode("raw").alias("p", "w")).withColumn("key", F.lower("w"))
    if bounded(keys, limit):
        met = met.join(F.broadcast(keys), "key", "left_semi")
    texts = rows.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "raw").dropDuplicates(["_id", "_th"])
    met = met.join(rare, "key").filter(fits).join(
        texts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    own = rows.select("id", "th", "n_words", F.lit(-1).alias("start"), F.lit(0).alias("k"), none.alias("win"))
    return met.filter(second & same).select(columns).unionByName(own)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  window: int = WINDOW, share: int = 20, limit: int = BROADCAST_ROWS) -> DataFrame:
    """id, th, n_words, n_hit, item_ids, contaminated of every row of ``docs``. A row is contaminated if
    at least one word in ``share`` lies inside an occurrence of a window."""
    windows = written(item_windows(items, item_col, item_text, window), "windows")
    found = written(occurrences(docs, windows, id_col, text_col, limit), "occurrences")
    rows = found.filter("k = 0").groupBy("id", "th").agg(
        F.count("*").alias("copies"), F.max("n_words").cast("bigint").alias("n_words"))
    hits = found.filter("k > 0")
    order = Window.partitionBy("id", "th").orderBy("start")
    end = F.col("start") + F.col("k")
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(before, F.lit(0))))
    spans = hits.groupBy("id", "th", "start").agg(F.max("k").alias("k"))
    covered = spans.select("id", "th", new.alias("new")).groupBy("id", "th").agg(
        F.sum("new").alias("n_hit"))
    named = hits.select("id", "th", "win").distinct().join(windows.select("item_id", "win"), "win")
    names = named.groupBy("id", "th").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    hit = covered.join(names, _same_row(covered, names)).select(
        covered["id"].alias("_id"), covered["th"].alias("_th"), "n_hit", "item_ids")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.join(hit, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select(
        "id", "th", "n_words", n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).drop("copy")


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    bad = written(contamination(docs, items, id_col, text_col).filter("contaminated")
                  .select("id", "th").distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"),
                       F.xxhash64(filled(text_col)).alias("row_th"))
    return rows.join(bad, rows["row_id"].eqNullSafe(bad["id"]) & (rows["row_th"] == bad["th"]),
                     "left_anti").select("row.*")
