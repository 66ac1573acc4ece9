"""Exact duplicates by an extendible-hash index on files of the shared folder.

Each text has a key, by default its hex SHA-256 digest. A directory over the first 16 bits of the keys starts
as one bucket and doubles while a bucket is overfull, by counts of distinct keys: a bucket of local
depth d owns the keys that share d bits, a range of keys.

Rows are combined by bucket, key, text and a part (``PARTS``, by a hash of the id) before they leave their
tasks, so a group that holds a third of all rows leaves each task as a few rows. These go to the owner
task of their bucket, which compares the texts of a key byte by byte: equal ones share a slot of its chain, and the slot
gets keep_id and group_size. Rows then find their slot by key, or by key and text where
a chain has several. Only DataFrame operations are used; distinct texts cross the network twice.

Defined cases: a null text is the empty text; of equal texts the largest id stays, a null
id only if the group has no other; repeated rows of one id and text give a row each, of
which one is kept; columns beyond id and text, whatever their names, play no part; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from careline.llm.common import filled, only, written

#: Bits of a key that the directory uses; it has at most 2**BITS = 65,536 cells, which is
#: the bound of the broadcast directory.
BITS = 16
#: Entries that a bucket holds before it is split.
CAPACITY = 2_048
#: Rows of one text that a task may send to the owner of its bucket.
PARTS = 4


def sha256_key(text: Column) -> Column:
    return F.sha2(text, 256)


def directory(counts: Iterable[tuple[int, int]], bits: int = BITS, capacity: int = CAPACITY
              ) -> list[tuple[int, int, int]]:
    """(cell, bucket, local depth) for every cell, from the entries counted per cell.

    Splits start from one bucket of depth 0. A bucket with more entries than ``capacity``
    is split by its next bit; the directory is as deep as its deepest bucket. A bucket at
    full depth stays overfull and its owner holds a longer run.
    """
    level = [0] * (1 << bits)
    for cell, n in counts:
        level[cell] = n
    sums = [level]
    while len(sums[-1]) > 1:
        low = sums[-1]
        sums.append([low[i] + low[i + 1] for i in range(0, len(low), 2)])
    sums.reverse()  # sums[d][p]: entries whose first d bits are p
    cells, todo, bucket = [], [(0, 0)], 0
    while todo:
        depth, p = todo.pop()
        if depth < bits and sums[depth][p] > capacity:
            todo += [(depth + 1, 2 * p + 1), (depth + 1, 2 * p)]
            continue
        width = 1 << (bits - depth)
        cells += [(c, bucket, depth) for c in range(p * width, (p + 1) * width)]
        bucket += 1
    return cells


def _cell(key: Column) -> Column:
    return F.conv(F.substring(key, 1, BITS // 4), 16, 10).cast("int")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          key: Callable[[Column], Column] = sha256_key) -> DataFrame:
    """id, text (null as empty) and key of each row. ``key`` gives hex digits, four at least;
    equal texts must have equal keys, unequal ones may collide."""
    text = filled(text_col)
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), key(text).alias("key"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                key: Callable[[Column], Column] = sha256_key, capacity: int = CAPACITY, parts: int = PARTS
                ) -> DataFrame:
    """The index, read from its files: bucket, depth, key, slot, chain, keep_id, group_size, n_bytes, text.
    ``chain`` is the number of different texts of a key, ``slot`` the place in it; texts are kept for chains of several."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col, key).withColumn("cell", _cell(F.col("key")))
    counts = rows.select("cell", "key").distinct().groupBy("cell").count().collect()  # 65,536 at most
    cells = spark.createDataFrame(
        directory([(r[0], r[1]) for r in counts], BITS, capacity), "cell int, bucket int, depth int")
    combined = (
        rows.join(F.broadcast(cells), "cell")
        .groupBy("bucket", "depth", "key", "text", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
        .agg(F.max("id").alias("id"), F.count("*").alias("n")))
    # all that follows happens in the owner's task
    owned = combined.repartition("bucket")
    along = Window.partitionBy("bucket", "key").orderBy("text")
    slots = owned.withColumn("slot", F.dense_rank().over(along)).groupBy("bucket", "depth", "key", "slot").agg(
        F.max("id").alias("keep_id"), F.sum("n").alias("group_size"), F.first("text").alias("text"))
    same = Window.partitionBy("bucket", "key")
    chained = slots.withColumn("chain", F.max("slot").over(same)).select(
        "bucket", "depth", "key", "slot", "chain", "keep_id", "group_size", F.octet_length("text").alias("n_bytes"),
        F.when(F.col("chain") > 1, F.col("text")).alias("text"))
    return written(chained, "index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 key: Callable[[Column], Column] = sha256_key, capacity: int = CAPACITY,
                 ) -> DataFrame:
    """One row per row of ``docs``: id, key, keep_id, group_size, kept.

    Rows find their slot by key. Keys with a chain of several texts, if the index has any,
    are looked up by bytes as well.
    """
    index = build_index(docs, id_col, text_col, key, capacity)
    rows = keyed(docs, id_col, text_col, key)
    plain = (
        rows.groupBy("id", "key").agg(F.count("*").alias("copies"))
        .join(index.filter("chain = 1").select("key", "keep_id", "group_size"), "key"))
    long = index.filter("chain > 1").select("key", "text", "keep_id", "group_size")
    if long.limit(1).count():
        met = rows.join(long.select("key").distinct(), "key", "left_semi")
        plain = plain.unionByName(
            met.groupBy("id", "key", "text").agg(F.count("*").alias("copies"))
            .join(long, ["key", "text"]).drop("text"))
    # repeated rows of an id: one of them is kept
    return plain.select(
        "id", "key", "keep_id", "group_size",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")
    ).select("id", "key", "keep_id", "group_size",
             (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group of equal texts."""
    index = build_index(docs, id_col, text_col)
    return only(docs, id_col, sha256_key(filled(text_col)), index, "keep_id", "key")
