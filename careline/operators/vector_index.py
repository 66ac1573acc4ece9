"""An index of inverted lists for vector search.

Centroids are fitted on a bounded sample (about ``SAMPLE_ROWS`` rows, by a hash of the id); every row of the table
is then assigned to its nearest centroid and written to that centroid's list, a partition folder. A search
reads only the lists it probes: the folders of others are pruned when the scan is planned. Scores of the rows read are exact.

With ``exact`` no hit is missed. Each list knows the widest angle between its centroid and a row, so the
best score that any row of it can have with a query is the cosine of the angle to the centroid less that width. After the
nearest lists have been probed, the lists whose bound reaches the k-th best score found are read as well; all others
cannot hold a better row. Without it only the ``probes`` nearest lists are read, and recall depends on them.

``costs`` tells for each query how many lists, rows and bytes were compared with it, out of how many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from careline.operators.retrieval import (
    HELD_ROWS, HELD_VALUES, SCORE_DIGITS, Best, _normal, _type, _with_distance, _with_vectors, arrow_matrix, found_batch, held_side)

#: Rows that centroids are fitted on, about; most lists of an index; and rounds of fitting.
SAMPLE_ROWS, MOST_LISTS, ROUNDS = 50_000, 4_096, 12
#: Lists that are read for each query, at first or at all.
PROBES = 8
#: What rounding may add to a score.
SLACK = 2 * 10.0 ** -SCORE_DIGITS


@dataclass
class Index:
    """Where the lists lie, and what is known of each: centroid, rows, bytes, and cosine of the widest angle."""

    path: str
    numbers: np.ndarray
    centroids: np.ndarray
    rows: np.ndarray
    size: np.ndarray
    widest: np.ndarray


@dataclass
class Found:
    hits: DataFrame
    costs: DataFrame


def fit_centroids(rows: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors, by alternating assignment and means. A centroid that loses all rows moves
    to the row that fits its own worst."""
    rng = np.random.default_rng(seed)
    centroids = rows[rng.choice(len(rows), min(lists, len(rows)), replace=False)]
    for _ in range(rounds):
        of, near = nearest(rows, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, rows)
        empty = np.flatnonzero(np.bincount(of, minlength=len(centroids)) == 0)
        sums[empty] = rows[np.argsort(near)[:len(empty)]]
        centroids = _normal(sums)
    return centroids


def nearest(rows: np.ndarray, centroids: np.ndarray, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its cosine, some rows at a time."""
    n = max(1, step // len(centroids))
    of, near = np.empty(len(rows), np.int64), np.empty(len(rows))
    for a in range(0, len(rows), n):
        scores = rows[a:a + n] @ centroids.T
        of[a:a + n] = scores.argmax(1)
        near[a:a + n] = scores.max(1)
    return of, near


def build(vectors: DataFrame, path: str, lists: int | None = None, vid: str = "vec_id", vec: str = "embedding",
          sample_rows: int = SAMPLE_ROWS) -> Index:
    """Write an index of all rows that have an id and a vector: ``lists`` of them, by default the square root of the rows.
    Rows are dealt to tasks by list, and a list with too many rows to several tasks (a rebalancing exchange)."""
    spark = vectors.sparkSession
    v = _with_vectors(vectors, vid, vec)
    n = v.count()
    lists = min(MOST_LISTS, lists or max(1, round(n ** 0.5)))
    part = int(min(1.0, sample_rows / max(n, 1)) * (1 << 30))
    sample = v.filter(F.pmod(F.xxhash64(vid, F.lit("sample")), F.lit(1 << 30)) < part).select(vec).collect()
    if n and not sample:
        sample = v.select(vec).limit(1).collect()
    centroids = fit_centroids(_normal(np.array([r[0] for r in sample], np.float64)), lists) if sample else np.empty((0, 0))
    schema = f"{vid} {_type(v, vid)}, {vec} {_type(v, vec)}, near double, list int"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                of, near = nearest(_normal(arrow_matrix(batch.column(1))), centroids)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near), pa.array(of, pa.int32())], names=[vid, vec, "near", "list"])

    assigned = v.mapInArrow(assign, schema)
    assigned.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
    width = F.size(vec).cast("bigint") * {"array<float>": 4, "array<double>": 8}[_type(v, vec)]
    stored = spark.read.schema(schema).parquet(f"{path}/lists")
    known = stored.groupBy("list").agg(
        F.count("*").alias("rows"), F.sum(width).alias("bytes"), F.min("near").alias("widest"))
    centres = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    centres.join(known, "list").coalesce(1).write.parquet(f"{path}/centroids")  # MOST_LISTS rows at most
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    known = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    column = (lambda c, kind: np.array([r[c] for r in known], kind))
    return Index(path, column("list", np.int64), column("centroid", np.float64), column("rows", np.int64),
                 column("bytes", np.int64), column("widest", np.float64))


def bounds(index: Index, q_mat: np.ndarray) -> np.ndarray:
    """The best score (query, list) that a row of the list can have with the query."""
    angle = np.arccos(np.clip(q_mat @ index.centroids.T, -1, 1))
    width = np.arccos(np.clip(index.widest, -1, 1))
    return np.cos(np.maximum(angle - width[None, :], 0)) + SLACK


def probe(spark: SparkSession, index: Index, q_ids: np.ndarray, q_mat: np.ndarray, asked: np.ndarray, k: int, schema: str) -> DataFrame:
    """The k best rows of each query in each task, out of the lists that ``asked`` (query, list) names."""
    types = to_arrow_schema(StructType.fromDDL(schema))
    wanted = {int(index.numbers[j]): np.flatnonzero(asked[:, j]) for j in np.flatnonzero(asked.any(0))}
    stored = spark.read.parquet(f"{index.path}/lists").filter(F.col("list").isin(list(wanted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(q_mat, k)
        for batch in batches:
            of = batch.column(2).to_numpy()
            for number in np.unique(of):
                part = batch.filter(pa.array(of == number))
                best.add(part.column(0).to_numpy(zero_copy_only=False), _normal(arrow_matrix(part.column(1))), wanted[int(number)])
        if best.held:
            yield found_batch(q_ids, best, types)

    vid, vec = stored.columns[0], stored.columns[1]
    return stored.select(vid, vec, "list").mapInArrow(run, schema)


def search(index: Index, queries: DataFrame, k: int = 5, probes: int = PROBES, exact: bool = False, qid: str = "query_id",
           vec: str = "embedding") -> Found:
    """The k best rows of each query, as ``top_k`` has them: all of them with ``exact``, else out of the nearest lists.
    Queries that are more than may be shipped to the tasks are searched in blocks of half that size, about."""
    spark = queries.sparkSession
    q = _with_vectors(queries, qid, vec)
    n, values = q.agg(F.count("*"), F.coalesce(F.sum(F.size(vec)), F.lit(0))).first()
    blocks = max(1, -(-n // (HELD_ROWS // 2)), -(-values // (HELD_VALUES // 2)))
    parts = [_search(spark, index, q.filter(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b) if blocks > 1 else q,
                     k, probes, exact, qid, vec) for b in range(blocks)]
    hits, costs = parts[0].hits, parts[0].costs
    for p in parts[1:]:
        hits, costs = hits.unionByName(p.hits), costs.unionByName(p.costs)
    return Found(hits, costs)


def _search(spark: SparkSession, index: Index, q: DataFrame, k: int, probes: int, exact: bool, qid: str, vec: str) -> Found:
    q_ids, q_mat = held_side(q, qid, vec)
    stored = spark.read.parquet(f"{index.path}/lists") if len(index.numbers) else None
    vid, kind = (stored.columns[0], stored.schema[0].dataType.simpleString()) if stored is not None else ("vec_id", "bigint")
    schema = f"{qid} {_type(q, qid)}, {vid} {kind}, score double"
    asked = np.zeros((len(q_ids), len(index.numbers)), bool)
    if not asked.size:
        found = spark.createDataFrame([], schema)
    else:
        close = np.argsort(-(q_mat @ index.centroids.T), axis=1, kind="stable")[:, :probes]
        asked[np.arange(len(q_ids))[:, None], close] = True
        found = probe(spark, index, q_ids, q_mat, asked, k, schema)
        if exact:
            first = _best(found, qid, vid, k).collect()  # k rows of each held query
            least = dict.fromkeys(q_ids.tolist(), -np.inf)
            for row in first:
                if row["rank"] == k:
                    least[row[qid]] = row["score"]
            more = (bounds(index, q_mat) >= np.array([least[i] for i in q_ids.tolist()])[:, None]) & ~asked
            found = spark.createDataFrame([(r[qid], r[vid], r["score"]) for r in first], schema)
            if more.any():
                found = found.unionByName(probe(spark, index, q_ids, q_mat, more, k, schema))
            asked |= more
    costs = [(i, int(a.sum()), int(index.rows[a].sum()), int(index.size[a].sum()), int(index.rows.sum()), int(index.size.sum()))
             for i, a in zip(q_ids.tolist(), asked)]
    return Found(_with_distance(_best(found, qid, vid, k)), spark.createDataFrame(
        costs, f"{qid} {_type(q, qid)}, lists int, rows bigint, bytes bigint, all_rows bigint, all_bytes bigint"))


def _best(found: DataFrame, qid: str, vid: str, k: int) -> DataFrame:
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), vid)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
