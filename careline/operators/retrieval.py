"""Exact vector search, with one kernel and three carriers.

Scores come from matrix products of some queries with some vectors. A side of at most ``HELD_ROWS`` rows and
``HELD_VALUES`` values is shipped to the tasks of the other side: held vectors give each query its result without
any exchange, held queries take the best ``k`` of each task, and only those rows are shuffled. If both sides are larger,
they are tiled, and each pair of tiles gives only its best ``k`` per query. The result is the same on all three ways.
For approximate or pruned search see ``vector_index``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from careline.functions.core import nz
from careline.rules import graph_seed, intents

SCORE_DIGITS = 6
#: Rows of a tile on either side, and values of a score matrix that a task holds at a time.
TILE_ROWS, TILE_VALUES = 4_096, 1 << 21
#: Rows and values (32 MB) of a side that may be shipped to the tasks of the other.
HELD_ROWS, HELD_VALUES = 4_096, 1 << 22


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in values])


def arrow_matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _normal(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)


def _best_of(q_mat: np.ndarray, v_ids: np.ndarray, v_mat: np.ndarray, k: int):
    """For each query (rows) the k best vectors: query number, vector ids, scores and ranks, best first,
    ties by the smaller vector id. Scores are worked out for some queries at a time."""
    order = np.argsort(v_ids, kind="stable")
    v_ids, v_mat = v_ids[order], v_mat[order]
    step, k = max(1, TILE_VALUES // len(v_ids)), min(k, len(v_ids))
    for a in range(0, len(q_mat), step):
        scores = np.round(q_mat[a:a + step] @ v_mat.T, SCORE_DIGITS)
        if k < len(v_ids):
            # all that reach the k-th best score, so that ties at the cut are decided by id
            least = np.partition(scores, len(v_ids) - k, axis=1)[:, len(v_ids) - k]
            row, col = np.nonzero(scores >= least[:, None])
        else:
            row, col = np.nonzero(np.ones_like(scores, bool))
        found = scores[row, col]
        best = np.lexsort((col, -found, row))
        row, col, found = row[best], col[best], found[best]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < k
        yield a + row[kept], v_ids[col[kept]], found[kept], rank[kept] + 1


class Best:
    """The k best vectors of each of some queries, over batches of vectors."""

    def __init__(self, q_mat: np.ndarray, k: int):
        self.q_mat, self.k, self.held = q_mat, k, []

    def add(self, v_ids: np.ndarray, v_mat: np.ndarray, chosen: np.ndarray | None = None) -> None:
        """``chosen``: the queries that these vectors are compared with, by default all."""
        chosen = np.arange(len(self.q_mat)) if chosen is None else chosen
        for q, v, score, _ in _best_of(self.q_mat[chosen], v_ids, v_mat, self.k):
            self.held.append((chosen[q], v, score))
        if sum(len(h[0]) for h in self.held) > 4 * self.k * len(self.q_mat) + 10_000:
            self.held = [self.result()]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, vector ids and scores."""
        q, v, score = (np.concatenate(x) for x in zip(*self.held))
        best = np.lexsort((v, -score, q))
        q, v, score = q[best], v[best], score[best]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        return q[kept], v[kept], score[kept]


def found_batch(q_ids: np.ndarray, best: Best, wanted: pa.Schema) -> pa.RecordBatch:
    q, ids, score = best.result()
    return pa.RecordBatch.from_arrays(
        [pa.array(q_ids[q], wanted.types[0]), pa.array(ids, wanted.types[1]), pa.array(score)], names=wanted.names)


def held_side(df: DataFrame, ident: str, vec: str, rows: int = HELD_ROWS,
              values: int = HELD_VALUES) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and normalised vectors of a side that may be shipped; None for a larger one, of which no more than the
    first ``rows`` are looked at."""
    found = df.select(ident, vec).limit(rows + 1).collect()
    if len(found) > rows or sum(len(r[1]) for r in found) > values:
        return None
    return np.array([r[0] for r in found], None if found else object), (
        _normal(_matrix([r[1] for r in found])) if found else np.empty((0, 0)))


def top_k(queries: DataFrame, vectors: DataFrame, k: int | None = 5, qid: str = "query_id",
          vid: str = "vec_id", vec: str = "embedding", tile_rows: int = TILE_ROWS, held_rows: int = HELD_ROWS) -> DataFrame:
    """The k most similar vectors of every query by cosine, with rank from 1; all with k None.

    Ids are unique on each side. Scores are rounded before ranking and ties go to the smaller id, so the result does
    not depend on the way the sides meet. ``distance`` is ``1 - score``. Rows without an id or a vector take no part.
    """
    q, v = _with_vectors(queries, qid, vec), _with_vectors(vectors, vid, vec)
    schema = f"{qid} {_type(q, qid)}, {vid} {_type(v, vid)}, score double"
    held = held_side(v, vid, vec, held_rows)
    if held is not None:
        return _with_distance(_with_held_vectors(q, held, k, qid, vec, schema + ", rank int"))
    held = held_side(q, qid, vec, held_rows) if k is not None else None
    found = (_tiled(q, v, k, qid, vid, vec, tile_rows, schema) if held is None
             else _with_held_queries(v, held, k, vid, vec, schema))
    w = Window.partitionBy(qid).orderBy(F.col("score").desc(), vid)
    ranked = found.withColumn("rank", F.row_number().over(w))
    return _with_distance(ranked if k is None else ranked.filter(F.col("rank") <= k))


def _with_distance(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("distance", F.round(1 - F.col("score"), SCORE_DIGITS))


def _with_held_vectors(q: DataFrame, held: tuple[np.ndarray, np.ndarray], k: int | None, qid: str, vec: str, schema: str) -> DataFrame:
    v_ids, v_mat = held
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) and len(v_ids):
                for row, v, score, rank in _best_of(_normal(arrow_matrix(batch.column(1))), v_ids, v_mat, k or len(v_ids)):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), pa.array(v, wanted.types[1]), pa.array(score), pa.array(rank, pa.int32())],
                        names=wanted.names)

    return q.select(qid, vec).mapInArrow(run, schema)


def _with_held_queries(v: DataFrame, held: tuple[np.ndarray, np.ndarray], k: int, vid: str, vec: str, schema: str) -> DataFrame:
    """The k best of each task."""
    q_ids, q_mat = held
    wanted = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(q_mat, k)
        for batch in batches:
            if len(batch) and len(q_ids):
                best.add(batch.column(0).to_numpy(zero_copy_only=False), _normal(arrow_matrix(batch.column(1))))
        if best.held:
            yield found_batch(q_ids, best, wanted)

    return v.select(vid, vec).mapInArrow(run, schema)


def _tiled(q: DataFrame, v: DataFrame, k: int | None, qid: str, vid: str, vec: str, tile_rows: int, schema: str) -> DataFrame:
    """The k best of each pair of tiles. Both sides are cut into tiles of about ``tile_rows`` by a hash of the id,
    so a task holds two tiles whatever the sizes are."""

    def tiled(df: DataFrame, ident: str, own: str, other: str, n: Column, m: Column) -> DataFrame:
        """Rows with their tile, copied to every tile of the other side."""
        return df.join(F.broadcast(counts)).withColumn(own, F.pmod(F.xxhash64(ident), n)).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), m - 1))).select(
            *[F.col(c).alias(c) for c in (ident, vec, own, other)])  # names of their own, as sides may be one table

    tiles = (lambda c: F.greatest(F.ceil(F.count(c) / tile_rows), F.lit(1)).cast("bigint"))
    counts = q.agg(tiles(qid).alias("_nq")).join(F.broadcast(v.agg(tiles(vid).alias("_nv"))))  # one row
    qs = tiled(q, qid, "_qb", "_vb", F.col("_nq"), F.col("_nv"))
    vs = tiled(v, vid, "_vb", "_qb", F.col("_nv"), F.col("_nq"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=[qid, vid, "score"])
        parts = list(_best_of(_normal(_matrix(left[vec])), right[vid].to_numpy(), _normal(_matrix(right[vec])), k or len(right)))
        return pd.DataFrame({qid: left[qid].to_numpy()[np.concatenate([p[0] for p in parts])],
                             vid: np.concatenate([p[1] for p in parts]),
                             "score": np.concatenate([p[2] for p in parts])})

    return qs.groupBy("_qb", "_vb").cogroup(vs.groupBy("_qb", "_vb")).applyInPandas(meet, schema)


def _with_vectors(df: DataFrame, ident: str, vec: str) -> DataFrame:
    return df.select(ident, vec).filter(F.col(ident).isNotNull() & F.col(vec).isNotNull())


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def cosine_pairs(queries: DataFrame, vectors: DataFrame, qid: str = "query_id",
                 vid: str = "vec_id", vec: str = "embedding", tile_rows: int = TILE_ROWS,
                 held_rows: int = HELD_ROWS) -> DataFrame:
    """The score of every query with every vector. The result is the full matrix by definition; it
    is made batch by batch, or tile by tile."""
    return top_k(queries, vectors, None, qid, vid, vec, tile_rows, held_rows).select(qid, vid, "score")


def score_candidates(vectors: DataFrame, candidates: DataFrame, keep: int = 4,
                     cid: str = "name", vid: str = "vec_id", vec: str = "embedding",
                     tile_rows: int = TILE_ROWS, held_rows: int = HELD_ROWS) -> DataFrame:
    """For every vector its ``keep`` best candidates (array of id and score, best first)
    and the number of candidates that have a vector."""
    ranked = top_k(vectors, candidates, keep, vid, cid, vec, tile_rows, held_rows)
    best = ranked.groupBy(vid).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.col(cid).alias("id"), "score"))),
        lambda x: F.struct(x["id"], x["score"])).alias("best"))
    n = _with_vectors(candidates, cid, vec).agg(F.count("*").cast("int").alias("n_candidates"))
    known = _with_vectors(vectors, vid, vec).select(vid)
    none = F.array().cast(best.schema["best"].dataType)
    return known.join(best, vid, "left").join(F.broadcast(n)).select(
        vid, "n_candidates", F.coalesce("best", none).alias("best"))


def match_with_gap(scored: DataFrame, k: int = graph_seed.GAP_K,
                   threshold: float = graph_seed.GAP_THRESHOLD,
                   gap: float = graph_seed.GAP_MIN) -> DataFrame:
    """The best k candidates above a threshold, or none where the first and the fourth
    are too close to tell apart."""
    unclear = (F.col("n_candidates") > 3) & (
        F.get(F.col("best"), F.lit(0))["score"] - F.get(F.col("best"), F.lit(3))["score"] < gap)
    kept = F.filter(F.slice("best", 1, k), lambda b: b["score"] >= threshold)
    return scored.withColumn("matches", F.when(unclear, F.slice("best", 1, 0)).otherwise(kept))


def retrieve(ranked: DataFrame, documents: DataFrame, vid: str = "vec_id", text: str = "text",
             category: str = "category", drop_category: str = "conversations",
             chars: int = 300, min_score: float | None = None) -> DataFrame:
    """Join ranked hits with their documents and drop one category *after* ranking (so
    fewer than k may stay), cutting the text. The optional score bound is off by default."""
    hits = ranked.join(documents.select(vid, text, category), vid)
    kept = hits.filter(~F.col(category).eqNullSafe(F.lit(drop_category)))
    if min_score is not None:
        kept = kept.filter(F.col("score") >= min_score)
    return kept.withColumn(text, F.substring(nz(text), 1, chars))


def needs_retrieval(intent: Column) -> Column:
    return intent != intents.GENERAL


def embed(factory: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> Callable:
    """Slot for an embedding model: ``factory`` is called once per worker and returns a
    function from texts to a matrix. The stand-in hashes words into a fixed width."""
    make = factory or hashing_model

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.fillna("").tolist()), dtype=np.float32)),
                            index=texts.index)

    return vectors


def hashing_model(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for word in text.split():
                code = zlib.crc32(word.encode())
                out[row, code % dim] += 1.0 if code & 0x10000 else -1.0
        return out

    return encode
