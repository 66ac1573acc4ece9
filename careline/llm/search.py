"""Ranked lexical search by the Best Position Algorithm.

A text's terms are its runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case. N
documents have a term, with L terms in all; a document has n of them, a term occurs tf times in
it and df documents hold it. With ``weight`` = floor(1000 ln((2N + 2) / (2 df + 1))) and
m = 10 + (90 n N div L), a document scores weight * (10^9 tf div (1000 tf + 8 m)) for each
term of a query, and each query gets its k best documents.

1. One pass over the texts writes postings of the terms that the queries have, in blocks of
   documents: per block and term the documents and their tf, and the lengths of all its documents. df, N
   and L are sums over that table.
2. Blocks are dealt to shards of about ``SHARD`` bytes of text. In a shard each term has its impact list:
   its documents by falling impact, the score part without the weight. For a query the lists are
   read side by side, some positions further each round. Every document met is scored at once, by
   direct access to its postings in all lists, and these positions are marked as seen, too. The best position of a
   list is the end of its gapless seen front; no unseen document can have more than the sum of the
   scores at the best positions. Reading ends when that sum is strictly below the kth best score, so equal scores
   are never cut off, or when the lists are exhausted.
3. The k best of all shards are brought together by query.

Queries are collected in chunks of at most ``CHUNK`` bytes of text (more only if one has more), each searched in all documents.
A block ends with the document that fills it, so shards are bounded but for the length of a single text.

Defined cases: null texts have no terms, and documents without any are not counted in N; rows with the same item id are
one query with the terms of all of them, each once; a null item id is a query as well; rows of equal doc_id are documents
each; scores of 0 are no results; equal scores go by doc_id, null last; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from careline.llm.common import written

#: Results of a query.
K = 10
#: Bytes of text of a block of postings, of a shard, and of the queries that are searched at a time.
BLOCK, SHARD, CHUNK = 2_000_000, 16_000_000, 16_000_000
#: Positions of each list that the first round reads; each round reads twice as many as the one before.
STEP = 8
#: Letters in lower case, and a blank for every byte that is no part of a term.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20
                   for c in range(0x80)) + bytes(range(0x80, 0x100))
POSTINGS = "block bigint, term int, docs array<int>, tfs array<int>, ids array<{id}>, sizes array<int>, bytes bigint"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def postings(docs: DataFrame, numbers: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
             block: int = BLOCK) -> DataFrame:
    """Rows of ``POSTINGS``. Per block and term of ``numbers``: the documents, by number in the block, and their
    tf. Per block one row without a term: the ids of its documents with a term, and their numbers of terms."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = StructType.fromDDL(POSTINGS.format(id=kind))
    source = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary"))

    def arrays(ids: pa.Array, codes: list[np.ndarray], sizes: list[int], size: int, number: int) -> pa.RecordBatch:
        flat = np.concatenate(codes)
        doc = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        key, tf = np.unique(flat * len(codes) + doc, return_counts=True)  # by term, then document
        term, doc = np.divmod(key, len(codes))
        first = np.flatnonzero(np.diff(term, prepend=-1))
        n = len(first) + 1
        edges = np.concatenate((first, [len(key)] * 2)).astype(np.int32)  # the last row has no postings
        empty = np.zeros(n + 1, np.int32)
        empty[n] = len(codes)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, number)), pa.array([*term[first].tolist(), None], pa.int32()),
            pa.ListArray.from_arrays(edges, pa.array(doc.astype(np.int32))),
            pa.ListArray.from_arrays(edges, pa.array(tf.astype(np.int32))),
            pa.ListArray.from_arrays(empty, ids), pa.ListArray.from_arrays(empty, pa.array(sizes, pa.int32())),
            pa.array([0] * (n - 1) + [size])], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, codes, sizes, ids = TaskContext.get().partitionId() << 32, 0, [], [], []
        known = numbers.get
        for batch in batches:
            taken, texts = [], batch.column(1)
            for i in range(len(texts)):
                words = terms_of(texts[i].as_py())
                if words:
                    found = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
                    codes.append(found[found >= 0])
                    sizes.append(len(words))
                    taken.append(i)
                    held += len(texts[i].as_buffer())
                if codes and (held >= block or i + 1 == len(texts)):
                    if taken:
                        ids.append(batch.column(0).take(pa.array(taken)))
                        taken = []
                    if held >= block:
                        yield arrays(pa.concat_arrays(ids), codes, sizes, held, number)
                        number, held, codes, sizes, ids = number + 1, 0, [], [], []
        if codes:
            yield arrays(pa.concat_arrays(ids), codes, sizes, held, number)

    return source.mapInArrow(run, schema)


class Shard:
    """Impact lists and documents of some blocks. Terms of a shard are numbered by place."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, tfs: np.ndarray, norms: np.ndarray):
        """``terms``, ``docs``, ``tfs``: a posting each; ``norms``: m of each document."""
        tfs = tfs.astype(np.int64)
        parts = 1_000_000_000 * tfs // (1000 * tfs + 8 * norms[docs])
        order = np.lexsort((docs, -parts, terms))
        terms, self.docs, self.parts = terms[order], docs[order], parts[order]
        self.terms, self.first = np.unique(terms, return_index=True)
        self.first = np.append(self.first, len(terms))
        which = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        # direct access: per document the lists it is in, and its place there
        order = np.argsort(self.docs, kind="stable")
        self.of, self.place = which[order], order
        self.edge = np.searchsorted(self.docs[order], np.arange(len(norms) + 1))
        self.weight = np.zeros(len(self.terms), np.int64)
        self.seen = np.zeros(len(self.docs), bool)
        self.met = np.zeros(len(norms), bool)

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """The documents that were met (by number), the k best among them, and their scores."""
        first, size = self.first[lists], np.diff(self.first)[lists]
        self.weight[lists] = weights
        at = np.zeros(len(lists), np.int64)  # positions read by turns
        front = np.zeros(len(lists), np.int64)  # gapless seen positions
        docs, scores, marked, kth = [], [], [], 0
        while True:
            n = np.minimum(step, size - at)
            where = np.repeat(first + at - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at += n
            new = np.unique(self.docs[where])
            new = new[~self.met[new]]
            self.met[new] = True
            n = self.edge[new + 1] - self.edge[new]
            own = np.repeat(self.edge[new] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            places = self.place[own]
            weight = self.weight[self.of[own]]
            places = places[weight > 0]
            self.seen[places] = True
            marked.append(places)
            gained = np.bincount(np.repeat(np.arange(len(new)), n), weight * self.parts[self.place[own]], len(new))
            docs.append(new)
            scores.append(gained.astype(np.int64))  # sums of integers far below 2^53
            got = np.concatenate(scores)
            if len(got) >= k:
                kth = int(np.partition(got, len(got) - k)[len(got) - k])
            bound = 0
            for i in range(len(lists)):
                f, end = int(front[i]), int(size[i])
                f = max(f, int(at[i]))
                while f < end:  # on to the first position that is not seen
                    part = self.seen[first[i] + f:first[i] + min(f + 64, end)]
                    stop = int(part.argmin())
                    if not part[stop]:
                        f += stop
                        break
                    f += len(part)
                front[i] = f
                if f < end:
                    bound += int(weights[i]) * int(self.parts[first[i] + f - 1])
            if bound < kth or (at == size).all() or (front == size).all():
                break
            step *= 2
        self.weight[lists] = 0
        for places in marked:
            self.seen[places] = False
        docs = np.concatenate(docs)
        self.met[docs] = False
        return docs, got


def weighted(df: np.ndarray, n: int) -> np.ndarray:
    """The weight of terms that ``df`` of ``n`` documents hold."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _search(index: DataFrame, queries: list[tuple], n: int, total: int, weights: np.ndarray, k: int, shard: int,
            schema: StructType) -> DataFrame:
    """query, doc, score: the k best documents of each query in each shard. ``queries``: term numbers."""
    size = index.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-size // shard))
    # terms that no document misses weigh nothing
    asked = [terms[weights[terms] > 0] for terms in queries]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        heads = table.filter(pc.is_null(table["term"])).combine_chunks()
        rest = table.filter(pc.is_valid(table["term"])).combine_chunks()
        found = []
        if len(rest):
            ids, sizes = (heads[c].chunk(0).flatten() for c in ("ids", "sizes"))
            norms = 10 + 90 * sizes.to_numpy().astype(np.int64) * n // total
            count = pc.list_value_length(heads["ids"]).to_numpy()
            offset = dict(zip(heads["block"].to_pylist(), (np.cumsum(count) - count).tolist()))
            count = pc.list_value_length(rest["docs"]).to_numpy()
            base = np.array([offset[b] for b in rest["block"].to_pylist()], np.int64)
            lists = Shard(np.repeat(rest["term"].to_numpy(), count),
                          np.repeat(base, count) + rest["docs"].chunk(0).flatten().to_numpy(),
                          rest["tfs"].chunk(0).flatten().to_numpy(), norms)
            rank = np.empty(len(ids), np.int64)
            rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))  # by id, null last
            for i, terms in enumerate(asked):
                at = np.searchsorted(lists.terms, terms)
                there = at < len(lists.terms)
                there[there] = lists.terms[at[there]] == terms[there]
                if there.any():
                    docs, scores = lists.best(at[there], weights[terms[there]], k)
                    top = np.lexsort((rank[docs], -scores))[:k]
                    top = top[scores[top] > 0]
                    found.append(pa.table([pa.array(np.full(len(top), i, np.int32)), ids.take(pa.array(docs[top])),
                                           pa.array(scores[top])], schema=wanted))
        return pa.concat_tables(found) if found else wanted.empty_table()

    wanted = to_arrow_schema(schema)
    dealt = index.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, schema)


def ranked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", k: int = K, block: int = BLOCK, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    bytes_ = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-bytes_ // chunk)
    item_kind, doc_kind = (d.schema[c].dataType.simpleString() for d, c in ((items, item_col), (docs, id_col)))
    parts = []
    for c in range(chunks):
        mine = asked.filter(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c).collect()
        terms: dict = {}
        for row in mine:
            terms.setdefault(row["item"], set()).update(terms_of((row["text"] or "").encode()))
        numbers = {t: i for i, t in enumerate(sorted(set().union(*terms.values())))}
        if not numbers:
            continue
        index = written(postings(docs, numbers, id_col, text_col, block), "postings")
        whole = index.filter("term IS NULL").agg(
            F.sum(F.size("ids")).alias("n"),
            F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, b: a + b)).alias("total")).first()
        if not whole["n"]:
            continue
        df = np.zeros(len(numbers), np.int64)
        for term, held in index.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs"))).collect():
            df[term] = held  # a row per term of the queries
        names = list(terms)
        queries = [np.array(sorted(numbers[t] for t in terms[item]), np.int64) for item in names]
        schema = StructType.fromDDL(f"query int, doc_id {doc_kind}, score bigint")
        best = _search(index, queries, whole["n"], whole["total"], weighted(df, whole["n"]), k, shard, schema)
        items_of = spark.createDataFrame(list(enumerate(names)), f"query int, item_id {item_kind}")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        top = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        parts.append(top.join(F.broadcast(items_of), "query").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score bigint")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
