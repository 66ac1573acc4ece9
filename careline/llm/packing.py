"""Packing of documents into sequences by order-preserving dynamic programming.

The ids of a run of documents are one stream. Cuts may fall at ends of documents (free),
behind sentence ends (a small penalty) and, where neither is near, at set distances inside
long stretches (a larger one). The programme chooses the cuts that minimise padding plus
penalties: best[j] = min over i of best[i] + padding(j - i) + penalty(j), with j - i at most
the length of a sequence. As padding is length - (j - i), the minimum over the window is that
of best[i] + i, which a monotone queue keeps in constant time per cut; windows that are a
power of two need no padding and are compared beside it.

A task packs its own documents in order, in blocks of at least ``PACKED`` characters that go on over
batches (only the last of a task is shorter), so nothing is shuffled and memory is bounded by a block or the longest
text. The one sequence that ends a block may be padded more; a block has some 200 sequences. Sequence ids are partition << 32 | number in the partition.

Defined cases: null and empty texts are the end id alone; a text longer than a block is
packed in several blocks, whose pieces continue each other; repeated rows are packed each;
an empty table gives no rows; columns beyond id and text play no part. A task that is run
again gives the same rows if its input partition does, as one that is read from files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careline.llm.common import sliced, widened
from careline.llm.pretokens import blocks, pieces, pre_tokens

LENGTH = 2048
END_ID = 1
#: Cost of a cut behind a sentence, of one elsewhere, and of a sequence, in padded tokens.
SENTENCE, INSIDE, SEQUENCE = 4, 24, 16
#: Distance of cuts elsewhere, in stretches without ends of sentences or documents.
STEP = 64
#: Characters that a task gathers before it packs them together. A text is cut beyond twice as many.
PACKED = 1_000_000
#: Shorter windows that need no padding either.
POWERS = (256, 512, 1024)
SCHEMA = ("start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")


@lru_cache(2)
def sentence_ends(ranks_file: str) -> np.ndarray:
    """For each id, whether its text ends a sentence or a line."""
    import base64

    ends = np.zeros(1 << 16, bool)
    with open(ranks_file, "rb") as f:
        for a, b in map(bytes.split, f):
            ends[int(b)] = base64.b64decode(a).rstrip(b" ")[-1:] in (b".", b"!", b"?", b"\n")
    return ends


def candidates(ends: np.ndarray, soft: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of possible cuts and their penalties. ``ends``: ends of documents, the last being
    the end of the stream; ``soft``: places behind sentence ends."""
    penalty = np.full(int(ends[-1]) + 1, -1)
    penalty[soft] = SENTENCE
    penalty[ends] = 0
    known = np.flatnonzero(penalty >= 0)
    before = np.concatenate(([0], known[:-1]))
    extra = np.maximum((known - before - 1) // STEP, 0)
    penalty[np.repeat(before, extra) + STEP * (
        np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)] = INSIDE
    places = np.flatnonzero(penalty >= 0)
    return places, penalty[places]


def best_cuts(places: np.ndarray, penalty: np.ndarray, length: int = LENGTH) -> list[int]:
    """The chosen cuts, in order; the last is the end of the stream."""
    at = np.concatenate(([0], places))
    exact = []
    for p in POWERS:
        found = np.searchsorted(at, at - p)
        exact.append(np.where((p <= length) & (at >= p) & (at[found] == at - p), found, -1).tolist())
    pos, pen = at.tolist(), [0, *(penalty + SEQUENCE).tolist()]
    e0, e1, e2 = exact
    m = len(pos)
    best, back, key = [0] * m, [0] * m, [0] * m
    queue, head = [0], 0  # indexes whose key grows from head on
    for j in range(1, m):
        p = pos[j]
        low = p - length
        while pos[queue[head]] < low:
            head += 1
        i = queue[head]
        cost = key[i] + length - p
        k = e2[j]
        if k >= 0 and best[k] < cost:
            cost, i = best[k], k
        k = e1[j]
        if k >= 0 and best[k] < cost:
            cost, i = best[k], k
        k = e0[j]
        if k >= 0 and best[k] < cost:
            cost, i = best[k], k
        cost += pen[j]
        best[j], back[j] = cost, i
        cost += p
        key[j] = cost
        while len(queue) > head and key[queue[-1]] >= cost:
            queue.pop()
        queue.append(j)
    cuts, j = [], m - 1
    while j:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


def token_streams(texts: list[str | None], files: tuple[str, str]
                  ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of ids: (ids, number of the text of each piece of a text, its ids in the block).
    Each text ends with the end id; a long text goes on over blocks."""
    table = pieces(*files)
    done = 0  # texts that are finished

    def closed(ids, of, upto):
        """Adds the end id to texts ``done`` .. ``upto`` - 1."""
        counts = np.bincount(of - done, minlength=max(upto - done, of[-1] - done + 1 if len(of) else 0))
        stops = np.cumsum(counts[:upto - done])
        return np.insert(ids, stops, END_ID), counts + (np.arange(len(counts)) < upto - done)

    parts_of = blocks(texts, 2 * PACKED)
    parts = next(parts_of, None)
    while parts is not None:
        following = next(parts_of, None)
        block = pre_tokens(parts)
        found = table.ids(block.words)
        size = np.array([len(v) for v in found], np.int64)
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(size.sum()))
        n = size[block.codes]
        first = (np.cumsum(size) - size)[block.codes]
        ids = flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        of = np.repeat(block.text_of, n)
        upto = len(texts) if following is None else following[0][0]
        ids, counts = closed(ids, of, upto)
        yield ids, np.arange(done, done + len(counts)), counts
        done, parts = upto, following
    if done < len(texts):
        yield np.full(len(texts) - done, END_ID, np.uint32), np.arange(done, len(texts)), np.ones(
            len(texts) - done, np.int64)


def pack(texts: list[str | None], files: tuple[str, str], length: int = LENGTH
         ) -> Iterator[tuple[np.ndarray, list[memoryview]]]:
    """Pieces of the texts block by block: rows of (text, start, length, tokens of the text so far
    in this and earlier blocks, sequence within the block, offset), and the ids of each piece as
    little-endian bytes."""
    ends_sentence = sentence_ends(files[0])
    before: dict[int, int] = {}
    for ids, of, counts in token_streams(texts, files):
        stops = np.cumsum(counts)
        soft = np.flatnonzero(ends_sentence[ids]) + 1
        places, penalty = candidates(stops[counts > 0], soft)
        cuts = np.array(best_cuts(places, penalty, length))
        edges = np.unique(np.concatenate((stops[counts > 0], cuts)))
        starts = np.concatenate(([0], edges[:-1]))
        owner = np.searchsorted(stops, starts, "right")
        sequence = np.searchsorted(cuts, starts, "right")
        seq_start = np.concatenate(([0], cuts))[sequence]
        carried = np.array([before.get(int(t), 0) for t in of]) if before else np.zeros(len(of), np.int64)
        inside = starts - (stops - counts)[owner] + carried[owner]
        total = counts + carried
        before = {int(of[-1]): int(total[-1])}
        raw = memoryview(ids.astype("<u4").tobytes())
        yield (np.stack([of[owner], inside, edges - starts, total[owner], sequence, starts - seq_start]),
               [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), edges.tolist())])


def packed(docs: DataFrame, files: tuple[str, str], id_col: str = "doc_id", text_col: str = "text",
           length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: the document's id, start, length, crc32 of the ids (little-endian, 32
    bits each), tokens of the document with the end id, sequence_id, offset, and with
    ``with_ids`` the ids themselves."""
    schema = widened(docs.select(id_col), SCHEMA + ", ids array<int>" * with_ids)

    def made(ids: list[pa.Array], texts: list[str | None], base: int) -> tuple[int, pa.RecordBatch]:
        """The rows of a block of texts, whose sequences are numbered from ``base``, and the next number."""
        held = []
        for rows, raw in pack(texts, files, length):
            rows[4] += base
            base = int(rows[4].max()) + 1
            held.append((rows, np.array([zlib.crc32(x) for x in raw], np.int64), raw if with_ids else None))
        rows = np.concatenate([h[0] for h in held], 1)
        whole = np.zeros(len(texts), np.int64)
        np.maximum.at(whole, rows[0], rows[3])
        arrays = [pa.concat_arrays(ids).take(pa.array(rows[0])), rows[1], rows[2], np.concatenate([h[1] for h in held]),
                  whole[rows[0]], rows[4], rows[5]]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32)
                                    for h in held for x in h[2]], pa.list_(pa.int32())))
        return base, pa.RecordBatch.from_arrays(
            [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        try:
            # an open block goes on over batches, so their size does not matter
            for batch in (part for whole in batches for part in sliced(whole, 1, PACKED)):
                ids.append(batch.column(0))
                texts += batch.column(1).to_pylist()
                held += sum(map(len, filter(None, texts[len(texts) - len(batch):])))
                if held >= PACKED:
                    base, rows = made(ids, texts, base)
                    yield rows
                    ids, texts, held = [], [], 0
            if texts:
                yield made(ids, texts, base)[1]
        finally:
            pieces.cache_clear()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
